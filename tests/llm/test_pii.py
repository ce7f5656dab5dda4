"""Personal data: base spans against plain regular expressions, added spans and thresholds, trees in SQL against trees in Python."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import pii
from panelspark.llm.common import table

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id bigint, text string, kind int, pii string, base boolean"


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text) if passes(kind, m.group()))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def odd_texts():
    return [None, "", "no data", "a@b.cd", "x@y@z.w, q@w", "a@b.com_x@d.e..f@g.h", ".%+-@a-b.c-d.", "é@b.com ünï@straße.de日本a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3",
            "4111 1111-1111 1111 and 4111111111111112", "4111111111111111 4111111111111111", "12 34 56 78 90 12 34 56 78 90 12", "+1 (988) 555-2485 +49.30.1234567 +1 23 +(1)",
            "+1 (269) 555-3296 4111111111111111 10.0.0.1 4111111111111111", "bob (at) mail (dot) example.com, bob @ mail.de", "a" * 30_000 + "@", "1 " * 20_000, "a@b.cd " * 1500,
            "9" * 30_000, "+1" * 5000, "." .join("1" * 9000), "😀 a@b.cd 😀 10.0.0.1 ￼￼"]


def test_base_spans_as_plain_patterns(spark, sf):
    odd = spark.createDataFrame([(k % 17, t, 1, "x", True) for k, t in enumerate(odd_texts())], SCHEMA)
    for docs in (odd, table(spark, sf, "documents")):
        made = pii.digests(docs).withColumn("text", F.lit("")).collect()
        texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
        want = []
        for doc, text in texts:
            spans = base_spans(text)
            want.append((doc, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined(spans).encode()).hexdigest()))
        assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in made) == sorted(want)


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(1)

    def card():
        head = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(head + str(c) for c in range(10) if luhn(head + str(c)))

    rows = []
    for k in range(1500):
        number, phone = card(), f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        text = ["please mail bob.%d@mail.example.com today" % k, f"host 10.0.{k % 256}.{k % 200} is up", f"card {number} is paid", f"call {phone} now",
                f"order {int(rng.integers(10**15, 9 * 10**15))}"][k % 5]
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return pii.fit(docs), card


def test_the_method_adds_what_plain_rules_swallow(spark, trained):
    model, card = trained
    number = card()
    assert set(model.threshold) == set(pii.KINDS) and all(t < math.inf for t in model.threshold.values())
    texts = [f"card {number} {number} ok", f"call +1 (269) 555-3296 {number} now", "mail bob (at) mail (dot) example.com today", f"order {number[:-1]}{(int(number[-1]) + 1) % 10} is", "in 2024 we had 1500 2000 300 units"]
    found = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start:s.end], s.base) for s in r.pii] for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()}
    assert found[0] == [("card", number, False)] * 2
    assert ("card", number, False) in found[1] and ("phone", "+1 (269) 555-3296", False) in found[1]
    assert found[2] == [("email", "bob (at) mail (dot) example.com", False)]
    assert found[3] == [] and found[4] == []
    clean = pii.redact(spark.createDataFrame([(0, texts[0], "c"), (1, "a@b.cd, 10.0.0.1﷐", "d"), (2, None, "e")], "doc_id bigint, text string, pii string"), model).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["card [card] [card] ok", "[email], [ip]�", None] and [r.pii for r in clean] == ["c", "d", "e"]


def test_sql_trees_score_like_python_trees(spark, trained):
    model, _ = trained
    rng = np.random.default_rng(2)
    held = {n: rng.integers(0, size, 300) for n, size in pii.FEATURES.items()}
    rows = [tuple(int(held[n][k]) for n in pii.FEATURES) for k in range(300)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in pii.FEATURES)).select(F.struct("*").alias("f"))
    for kind in pii.KINDS:
        got = [r[0] for r in frame.select(F.expr(model.score_sql(kind, "f"))).collect()]
        raw = sum(t.score(held) for t in model.trees[kind])
        assert got == pytest.approx((1 / (1 + np.exp(-raw))).tolist())


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(3)
    held = {n: rng.integers(0, size, 4000) for n, size in pii.FEATURES.items()}
    truth = ((held["n"] > 10) & (held["ok"] == 1)).astype(float)
    raw = sum(t.score(held) for t in pii.boost(held, truth, np.ones(4000)))
    assert ((raw > 0) == (truth > 0)).mean() > 0.999


def test_threshold_is_the_least_calibrated_score():
    score = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    assert pii.calibrated_threshold(score, np.array([0, 5, 4, 9, 10]), np.full(5, 10.0), 0.9) == 0.4
    assert pii.calibrated_threshold(score, np.array([9, 0, 0, 0, 0]), np.full(5, 10.0), 0.9) == math.inf
    assert pii.calibrated_threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.9) == math.inf


def test_no_python_on_the_executors_and_no_shuffle_of_texts(spark, sf):
    docs = table(spark, sf, "documents")
    plan = pii.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty(spark):
    assert pii.digests(spark.createDataFrame([], SCHEMA)).count() == 0
