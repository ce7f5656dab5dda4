"""Ranked search against brute force and its SQL twin; the bounds against exact scores."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from panelspark.llm import lexical, oracles
from panelspark.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, rank int, score double"


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) by plain counting."""
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs if d is not None]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x for *_, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, size in counted:
            m = 100 - 50 + (50 * size * n) // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t]), d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out)


def got(made):
    return sorted(tuple(r) for r in made.select("item_id", "rank", "doc_id", "score").collect())


def test_given_tables_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    made = lexical.ranked_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert got(made) == sorted(con.execute(oracles.LEXICAL_SEARCH).fetchall())


def frames(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "日本語", "ab1", "X_y", "don't"]
    draw = lambda n: " ".join(rng.choice(words, n))
    docs = [(k, draw(int(rng.integers(1, 80)))) for k in range(120)] + [(k, "w1 w2 W3") for k in range(200, 290)]
    docs += [(500, None), (501, ""), (502, " .,;\n"), (503, "w1 " * 60_000 + draw(50)), (504, draw(20)), (504, draw(20)), (505, "w5 w6"), (505, "w5 w6"), (None, "w1 w2")]
    items = [(1, "w1 w2 w3"), (2, draw(30)), (3, None), (4, "unseen word"), (5, "W1!w1"), (6, draw(5)), (6, draw(5)), (7, "日本語 ünï"), (None, "w1"), (8, "w5 w6"), (8, "w5 w6")]
    return (spark.createDataFrame([(d, t, "x", 1.0, 2) for d, t in docs], "doc_id bigint, text string, term string, score double, width int").repartition(3),
            spark.createDataFrame([(i, t, 0, 0.0) for i, t in items], ITEMS), docs, items)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_odd_documents_and_items(spark, k):
    docs, items, d, i = frames(spark)
    assert got(lexical.ranked_documents(docs, items, k)) == brute(d, i, k)


def test_narrow_signatures_and_item_blocks_do_not_change_the_result(spark, monkeypatch):
    docs, items, d, i = frames(spark)
    for name, value in (("BITS_PER_KEY", 1), ("BLOCK_DOCS", 8), ("PAIRS", 20), ("LEXICON", 10), ("SEEDS", 1)):
        monkeypatch.setattr(lexical, name, value)
    assert got(lexical.ranked_documents(docs, items, 5)) == brute(d, i, 5)


def test_bounds_are_never_too_low_and_exclude_most(spark, sf):
    docs = table(spark, sf, "documents")
    index = lexical.build_index(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    n_docs, n_terms = index.filter("slices IS NOT NULL").agg({"n_docs": "sum", "n_terms": "sum"}).select("sum(n_docs)", "sum(n_terms)").first()
    df = {bytes(r.term): r.df for r in index.filter("term IS NOT NULL").groupBy("term").agg({"df": "sum"}).toDF("term", "df").collect()}
    row = type("Row", (), {})
    found = []
    for item in table(spark, sf, "benchmark").limit(8).collect():
        for t in set(lexical.terms(item.text)) & df.keys():
            r = row()
            r.item_id, r.term, r.df = item.item_id, t, df[t]
            found.append(r)
    queries = lexical.Queries(found, n_docs, n_terms)
    over = 0
    for block in index.filter("slices IS NOT NULL").collect():
        ids, n = np.frombuffer(block.doc_ids, "<i8"), np.frombuffer(block.counts, "<i8")
        bounds = queries.bounds(block.width, n, np.frombuffer(block.slices, np.uint8).reshape(1 << block.width, -1))
        exact = np.array([queries.score(texts[d], list(range(len(queries.items)))) for d in ids.tolist()]).T
        assert (bounds >= exact).all()
        over += int((bounds > 1.2 * exact + 1).sum())
    assert over < 0.1 * len(texts) * len(queries.items)


def test_empty(spark):
    docs, items, *_ = frames(spark)
    assert lexical.ranked_documents(docs.limit(0), items).count() == 0
    assert lexical.ranked_documents(docs, items.limit(0)).count() == 0
