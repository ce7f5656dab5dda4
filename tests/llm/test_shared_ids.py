"""Substring dedup of different texts under one doc_id, null doc_ids and texts longer than a task's part."""

from panelspark.llm import substrings
from panelspark.llm.common import TASK_CHARS


def words(prefix, n):
    return " ".join(f"{prefix}{k}" for k in range(n))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, -1) for r in rows], "doc_id bigint, text string, n_words int")
    return sorted(((r.doc_id, r.text, r.n_removed, r.kept) for r in substrings.cleaned(docs).collect()), key=str)


def test_each_text_loses_only_its_own_repeats(spark):
    x, y = words("x", 60), words("y", 60)
    assert found(spark, [(1, x), (5, x), (5, y)]) == sorted([(1, x, 0, x), (5, x, 60, ""), (5, y, 0, y)], key=str)


def test_a_shorter_text_under_the_same_id(spark):
    x, p, y = words("x", 80), words("p", 500), words("y", 60)
    short = "only three words"
    want = [(1, x, 0, x), (5, f"{p} {x}", 80, p), (5, y, 0, y), (5, short, 0, short)]
    assert found(spark, [(1, x), (5, f"{p} {x}"), (5, y), (5, short)]) == sorted(want, key=str)


def test_null_ids_come_last(spark):
    x = words("x", 60)
    assert found(spark, [(None, x), (9, x), (None, None)]) == sorted([(9, x, 0, x), (None, x, 60, ""), (None, None, 0, "")], key=str)


def test_texts_longer_than_a_part(spark):
    long = words("word", 150_000)
    assert len(long) > TASK_CHARS
    tail = " ".join(long.split()[-70:])
    got = {r[0]: (r[2], len(r[3].split())) for r in found(spark, [(1, long), (2, f"own {tail} end"), (3, long)])}
    assert got == {1: (0, 150_000), 2: (70, 2), 3: (150_000, 0)}
