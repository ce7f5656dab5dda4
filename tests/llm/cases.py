"""Documents that every operator must take: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, component_id bigint, start bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_documents(spark):
    shared = prose(1, 70)
    texts = [None, "", "   \n", "short", "1234 !!", prose(2, 120), prose(2, 120), f"{prose(3, 60)} {shared} {prose(4, 30)}", f"{prose(5, 33)}\n{shared} x", shared,
             prose(6, 6000), prose(7, 200), prose(7, 200).replace(" ", "  ", 5), prose(7, 200) + " tail", "<|endoftext|> é ́ <|startoftext|>", "Ünïcode 日本語 ²³ don't"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 9.0, -1, -5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[0]], SCHEMA)  # two rows repeated


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
