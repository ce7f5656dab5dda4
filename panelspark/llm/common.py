"""What the operators share: table access, durable intermediates, document batches, whole-text words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelspark.session import checkpoint_dir

TASK_CHARS = 1_000_000
_held: dict[str, list[dict]] = {}
_active = ""


def remembered(group: str, cache: dict) -> dict:
    """Register what a Python worker remembers for a group of functions."""
    _held.setdefault(group, []).append(cache)
    return cache


def activate(group: str) -> None:
    """Workers are reused from stage to stage: when another group starts, what the others remember is dropped."""
    global _active
    if group != _active:
        for caches in (c for g, c in _held.items() if g != group):
            for cache in caches:
                cache.clear()
        _active = group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and continue from the files (survives lost executors)."""
    path = f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(of: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``of``: the fold of a row."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def documents(batches: Iterator[pa.RecordBatch], chars: int = TASK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the incoming batches, of about ``chars`` bytes of text, with their texts (null: empty)."""
    for batch in batches:
        column = batch.column("text")
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends = np.cumsum(lengths) // chars
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, [t or "" for t in part.column("text").to_pylist()]


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def annotated(docs: DataFrame, each: Callable[[list[str]], list[tuple]], ddl: str) -> DataFrame:
    """``docs`` with the columns of ``ddl`` added, ``each`` giving one tuple per text; a column of the same name is replaced."""
    added = T.StructType.fromDDL(ddl)
    names = [c for c in docs.columns if c not in added.names]
    schema = T.StructType([*(docs.schema[c] for c in names), *added.fields])
    kinds = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            out = batch.select(names)
            for field, values in zip(kinds, zip(*each(texts))):
                out = out.append_column(field.name, pa.array(values, field.type))
            yield out

    return docs.mapInArrow(run, schema)
