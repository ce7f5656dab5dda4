"""Operator 5: media columns of ISO base media files.

``describe`` walks the nested boxes of a file, decodes the sample tables of its first track and returns codec, duration and the
byte ranges of the keyframes; payload bytes are never decoded. ``build`` writes bytes as the fixed-size 8-bit samples of
a one-track file and ``payload`` reads them back through the tables. Broken files give a row whose ``error`` says why and
whose other fields are null; null media gives null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from panelspark.llm.common import documents, rows, store

SAMPLE = 576
RATE = 48_000
KEY_EVERY = 16  # a keyframe every so many samples
CHUNK_SAMPLES = 64
# Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}

DESCRIPTION = "struct<codec:string, timescale:bigint, duration:bigint, seconds:double, samples:bigint, keyframes:array<struct<offset:bigint, length:bigint>>, error:string>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def build(data: bytes) -> bytes:
    """A file whose samples are ``data`` in parts of ``SAMPLE`` bytes (its length a multiple of that)."""
    n = len(data) // SAMPLE
    if n * SAMPLE != len(data):
        raise ValueError("whole samples only")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    duration = n * SAMPLE
    chunks = -(-n // CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES)] if chunks > 1 else []
    if chunks and n - (chunks - 1) * CHUNK_SAMPLES != (runs and CHUNK_SAMPLES):
        runs.append((chunks, n - (chunks - 1) * CHUNK_SAMPLES))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, n + 1, KEY_EVERY)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE
        table = box(b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
                    _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
                    _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, k, 1) for c, k in runs)),
                    _full(b"stsz", struct.pack(">II", SAMPLE, n)), _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()))
        media = box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)),
                    box(b"minf", _full(b"smhd", bytes(4)), box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table))
        track = box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(16), matrix, bytes(8), flags=7), media)
        return box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, duration, 1 << 16, 1 << 8), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)

    body = len(head) + len(movie(0))
    return b"".join([head, movie(body + 16), struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)), data])


def boxes(data: memoryview, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, end) of the boxes in a range; sizes of 0 reach to its end, sizes of 1 are 64-bit."""
    while start < stop:
        if stop - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        end = stop if size == 0 else start + size
        if end > stop or end < body:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, body, end
        start = end


def _first(data: memoryview, start: int, stop: int, *path: bytes) -> tuple[int, int]:
    for kind, a, b in boxes(data, start, stop):
        if kind == path[0]:
            return _first(data, a, b, *path[1:]) if len(path) > 1 else (a, b)
    raise ValueError(f"no box {path[0]!r}")


def _tables(data: memoryview, start: int, stop: int, into: dict | None = None) -> dict[bytes, tuple[int, int]]:
    """The first box of each kind below a range."""
    into = {} if into is None else into
    for kind, a, b in boxes(data, start, stop):
        into.setdefault(kind, (a, b))
        if kind in CONTAINERS:
            _tables(data, a, b, into)
    return into


def samples(media: bytes) -> dict:
    """Codec, timescale, duration, and offset and length of every sample and the keyframes' places."""
    data = memoryview(media)
    found = _tables(data, *_first(data, 0, len(data), b"moov", b"trak"))

    def array(kind: bytes, form: str, skip: int, n: int) -> np.ndarray:
        a, b = found[kind]
        size = np.dtype(form).itemsize
        if n * size > b - a - skip:
            raise ValueError(f"table {kind!r} is cut off")
        return np.frombuffer(data, form, n, a + skip).astype(np.int64)

    def count(kind: bytes, at: int = 4) -> int:
        if kind not in found:
            raise ValueError(f"no box {kind!r}")
        return int(array(kind, ">u4", at, 1)[0])

    long = data[found[b"mdhd"][0]] == 1 if b"mdhd" in found else count(b"mdhd")
    timescale = count(b"mdhd", 20 if long else 12)
    codec = bytes(data[found[b"stsd"][0] + 12:][:4]).decode("latin-1") if count(b"stsd") else None
    times = array(b"stts", ">u4", 8, 2 * count(b"stts")).reshape(-1, 2)
    fixed, n = count(b"stsz"), count(b"stsz", 8)
    length = np.full(n, fixed, np.int64) if fixed else array(b"stsz", ">u4", 12, n)
    chunk_at = array(b"co64", ">u8", 8, count(b"co64")) if b"co64" in found else array(b"stco", ">u4", 8, count(b"stco"))
    runs = array(b"stsc", ">u4", 8, 3 * count(b"stsc")).reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1))) if len(runs) else np.zeros(0, np.int64)
    if per_chunk.sum() != n or times[:, 0].sum() != n:
        raise ValueError("the sample tables disagree")
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.cumsum(length) - length
    first = np.cumsum(per_chunk) - per_chunk
    offset = chunk_at[chunk] + before - (before[first[chunk]] if n else 0)
    if n and (offset + length).max() > len(data):
        raise ValueError("a sample lies outside the file")
    keys = array(b"stss", ">u4", 8, count(b"stss")) - 1 if b"stss" in found else np.arange(n)
    if len(keys) and not (0 <= keys.min() and keys.max() < n):
        raise ValueError("a keyframe is not a sample")
    return {"codec": codec, "timescale": timescale, "duration": int((times[:, 0] * times[:, 1]).sum()), "offset": offset, "length": length, "keys": keys}


def describe(media: bytes | None) -> dict | None:
    """The media columns of one file."""
    if media is None:
        return None
    nothing = dict.fromkeys(("codec", "timescale", "duration", "seconds", "samples", "keyframes"))
    try:
        s = samples(media)
    except (ValueError, KeyError, IndexError, struct.error) as problem:
        return nothing | {"error": str(problem) or type(problem).__name__}
    frames = [{"offset": a, "length": b} for a, b in zip(s["offset"][s["keys"]].tolist(), s["length"][s["keys"]].tolist())]
    return {"codec": s["codec"], "timescale": s["timescale"], "duration": s["duration"], "seconds": s["duration"] / s["timescale"] if s["timescale"] else None,
            "samples": len(s["offset"]), "keyframes": frames, "error": None}


def payload(media: bytes) -> bytes:
    """All sample bytes in order."""
    s = samples(media)
    ends = s["offset"] + s["length"]
    cuts = np.flatnonzero(np.append(s["offset"][1:] != ends[:-1], True)) if len(ends) else []
    starts = np.append(0, np.asarray(cuts[:-1], np.int64) + 1) if len(ends) else []
    return b"".join(media[int(s["offset"][a]):int(ends[b])] for a, b in zip(starts, cuts))


def media_columns(files: DataFrame, column: str = "media", to: str = "description") -> DataFrame:
    """Add the description of each file in a binary column; other columns stay."""
    schema = T.StructType([*files.schema.fields, *T.StructType.fromDDL(f"`{to}` {DESCRIPTION}").fields])
    kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("samples", pa.int64()),
                      ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(to, pa.array([describe(m) for m in batch.column(column).to_pylist()], kind))

    return files.mapInArrow(run, schema)


def write_media(docs: DataFrame) -> DataFrame:
    """Store every whole text (null: empty) as a media file; the table (doc_id, n_bytes, media) is in the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in documents(batches):
            raw = [t.encode() for t in texts]
            made = [build(b + b"\xff" * (-len(b) % SAMPLE or SAMPLE * (not b))) for b in raw]
            yield rows(schema, doc_id=batch.column("doc_id"), n_bytes=[len(b) for b in raw], media=made)

    return store(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media")


def feature(d: dict) -> str:
    """Codec, timescale, duration, samples and keyframes with a checksum of their byte ranges, as one line."""
    ranges = np.array([(k["offset"], k["length"]) for k in d["keyframes"]], "<i8")
    return f"{d['codec'].strip()}/{d['timescale']}/{d['duration']}/{d['samples']}/{len(ranges)}/{zlib.crc32(ranges.tobytes()):08x}"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digest columns from the stored files, read back through their sample tables."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names[2:]}
            for scalar in batch.column("media"):
                media = scalar.as_py()
                data = payload(media)
                for n, v in zip(out, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(describe(media)))):
                    out[n].append(v)
            yield rows(schema, doc_id=batch.column("doc_id"), n_bytes=batch.column("n_bytes"), **out)

    return stored.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
