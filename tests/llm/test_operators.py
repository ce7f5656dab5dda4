"""Each operator against brute force, a round trip or the library it stands for, on ordinary and on odd documents."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from cases import empty_documents, odd_documents, prose  # noqa: E402

from panelspark.llm import ann, bpe, langid, media, packing, quality, simhash, substrings, token_output, toxicity, word_tokens  # noqa: E402
from panelspark.llm.common import table  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both(spark, sf):
    return [table(spark, sf, "documents"), odd_documents(spark)]


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 5000])
@pytest.mark.parametrize("most", [1, 255, 49_407, (1 << 60) - 1, (1 << 64) - 1])
def test_simple8b_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64, endpoint=True)
    payload = token_output.pack(ids)
    assert (token_output.unpack(payload) == ids).all()
    assert (token_output.unpack(payload, n // 3, 2 * n // 3) == ids[n // 3:2 * n // 3]).all()


def test_token_files(both):
    library = Tokenizer.from_file(WORD)
    for docs in both:
        got = sorted(tuple(r) for r in token_output.read_tokens(token_output.write_tokens(docs, WORD, 1)).collect())
        ids = [(d, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")) for d, t in texts(docs)]
        want = sorted((d, len(i), zlib.crc32(i.tobytes())) for d, i in ids)
        assert [(d, n, c) for d, _, n, c in got] == want
        assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, n, _ in want)])[:-1].tolist()


def test_bpe_as_the_library(both):
    library = Tokenizer.from_file(BYTE)
    for docs in both:
        got = sorted(tuple(r) for r in bpe.digests(docs, BYTE).collect())
        want = []
        for d, t in texts(docs):
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert got == sorted(want)
    encoded = bpe.encode_documents(both[1], BYTE)
    assert sorted((r.doc_id, r.text) for r in bpe.decode_documents(encoded, BYTE).collect()) == sorted(texts(both[1]))


def roots(names, linked):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    for lanes, distance in ((1, 2), (4, 40)):
        base = rng.integers(0, 1 << 64, (20, lanes), dtype=np.uint64)
        fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, base.shape, dtype=np.uint64)) for _ in range(12)]), axis=0)
        index = simhash.GrayIndex(fps, simhash._words(0, lanes))
        got = sum(len(i) for i, _, _ in index.pairs(distance, 64))
        gaps = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=-1)
        assert got == (np.triu(gaps <= distance, 1)).sum() > 0


def test_linked_documents(both):
    for docs in both:
        prints = {d: simhash.fingerprint(t, 3).hex() for d, t in texts(docs)}
        codes = {d: int.from_bytes(bytes.fromhex(p), "little") for d, p in prints.items()}
        names = sorted(codes)
        root = roots(names, [(a, b) for a in names for b in names if a < b and (codes[a] ^ codes[b]).bit_count() <= 2])
        got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.linked_documents(docs).collect()}
        assert got == {(d, format(codes[d], "016x"), root[d]) for d in names}


def test_hot_shards_lose_no_link(spark, monkeypatch):
    """With tiny shards every node is refined, and the links stay."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    monkeypatch.setattr(simhash, "SHARD_MOST", 10)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    codes = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))})
    fps = spark.createDataFrame([(c.to_bytes(8, "little"),) for c in codes], "fp binary")
    edges = [(r.u, r.v) for r in simhash._exact_edges(fps, 2).collect()]
    want = roots(codes, [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2])
    assert len(set(roots(codes, edges).values())) == len(set(want.values()))


def test_near_duplicates(both):
    for docs in both:
        sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in texts(docs)}
        names = sorted(sets)
        close = [(a, b) for a in names for b in names if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
        assert got == set(roots(names, close).items())


def repeats_removed(docs, window=50):
    first = {}
    for d, t in sorted(texts(docs)):
        words = t.encode().split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i:i + window]), d)
    out = []
    for d, t in texts(docs):
        words = t.encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(both):
    for docs in both:
        got = sorted(tuple(r) for r in substrings.digests(docs).collect())
        assert got == repeats_removed(docs) and any(r[2] for r in got)


def test_full_bit_table_changes_nothing(both):
    """A tiny table passes every probe."""
    got = substrings.cleaned(both[1].select("doc_id", "text"), filter_bits=6).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(d, n) for d, _, n, _ in repeats_removed(both[1])]


def test_media_round_trip(both):
    for docs in both:
        got = {tuple(r)[:5] for r in media.media_digests(media.write_media(docs)).collect()}
        want = set()
        for d, t in texts(docs):
            raw = t.encode()
            data = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
            want.add((d, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])))
        assert got == want


def test_media_columns(spark):
    data = bytes(576 * 200)
    whole = media.build(data)
    files = spark.createDataFrame([(1, whole), (2, whole[:700]), (3, b""), (4, None)], "id int, media binary")
    got = {r.id: r.description for r in media.media_columns(files).collect()}
    assert got[1].samples == 200 and got[1].codec == "raw " and got[1].seconds == 576 * 200 / 48_000 and got[1].error is None
    assert [(k.offset - got[1].keyframes[0].offset, k.length) for k in got[1].keyframes] == [(576 * 16 * i, 576) for i in range(13)]
    assert got[2].error and got[3].error and got[2].samples is None and got[4] is None


def test_toxicity_held_out(spark, sf, both):
    sf = sf.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    rows = toxicity.classify(table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    odd = toxicity.classify(both[1], labels).collect()
    assert len(odd) == both[1].count() and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.classify(both[1], labels.limit(0)).collect()
    assert {r.score for r in none} == {float(toxicity.sigmoid(-500.0))}


def test_counterfactual_penalty(spark):
    """One group is named more often in toxic texts; the penalty takes the weight off its name."""
    rows = []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if i % 10 < (8 if toxic else 1) else "christians"
        rows.append((i, f"the {group} live here {'scum' if toxic and i % 5 else 'garden'} {prose(i, 5)}", toxic))
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    free, held = toxicity.fit(labelled, labelled, fairness=0.0), toxicity.fit(labelled, labelled, fairness=10.0)
    pair = ["muslims live here", "christians live here"]
    gap = [abs(np.subtract(*toxicity.score_texts(pair, *m))) for m in (free, held)]
    assert gap[1] < 0.5 * gap[0]
    assert toxicity.score_texts(["scum"], *held)[0] > 0.7


def test_quality_held_out(spark, sf, both):
    sf = sf.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    rows = quality.select_documents(table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([r.expected_grade for r in rows if r.quality and not r.toxic]) > np.mean([r.expected_grade for r in rows if not r.quality])
    assert quality.select_documents(both[1], labels).count() == both[1].count()
    four = spark.createDataFrame([(i, prose(i, 9), i % 4) for i in range(80)], "doc_id bigint, text string, grade int")
    thresholds, _ = quality.fit(four, four)
    assert len(thresholds) == 3 and thresholds == sorted(thresholds)


def brute(vectors, queries, k):
    good = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if r.embedding and None not in r.embedding
            and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    out = {}
    for q in (r.vec_id for r in queries.collect()):
        if q in good:
            near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = near[:k]
    return out


def test_nearest_recall(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 10 = 0")
    want, got = brute(vectors, queries, 10), {}
    for r in ann.nearest(vectors, queries, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(len(g) == 10 for g in got.values()) and got.keys() == want.keys()
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95


def test_nearest_odd_vectors(spark):
    rows = [(0, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, 1.0]), (7, [1.0]), (8, []), (9, [float("inf"), 1.0])]
    rows += [(i, [5.0, 5.0]) for i in range(20, 60)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = brute(vectors, vectors, 10)
    got = {}
    for r in ann.nearest(vectors, vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == {q: w for q, w in want.items() if w}
    assert ann.nearest(vectors.limit(0), vectors).count() == 0


def test_language_held_out(spark, sf, both):
    sf = sf.replace("0.001", "0.01")
    docs = table(spark, sf, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.identify(both[1]).collect()}
    assert {d for d, lang in odd.items() if lang == "und"} == {0, 1, 2, 4} and odd[5] == "en"


def test_best_fit_order():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]


def test_packing(both):
    library = Tokenizer.from_file(WORD)
    for docs in both:
        got = packing.pack_documents(docs, WORD, capacity=256).toPandas()
        want = []
        for d, t in texts(docs):
            ids = [*library.encode(t, add_special_tokens=False).ids, 1]
            want += [(d, k, k * 256, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[a:a + 256] for a in range(0, len(ids), 256))]
        assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
        for _, held in got.sort_values("offset").groupby("sequence_id"):
            assert held.length.sum() <= 256 and (held.length.cumsum() - held.length).tolist() == held.offset.tolist()
        assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 256 + 1


def test_empty_tables(spark, sf):
    docs, labels = empty_documents(spark), table(spark, sf, "labels")
    for made in (token_output.read_tokens(token_output.write_tokens(docs, WORD, 1)), bpe.digests(docs, BYTE), simhash.linked_documents(docs), simhash.near_duplicates(docs),
                 substrings.digests(docs), media.media_digests(media.write_media(docs)), toxicity.classify(docs, labels), quality.select_documents(docs, labels),
                 langid.identify(docs), packing.pack_documents(docs, WORD)):
        assert made.count() == 0


def test_word_coder_forgets_only_words_that_do_not_come_back():
    """Ids are the library's whatever the remembered words; a word of every batch is learned once, though the memory is full."""
    library = Tokenizer.from_file(WORD)
    encoder = word_tokens.WordCoder(WORD, limit=40)
    learned, learn = [], encoder._learn
    encoder._learn = lambda words: (learned.extend(words), learn(words))[1]
    for k in range(12):
        batch = [f"always Always. (always) \x0b w{k}x\t" + " ".join(f"n{k}q{i}" for i in range(15)), "", " \r\n", "Stéa, İx ǅ é  y", f"{k}"]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
        assert encoder.encode(batch) == want
    assert learned.count(b"always") <= 1 and learned.count(b"(always)") == 1
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]
