"""Operator 11 [native]: personal data by candidate generation and gradient-boosted trees.

Everything that touches rows is a DataFrame expression: no Python runs on the executors. The steps of one row:

1. base rules: the plain patterns of each kind, checked (parts of an address, Luhn, digits). Their spans always stay.
2. generators: looser patterns per kind over the text with that kind's base spans blanked out: obfuscated or non-ASCII addresses, spaced
   or defanged IPs, and numbers cut at their own borders where the plain rule swallowed a neighbour. Kinds overlap.
3. features of a candidate: number of digits (or characters of the local part), groups, separator, whether it is well formed,
   the characters around it, a cue word in the 24 characters before it. All are small integers.
4. boosted trees, written as CASE expressions, score it; a span is added where the score reaches its kind's threshold and base
   spans of the fit show its format (separator and number of groups), as trees say nothing about what they never met.

Training counts candidates by their feature values, with partial aggregation over all rows: base spans are the positive ones, loose
candidates count as negative though some are personal data (learning from positive and unlabelled cases). The table of counts
has at most ``PATTERNS`` rows whatever the corpus, and the trees are fitted to it on the driver. Documents with
crc32(doc_id) % 5 = 0 stay out of the fit: on them the scores are calibrated (monotone shares of positive ones), and the threshold
is the least score calibrated to ``PRECISION`` or more. A kind without such a score adds nothing.

Null text is empty. Offsets are code points, ends exclusive. Every row stands for itself, so repeated rows, shared or null doc_ids and
other columns change nothing (a null doc_id counts for the fit). Patterns take a run of characters once, so long texts cost
their length. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
FEATURES = {"n": 21, "groups": 8, "sep": 6, "ok": 2, "before": 4, "after": 4, "cue": 2}  # name: number of values, from 0
PATTERNS = len(KINDS) * math.prod(FEATURES.values())
ROUNDS, RATE, DEPTH, SHRINK = 20, 0.4, 2, 1.0
PRECISION = 0.9
HELD_OUT = 5
_BLANK = "￼"
_CONTEXT = 24

# The plain rules. Possessive, and only started where a run starts, as a later start in it would fail or match alike.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64} ?(?:@|＠|[(\[{]at[)\]}]) ?[\p{L}\p{N}-]{1,63}(?:(?:\.| ?[(\[{](?:dot|\.)[)\]}] ?)[\p{L}\p{N}-]{1,63})*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([ ._-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ ._-])[0-9]{6}\2[0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4}|[0-9]{7,15}+)(?![0-9])",
}
# what a text must have for a pattern to be tried
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"[@＠]|[(\[{]at[)\]}]", "ip": r"[0-9][^0-9]+[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9]{2}"}
CUES = {
    "email": r"(?i)mail|correo|contact|kontakt|courriel|write|schreib",
    "ip": r"(?i)\bip\b|host|server|addr|client|serveur|servidor",
    "card": r"(?i)card|visa|master|amex|karte|carte|tarjeta|paid|credit",
    "phone": r"(?i)tel|phone|fax|call|mobil|anruf|llam|appel|whatsapp",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _q(text: str) -> str:
    return f"r'{text}'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = f"lpad({_digits(x)}, 20, '0')"
    doubled = f"translate({d}, '0123456789', '0246813579')"
    return f"aggregate(sequence(1, 20), 0, (a, i) -> a + cast(substring(IF(i % 2 = 1, {doubled}, {d}), i, 1) AS int)) % 10 = 0"


def _well_formed(kind: str, x: str) -> str:
    """Whether a match of a kind passes its check."""
    n = f"length({_digits(x)})"
    return {"email": f"{x} RLIKE " + _q(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++$"),
            "ip": f"{x} RLIKE " + _q(rf"^(?:{_PART}\.){{3}}{_PART}$"),
            "card": f"{n} BETWEEN 14 AND 19 AND {_luhn(x)}", "phone": f"{n} BETWEEN 10 AND 15"}[kind]


def _plain(kind: str, x: str) -> str:
    """A candidate's text without obfuscation."""
    if kind == "email":
        return "regexp_replace(regexp_replace(" + x + ", " + _q(r" ?(?:＠|[(\[{]at[)\]}]) ?| ?@ ?") + ", '@'), " + _q(r" ?[(\[{](?:dot|\.)[)\]}] ?") + ", '.')"
    if kind == "ip":
        return f"regexp_replace({x}, " + _q(r"[ \[\]()]+") + ", '')"
    return x


def _matches(df: DataFrame, kind: str, text: str, pattern: str, needs: str, out: str) -> DataFrame:
    """``df`` with ``out``: start, end, match, the characters before and after of each match; ``out``_pieces lies between them.

    The pieces between matches and the matches give the offsets as running sums, taken over blocks of 256 so that a text
    with very many matches costs no square of them.
    """
    none = "cast(array() AS array<string>)"
    found, pieces, steps, sums, at = (f"{out}_{c}" for c in ("found", "pieces", "steps", "sums", "at"))
    df = df.withColumn("_tried", F.expr(f"{text} RLIKE {_q(needs)}"))
    df = df.withColumns({found: F.expr(f"IF(_tried, regexp_extract_all({text}, {_q(pattern)}, 0), {none})"),
                         pieces: F.expr(f"IF(_tried, split({text}, {_q(pattern)}, -1), {none})")})
    df = df.withColumn(steps, F.expr(f"transform({found}, (m, i) -> cast(length({pieces}[i]) + length(m) AS bigint))"))
    add = "0L, (a, x) -> a + x"
    df = df.withColumn(sums, F.expr(f"transform(sequence(0, greatest(size({steps}) - 1, 0) div 256), b -> aggregate(slice({steps}, cast(b * 256 + 1 AS int), 256), {add}))"))
    df = df.withColumn(at, F.expr(f"transform({sums}, (s, b) -> aggregate(slice({sums}, 1, b), {add}))"))
    end = f"{at}[i div 256] + aggregate(slice({steps}, cast(i div 256 AS int) * 256 + 1, i % 256 + 1), {add})"
    df = df.withColumn(f"{out}_ends", F.expr(f"transform({found}, (m, i) -> {end})"))
    made = (f"transform({found}, (m, i) -> named_struct('start', {out}_ends[i] - length(m), 'end', {out}_ends[i], 'text', m, "
            f"'before', right({pieces}[i], {_CONTEXT}), 'after', left({pieces}[i + 1], 1)))")
    return df.withColumn(out, F.expr(made)).drop("_tried", steps, sums, at, f"{out}_ends")


def _features(kind: str, spans: str) -> Column:
    """An array of the feature values of the spans."""
    x, plain = "x.text", _plain(kind, "x.text")
    around = lambda c: f"CASE WHEN {c} = '' OR {c} RLIKE r'\\s' THEN 0 WHEN {c} RLIKE r'\\p{{L}}' THEN 2 WHEN {c} RLIKE '[0-9{_BLANK}]' THEN 3 ELSE 1 END"
    if kind == "email":
        host = f"substring_index({plain}, '@', -1)"
        n, groups = f"length(substring_index({plain}, '@', 1))", f"regexp_count({host}, " + _q(r"\.") + ")"
        sep = f"CASE WHEN {host} RLIKE " + _q(r"\.\p{L}{2,}$") + " THEN 0 ELSE 1 END"
    else:
        n, groups = f"length({_digits(x)})", f"regexp_count({x}, '[0-9]+')"
        kinds = ((r"^[0-9]+$", 0), (r"[()]", 4), (r"^[0-9 +]+$", 1), (r"^[0-9+-]+$", 2), (r"^[0-9.+]+$", 3))
        sep = "CASE " + " ".join(f"WHEN {plain} RLIKE {_q(p)} THEN {v}" for p, v in kinds) + " ELSE 5 END"
    return F.expr(
        f"transform({spans}, x -> named_struct('n', least({n}, {FEATURES['n'] - 1}), 'groups', least({groups}, {FEATURES['groups'] - 1}), 'sep', {sep}, "
        f"'ok', int({_well_formed(kind, plain)}), 'before', {around('right(x.before, 1)')}, 'after', {around('x.after')}, 'cue', int(x.before RLIKE {_q(CUES[kind])})))")


def _candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with, per kind, ``_base_k`` and ``_loose_k`` (spans) beside the columns it had."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        base, loose = f"_base_{kind}", f"_loose_{kind}"
        df = _matches(df, kind, "_text", BASE[kind], NEEDS[kind], base)
        check = "true" if kind == "email" else _well_formed(kind, "m")
        df = df.withColumn("_valid", F.expr(f"transform({base}_found, m -> {check})"))
        blanked = (f"array_join(transform({base}_pieces, (p, i) -> IF(i >= size(_valid), p, concat(p, IF(get(_valid, i), "
                   f"repeat('{_BLANK}', length(get({base}_found, i))), get({base}_found, i))))), '')")
        df = df.withColumn("_rest", F.expr(f"IF(exists(_valid, v -> v), {blanked}, _text)"))
        df = df.withColumn(base, F.expr(f"filter({base}, (x, i) -> _valid[i])")).drop("_valid", f"{base}_found", f"{base}_pieces")
        df = _matches(df, kind, "_rest", LOOSE[kind], LOOSE_NEEDS[kind], loose).drop("_rest", f"{loose}_found", f"{loose}_pieces")
    return df


@dataclass
class Tree:
    """A split on ``feature`` <= ``at``, or a leaf."""
    value: float = 0.0
    feature: str = ""
    at: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self, x: str) -> str:
        if self.low is None or self.high is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {x}.{self.feature} <= {self.at} THEN {self.low.sql(x)} ELSE {self.high.sql(x)} END"

    def score(self, held: dict[str, np.ndarray]) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(held["n"]), self.value)
        return np.where(held[self.feature] <= self.at, self.low.score(held), self.high.score(held))


@dataclass
class Model:
    trees: dict[str, list[Tree]] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)
    formats: dict[str, list[int]] = field(default_factory=dict)

    def score_sql(self, kind: str, x: str) -> str:
        if not self.trees.get(kind):
            return "0D"
        return "1D / (1D + exp(-(" + " + ".join(t.sql(x) for t in self.trees[kind]) + ")))"


def grow(held: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """A tree on the gradients ``g`` and curvatures ``h`` of weighted feature patterns."""
    leaf = Tree(float(-RATE * g.sum() / (h.sum() + SHRINK)))
    if not depth:
        return leaf
    best = (1e-9, "", 0)
    for name, size in FEATURES.items():
        low_g, low_h = (np.cumsum(np.bincount(held[name], w, size))[:-1] for w in (g, h))
        gain = low_g ** 2 / (low_h + SHRINK) + (g.sum() - low_g) ** 2 / (h.sum() - low_h + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
        at = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (float(gain[at]), name, at)
    _, name, at = best
    if not name:
        return leaf
    low = held[name] <= at
    part = lambda keep: grow({k: v[keep] for k, v in held.items()}, g[keep], h[keep], depth - 1)
    return Tree(feature=name, at=at, low=part(low), high=part(~low))


def boost(held: dict[str, np.ndarray], positive: np.ndarray, total: np.ndarray) -> list[Tree]:
    """Trees of the logistic loss over patterns that occur ``total`` times, ``positive`` of them positive."""
    share = (positive.sum() + 0.5) / (total.sum() + 1)
    trees = [Tree(float(np.log(share / (1 - share))))]
    raw = trees[0].score(held)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(held, total * p - positive, total * p * (1 - p), DEPTH))
        raw = raw + trees[-1].score(held)
    return trees


def calibrated_threshold(score: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """The least score whose calibrated share of positive ones (isotonic regression) reaches ``precision``; infinity if none does."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # least score, positive, total of a run of scores
    for s, p, t in zip(score[order].tolist(), positive[order].tolist(), total[order].tolist()):
        if pools and pools[-1][0] == s:
            pools[-1][1] += p
            pools[-1][2] += t
        else:
            pools.append([s, p, t])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, p, t = pools.pop()
            pools[-1][1] += p
            pools[-1][2] += t
    return next((s for s, p, t in pools if p >= precision * t), math.inf)


def fit(docs: DataFrame, precision: float = PRECISION) -> Model:
    """Trees and thresholds from the candidates of all documents."""
    made = _candidates(docs.select("doc_id", "text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False)).alias("held")
    each = [F.struct(F.lit(k).alias("kind"), F.lit(label).alias("label"), _features(kind, f"{name}_{kind}").alias("f"))
            for k, kind in enumerate(KINDS) for name, label in (("_base", 1), ("_loose", 0))]
    spans = made.select(held, F.explode(F.array(*each)).alias("e")).filter("size(e.f) > 0").select("held", "e.kind", "e.label", F.explode("e.f").alias("f"))
    counts = spans.groupBy("kind", "held", *(F.col(f"f.{n}").alias(n) for n in FEATURES)).agg(F.sum("label").alias("positive"), F.count("*").alias("total")).collect()
    model = Model()
    for k, kind in enumerate(KINDS):
        parts = [sorted((r for r in counts if r.kind == k and r.held == side), key=tuple) for side in (False, True)]
        (fit_on, y, n), (test_on, y2, n2) = (({f: np.array([r[f] for r in part], np.int64) for f in FEATURES},
                                              *(np.array([r[c] for r in part], float) for c in ("positive", "total"))) for part in parts)
        if y.sum() and y2.sum():
            model.trees[kind] = boost(fit_on, y, n)
            model.formats[kind] = np.unique((fit_on["sep"] * FEATURES["groups"] + fit_on["groups"])[y > 0]).tolist()
            raw = sum(t.score(test_on) for t in model.trees[kind])
            model.threshold[kind] = calibrated_threshold(1 / (1 + np.exp(-raw)), y2, n2, precision)
    return model


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``pii``: array of (start, kind, end, base, score) by start, then kind as in ``KINDS``, then end."""
    names = docs.columns
    made = _candidates(docs.select(F.struct("*").alias("_row"), "text"))
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(f"transform(_base_{kind}, x -> named_struct('start', x.start, 'kind', {k}, 'end', x.end, 'base', true, 'score', 1D))")
        at = model.threshold.get(kind, math.inf)
        if at < math.inf:
            made = made.withColumn(f"_f_{kind}", _features(kind, f"_loose_{kind}"))
            met = f"_f_{kind}[i].sep * {FEATURES['groups']} + _f_{kind}[i].groups IN ({', '.join(map(str, model.formats[kind]))})"
            scored = f"transform(_loose_{kind}, (x, i) -> named_struct('start', x.start, 'kind', {k}, 'end', x.end, 'base', false, 'score', IF({met}, {model.score_sql(kind, f'_f_{kind}[i]')}, 0D)))"
            parts.append(f"filter({scored}, x -> x.score >= {at - 1e-9!r}D)")
    spans = made.select("_row", F.expr(f"sort_array(concat({', '.join(parts)}))").alias("pii"))
    return spans.select(*(F.col("_row").getField(n).alias(n) for n in names if n != "pii"), "pii")


def _joined(spans: str) -> str:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({kinds}[x.kind], ':', x.start, ':', x.end)), ',')"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    found = detect(docs.select("doc_id", "text"), fit(docs)).withColumn("base", F.expr("filter(pii, x -> x.base)"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS bigint) AS n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("pii")).alias("spans"),
                        F.expr("cast(size(pii) - size(base) AS bigint) AS n_added"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [email], [ip], [card] or [phone] (the last where spans overlap)."""
    marks = [chr(0xFDD0 + k) for k in range(len(KINDS))]  # noncharacters; a text's own become U+FFFD
    made = detect(docs.select(F.struct("*").alias("_own"), "text"), model).withColumn("_t", F.translate("text", "".join(marks), "�" * len(marks)))
    for k, mark in enumerate(marks):
        made = made.withColumn("_s", F.expr(f"filter(pii, x -> x.kind = {k})"))
        from_, ends = "IF(i = 0, 0L, get(_s, i - 1).end)", "IF(size(_s) = 0, 0L, element_at(_s, -1).end)"
        parts = f"transform(_s, (x, i) -> concat(substring(_t, cast({from_} + 1 AS int), cast(x.start - {from_} AS int)), repeat('{mark}', cast(x.end - x.start AS int))))"
        made = made.withColumn("_t", F.expr(f"IF(size(_s) = 0, _t, concat(array_join({parts}, ''), substring(_t, cast({ends} + 1 AS int))))"))
    for kind, mark in zip(KINDS, marks):
        made = made.withColumn("_t", F.regexp_replace("_t", f"{mark}+", f"[{kind}]"))
    return made.select(*(F.col("_t").alias(c) if c == "text" else F.col("_own").getField(c).alias(c) for c in docs.columns))
