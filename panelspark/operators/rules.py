"""Rules as data: validate a catalogue, evaluate all of it in one pass, emit the triggering values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import catalogue
from ..functions.core import holds


class RuleError(ValueError):
    """A catalogue entry that cannot be used."""


@dataclass(frozen=True)
class Rule:
    name: str
    expr: str
    title: str = ""
    description: str = ""
    horizon: str = ""
    origin: str = ""
    why: str = ""
    manage: str = ""
    min_turnover: float = 1e7
    min_price: float = 20.0
    min_history: int = 200
    emit: tuple[str, ...] = ()
    sort_by: str | None = None
    ascending: bool = False

    @classmethod
    def from_dict(cls, entry: dict) -> "Rule":
        unknown = sorted(set(entry) - {f.name for f in fields(cls)})
        if unknown:
            raise RuleError(f"unknown rule keys {unknown}")
        for required in ("name", "expr"):
            if not str(entry.get(required) or "").strip():
                raise RuleError(f"a rule needs {required}")
        values = dict(entry)
        values["expr"] = " ".join(str(entry["expr"]).split())
        values["emit"] = tuple(entry.get("emit") or ())
        return cls(**values)

    @property
    def columns(self) -> set[str]:
        """Identifiers the rule reads (expression, ordering and emitted values)."""
        words = set(re.findall(r"[A-Za-z_]\w*", self.expr)) - {"and", "or", "not"}
        return words | set(self.emit) | ({self.sort_by} if self.sort_by else set())


def load_rules(entries: Iterable[dict] | None = None) -> list[Rule]:
    rules = [Rule.from_dict(e) for e in (catalogue.RULES if entries is None else entries)]
    names = [r.name for r in rules]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise RuleError(f"duplicate rule names {doubled}")
    return rules


def check_rules(panel: DataFrame, rules: Sequence[Rule]) -> None:
    """Every expression must resolve against ``panel`` and be boolean (analysis only, no job)."""
    for rule in rules:
        kind = panel.select(F.expr(rule.expr).alias("x")).schema["x"].dataType
        if not isinstance(kind, T.BooleanType):
            raise RuleError(f"rule {rule.name}: expression is not boolean")


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The catalogue as rows, with its exit family."""
    family = {n: f for f, names in catalogue.FAMILY.items() for n in names}
    rows = [(r.name, r.expr, list(r.emit), r.sort_by, r.ascending, float(r.min_turnover), float(r.min_price),
             int(r.min_history), family.get(r.name, "watchlist")) for r in rules]
    return spark.createDataFrame(rows, "rule string, expr string, emit array<string>, sort_by string, ascending boolean, "
                                       "min_turnover double, min_price double, min_history int, family string")


def eligible(rule: Rule, panel: DataFrame) -> Column:
    """Liquidity, price and history floors; contaminated rows never qualify."""
    price = F.coalesce(*[F.col(n) for n in ("close", "adj_close") if n in panel.columns], F.lit(0.0))
    ok = (F.coalesce(F.col("turnover_median_20d"), F.lit(0.0)) >= float(rule.min_turnover)) & (price >= float(rule.min_price))
    if "bars_available" in panel.columns:
        ok = ok & (F.coalesce(F.col("bars_available"), F.lit(0)) >= int(rule.min_history))
    if "contaminated" in panel.columns:
        ok = ok & ~F.coalesce(F.col("contaminated").cast("boolean"), F.lit(False))
    return ok


def hits(panel: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("isin", "date"), apply_floors: bool = True,
         emit: bool = True) -> DataFrame:
    """Every (row, rule) that fired, one scan for the whole catalogue.

    Each row builds an array with one entry per rule (null when it did not fire); exploding the compacted
    array yields rows only for hits. ``score`` orders a rule's hits (higher first).
    """
    entries = []
    for rule in rules:
        fired = holds(F.expr(rule.expr))
        if apply_floors:
            fired = fired & eligible(rule, panel)
        order = F.col(rule.sort_by).cast("double") if rule.sort_by in panel.columns else F.lit(None).cast("double")
        score = -order if rule.ascending else order
        values = [x for x in rule.emit if x in panel.columns]
        emitted = (F.map_from_arrays(F.array(*[F.lit(x) for x in values]), F.array(*[F.col(x).cast("double") for x in values]))
                   if emit and values else F.lit(None).cast("map<string,double>"))
        entries.append(F.when(fired, F.struct(F.lit(rule.name).alias("rule"), score.alias("score"), emitted.alias("emit"))))
    exploded = panel.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("__h"))
    return exploded.select(*keep, "__h.rule", "__h.score", "__h.emit")


def latest_hits(panel: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Hits on the panel's newest session, sorted by rule and then by the rule's own ordering."""
    newest = panel.agg(F.max("date").alias("__new"))
    latest = panel.join(F.broadcast(newest), F.col("date") == F.col("__new"), "left_semi")
    return hits(latest, rules).orderBy("rule", F.col("score").desc_nulls_last(), "isin")


def floors(rules: Sequence[Rule], **changes) -> list[Rule]:
    """The same rules with other eligibility floors (a small universe needs lower ones)."""
    return [replace(r, **changes) for r in rules]


def expand_templates(templates: dict[str, str], p: Sequence[float], q: Sequence[float]) -> list[Rule]:
    """Rule templates with ``{p}`` and ``{q}`` over a parameter grid; a template without q is not repeated."""
    out = {}
    for name, text in templates.items():
        for a in p:
            for b in q if "{q}" in text else [None]:
                key = f"{name}|{a:g}" + (f"|{b:g}" if b is not None else "")
                out[key] = Rule(key, text.replace("{p}", f"{a:g}").replace("{q}", f"{b:g}" if b is not None else ""))
    return list(out.values())


def variants(base: Rule, clauses: dict[str, str]) -> list[Rule]:
    """``(base) and (clause)`` for each named clause, plus the base itself."""
    out = [replace(base, name=f"{base.name}|base")]
    return out + [replace(base, name=f"{base.name}|{n}", expr=f"({base.expr}) and ({c})") for n, c in clauses.items()]
