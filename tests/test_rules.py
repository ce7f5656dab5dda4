import pytest
from frames import bars, path, walk
from pyspark.sql import functions as F

from panelspark import catalogue
from panelspark.operators import rules as ro
from panelspark.operators.features import build_features
from panelspark.plans.audit import fresh_signals
from panelspark.plans.screen import fresh_expressions, screen_panel

TREND = [100 * 1.0015 ** i for i in range(400)]


def names(spark, rows, *rules, **floors):
    chosen = ro.floors([r for r in ro.load_rules() if r.name in rules], **{"min_turnover": 0.0, **floors})
    panel = screen_panel(bars(spark, rows), chosen, extra=["r"])
    last = panel.agg(F.max("date")).first()[0]
    return {r.rule for r in ro.hits(panel.filter(F.col("date") == last), chosen).collect()}


def test_catalogue_is_complete_and_families_cover_it():
    rules = ro.load_rules()
    assert len(rules) == 41
    assert sorted(n for f in catalogue.FAMILY.values() for n in f) == sorted(r.name for r in rules)


def test_canonical_clauses():
    by = {r.name: r.expr for r in ro.load_rules()}
    assert "sma_200_slope > 0" in by["minervini_trend_template"] and "pct_from_52w_low > 30" in by["minervini_trend_template"]
    assert "new_lo7 == 1" in by["double_seven"] and "adj_close > sma_200" in by["double_seven"]


def test_bad_entries_are_refused(spark):
    for entries in ([{"name": "x"}], [{"name": "x", "expr": "a", "odd": 1}], [{"name": "x", "expr": "a"}] * 2):
        with pytest.raises(ro.RuleError):
            ro.load_rules(entries)
    with pytest.raises(ro.RuleError):
        ro.check_rules(bars(spark, walk(5)), [ro.Rule("n", "adj_close + 1")])


def test_every_expression_resolves_and_is_boolean(spark):
    rules = ro.load_rules()
    panel = screen_panel(bars(spark, walk(30)), rules, extra=["r"])
    for extra in ("mkt_vix_pctile_1y", "mkt_nifty_range_20d"):
        panel = panel.withColumn(extra, F.lit(1.0))
    ro.check_rules(panel, rules)


def test_trend_rules_fire_on_a_trend_and_not_on_a_decline(spark):
    up = TREND + [TREND[-1] * 0.998, TREND[-1] * 1.001]
    assert "trend_stack" not in names(spark, path(TREND), "trend_stack")  # strength is 100 on an unbroken rise
    wavy = [x * (1 + 0.01 * (-1) ** i) for i, x in enumerate(TREND)]
    assert "trend_stack" in names(spark, path(wavy), "trend_stack")
    assert names(spark, path(wavy[::-1]), "trend_stack", "momentum_leaders") == set()
    assert up


def test_double_seven_needs_a_new_closing_low(spark):
    assert "double_seven" in names(spark, path(TREND + [TREND[-1] * 0.96]), "double_seven")
    assert "double_seven" not in names(spark, path(TREND), "double_seven")


def test_volume_shocker(spark):
    rows = path(TREND + [TREND[-1] * 1.05])
    rows[-1] = rows[-1][:6] + (50_000,) + rows[-1][7:]
    assert "volume_shocker" in names(spark, rows, "volume_shocker")


def test_floors(spark):
    rows = path(TREND + [TREND[-1] * 0.96])
    assert names(spark, rows, "double_seven", min_price=1e6) == set()
    assert names(spark, rows, "double_seven", min_history=1000) == set()
    assert names(spark, rows, "double_seven", min_turnover=1e12) == set()


def test_unknown_values_never_match(spark):
    panel = build_features(bars(spark, path([100.0] * 20)), ["sma_200", "turnover_median_20d"])
    rule = ro.Rule("n", "adj_close > sma_200", min_turnover=0, min_price=0, min_history=0)
    assert ro.hits(panel, [rule]).count() == 0


def test_contaminated_rows_are_excluded(spark):
    panel = build_features(bars(spark, path(TREND)), ["turnover_median_20d"]).withColumn("contaminated", F.col("r") % 2 == 0)
    rule = ro.Rule("n", "adj_close > 0", min_turnover=0, min_price=0, min_history=0)
    assert ro.hits(panel, [rule]).count() == 200


def test_emitted_values(spark):
    panel = build_features(bars(spark, path(TREND)), ["sma_20", "turnover_median_20d"])
    rule = ro.Rule("n", "sma_20 > 0", emit=("sma_20", "adj_close"), min_turnover=0, min_price=0, min_history=0)
    got = ro.hits(panel, [rule], ["isin", "date", "sma_20"]).first()
    assert got.emit["sma_20"] == got.sma_20


def test_templates_and_variants():
    assert [r.name for r in ro.expand_templates({"t": "x < {p} and y > {q}", "u": "x < {p}"}, [1, 2], [3])] == ["t|1|3", "t|2|3", "u|1", "u|2"]
    made = ro.variants(ro.Rule("b", "x > 1"), {"c": "y > 2"})
    assert [r.expr for r in made] == ["x > 1", "(x > 1) and (y > 2)"]


def test_fresh_columns_are_only_built_when_read():
    rules = {r.name: r for r in ro.load_rules()}
    assert set(fresh_expressions([rules["trend_stack_swing"]])) == {"trend_stack"}
    assert fresh_expressions([rules["double_seven"]]) == {}


def test_fresh_signals_from_true_rows(spark):
    rows = [("a", "K", r) for r in (1, 2, 22, 43, 44)]
    df = spark.createDataFrame(rows, "rule string, isin string, r int")
    assert sorted(x.r for x in fresh_signals(df).collect()) == [1, 43]
