"""Registered studies draw as often as the reference does."""

from unittest.mock import MagicMock

import pytest

from panelspark.registry import QUERIES, studies


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, want", [("K7_stress", 100), ("K8_random_baseline", 200), ("V19_selection_uplift", 200)])
def test_draws(spark, monkeypatch, name, want):
    def ask(trades, draws, seed=7):
        raise Asked(draws)

    monkeypatch.setattr(studies, "trade_set", lambda s, d: (None, MagicMock()))
    monkeypatch.setattr(studies, "cut_lineage", lambda df: MagicMock())
    monkeypatch.setattr(studies.cross, "composite_score", lambda *_: None)
    monkeypatch.setattr(studies.va, "unpivot_features", lambda *_: MagicMock())
    monkeypatch.setattr(studies.va, "spearman", lambda *_: MagicMock())
    monkeypatch.setattr(studies.al, "top_k_with_holding", lambda *_: MagicMock())
    monkeypatch.setattr(studies.al, "random_orders", ask)
    monkeypatch.setattr(studies.al, "candidates", lambda *_: MagicMock())
    with pytest.raises(Asked) as asked:
        QUERIES[name](spark, "")
    assert asked.value.args == (want,)
