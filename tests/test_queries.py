"""Every query of the library against its SQL, or at least against its shape."""

import sys

import pytest

from commitgrain.plans import registry
from compare import duck, rows
from conftest import SF

HEAVY = {"m5_cross_validate", "m6_grid_forest", "m7_grid_boosted", "m8_importance", "m9_refine"}
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(Q) - HEAVY))
def test_query(spark, name):
    got = Q[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck(SQL[name], SF))
    else:
        assert len(got)


@pytest.mark.parametrize("absent", ["public_tokenizers", "ahocorasick", "commitgrain.llm", "corpus_pipeline"])
def test_entry_module_without_a_dependency(monkeypatch, absent):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("commitgrain.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)  # importing it fails
    assert set(Q) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())


def test_entry_module_has_all(spark):
    import __spark_entry__ as e

    assert set(Q) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
