"""Every registered query: against its SQL where it has one, else that it runs with a stable schema."""

import pytest

from glyphgrid.plans import registry

from .oracle import compare

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    compare(duckdb, registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["seg_id", "y", "x", "p"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_import_its_training_data_part():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys, glyphgrid.plans.registry, glyphgrid.streaming.arrivals, glyphgrid.operators.refine; assert not [m for m in sys.modules if m.startswith('glyphgrid.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
