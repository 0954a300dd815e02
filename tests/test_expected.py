"""A sample of registered queries against their SQL (``tools/compare.py`` runs them all)."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = pathlib.Path("/root/testdata/sf0.01")
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SAMPLE = ["ewma_forecasts", "macro_asof_join", "ledoit_wolf_cov", "revision_merge", "forecast_metrics", "stage_completeness", "poke_percentiles", "bl_posterior", "customer_forecasts", "customer_features", "store_marks", "historical_views"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="benchmark tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    from compare import canonical

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert canonical(got).equals(canonical(want))
