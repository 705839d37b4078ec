import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["rel_abundance", "clr_counts", "score_absolute", "score_relative", "rolling_z", "cusum_upper_lower", "holt_forecast", "kruskal_h", "roc_points", "set_ops", "rarefaction", "history_baseline", "score_relative_clr", "farrington", "located_samples", "resistance_annotation", "rarefaction_curve", "stream_signals"])
def test_query_agrees_with_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = oracle.execute(ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in key:
        if got[c].dtype.kind == "f":
            assert abs(got[c].astype(float) - want[c].astype(float)).max() < 2e-6
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["benchmark_comparison", "abundance_sweep", "synthetic_benchmark"])
def test_benchmarks_read_tables(spark, oracle, name):
    out = QUERIES[name](spark, SF)
    assert {f.rsplit("/", 1)[-1] for f in out.inputFiles()} >= {"lineitem.parquet", "part.parquet"}
    got = out.toPandas()
    assert len(got) and not got[got.columns[-1]].isna().all()
    if name in ORACLES:
        want, key = oracle.execute(ORACLES[name]).df(), got.columns[0]
        got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want[list(got.columns)]))
        assert len(got) == len(want) and got.fillna(-1).equals(want.fillna(-1).astype(got.dtypes.to_dict()))
