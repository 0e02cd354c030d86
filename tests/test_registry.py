import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(CORE) >= 115


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["agg_a07_evaluate_slice", "agg_a10_dedup_if_multiple", "tab_r01_main_summary", "tab_r06_results_matrix", "set_o15_build_mixture", "join_j01_align_by_hash", "stat_b03_mcnemar", "text_t05_postprocess_think"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def rows(d):
        clean = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
        return sorted(str([clean(v) for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))

    assert rows(a) == rows(b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_subpackage():
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for p in glob.glob(os.path.join(here, "quern", "**", "*.py"), recursive=True):
        if os.sep + "llm" + os.sep not in p:
            assert "quern.llm" not in open(p, encoding="utf-8").read()
