import os

import pytest

from quern.jobs import JOBS, main, run
from quern.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_jobs_name_queries():
    assert {q for job in JOBS.values() for q in job.values()} <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark, tmp_path, capsys):
    out = str(tmp_path)
    main(["tables", "--tables", DATA, "--out", out, "--only", "results_matrix, main_summary"])
    assert spark.read.parquet(out + "/tables/results_matrix").count() == 30
    assert "midrule" in (tmp_path / "tables" / "results_matrix.tex").read_text()
    assert len(capsys.readouterr().out.split()) == 2
    with pytest.raises(Exception, match="(?i)exists"):
        run(spark, "tables", DATA, out, only=["main_summary"])
    run(spark, "tables", DATA, out, "csv", overwrite=True, only=["main_summary"])
    with pytest.raises(ValueError, match="no results"):
        run(spark, "tables", DATA, out, only=["x"])
    assert run(spark, "tables", DATA, out, only=["main_summary", "results_matrix"], resume=True) == []
    os.remove(out + "/tables/main_summary/_DONE")
    assert run(spark, "tables", DATA, out, only=["main_summary", "results_matrix"], resume=True) == [out + "/tables/main_summary"]
