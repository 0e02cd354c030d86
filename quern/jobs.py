"""Jobs: groups of queries run over a folder of tables, each result written to a folder of its own.

    python -m quern.jobs evaluate --tables /data/sf --out /data/out --format csv

A result that is there already is an error unless --overwrite is given; --only picks results of a job by name. A result that is complete has a
marker, and --resume passes it over and writes the others anew.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quern.plans.registry import QUERIES
from quern.session import session
from quern.sources.writers import FORMATS, is_done, mark_done, write_latex, write_table

JOBS: dict[str, dict[str, str]] = {
    "mixtures": {"mixture": "set_o15_build_mixture", "allowed_labels": "text_t07_format_allowed_labels", "job_grid": "udf_u07_job_grid"},
    "merge": {"generations": "set_o08_merge_shards", "group_sizes": "agg_a09_group_size_mode", "remaining": "join_j10_anti_completed"},
    "evaluate": {"per_dataset_metrics": "agg_a08_evaluate_dataset", "per_class": "agg_a04_per_class", "summary": "agg_a28_summary_means"},
    "tables": {
        "main_summary": "tab_r01_main_summary", "cross_domain": "tab_r02_cross_domain_transfer", "prompt_delta": "tab_r03_prompt_delta", "efficiency": "tab_r04_efficiency", "full_grid": "tab_r05_full_grid", "results_matrix": "tab_r06_results_matrix",
        "heatmap": "tab_r07_heatmap_order", "scaling": "tab_r08_scaling_points", "open_minus_constrained": "tab_r09_open_minus_constrained", "label_complexity": "tab_r14_label_complexity", "dashboard": "tab_r15_dashboard_json",
    },
    "significance": {"bootstrap_cis": "stat_b01_bootstrap_accuracy_ci", "summary_cis": "stat_b04_bootstrap_domain_avg", "pairwise_significance": "stat_b10_significance", "table_of_five": "stat_b10_table_clustered", "mcnemar": "stat_b03_mcnemar", "clustered": "stat_b05_paired_clustered", "served_models": "stat_b06_frontier_paired"},
    "scale": {"family_delta": "stat_b07_within_family_delta", "family_delta_by_regime": "stat_b07_family_delta_by_regime", "slope": "stat_b08_ols_slope", "slope_family": "stat_b09_slope_ci", "best_by_scale": "agg_a26_best_per_group"},
    "errors": {"strata": "agg_a25_pct_of_total", "by_scale": "agg_a25_pct_by_scale", "by_regime": "agg_a25_pct_by_regime", "categories": "agg_a32_value_counts", "confusions": "agg_a11_top_confused_pairs", "examples": "tab_r17_error_examples", "rates": "agg_a13_error_rate", "disagreements": "tab_r18_regime_disagreements"},
    "served": {"metrics": "agg_frontier_metrics", "table": "tab_r10_frontier_table", "pivot": "tab_r11_frontier_pivot", "hit_rate": "agg_a14_join_hit_rate", "cost": "agg_a29_cost_estimate"},
    "transfer": {"table": "tab_r12_transfer_table", "summary": "agg_a31_transfer_summary", "adapted": "tab_r13_dapt_table"},
    "truncation": {"stats": "tab_r19_truncation_stats", "worst": "agg_a30_max_worst_case"},
}


def run(spark: SparkSession, job: str, tables: str, out: str, fmt: str = "parquet", overwrite: bool = False, only: list[str] | None = None, resume: bool = False) -> list[str]:
    """Run a job's queries; the paths written."""
    names = JOBS[job]
    if unknown := sorted(set(only or ()) - set(names)):
        raise ValueError(f"job {job} has no results {unknown}; it has {sorted(names)}")
    paths = []
    for name, query in names.items():
        if not only or name in only:
            path = f"{out}/{job}/{name}"
            if resume and is_done(spark, path):
                continue
            df: DataFrame = QUERIES[query](spark, tables)
            write_table(df, path, fmt, overwrite or resume)
            if name == "results_matrix" and not out.startswith(("hdfs:", "s3")):
                write_latex(spark.read.format(fmt).option("header", True).option("inferSchema", True).load(path), f"{out}/{job}/{name}.tex")
            mark_done(spark, path)
            paths.append(path)
    return paths


def main(args: list[str]) -> None:
    p = argparse.ArgumentParser(prog="quern.jobs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--tables", required=True, help="folder of <table>.parquet")
    p.add_argument("--out", required=True, help="folder of results")
    p.add_argument("--format", default="parquet", choices=FORMATS)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--only", help="names of results, by commas")
    a = p.parse_args(args)
    only = [x for x in (s.strip() for s in (a.only or "").split(",")) if x]
    for path in run(SparkSession.getActiveSession() or session(), a.job, a.tables, a.out, a.format, a.overwrite, only, a.resume):
        print(path)


if __name__ == "__main__":
    main(sys.argv[1:])
