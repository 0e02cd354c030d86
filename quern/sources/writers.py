"""Writing tables and reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import DATASETS
from quern.session import gathered

FORMATS = ("csv", "parquet")


def append(df: DataFrame, path: str, fmt: str) -> None:
    """Append to a folder of CSV or Parquet files; nothing that is there is rewritten."""
    fmt = fmt.strip().lower()
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    w = df.write.mode("append")
    w.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, quote='"', escape='"') if fmt == "csv" else w.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, by: list[str] = ()) -> None:
    """Write a new table, partitioned by some columns; raises if it is there and overwrite is not set."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt).partitionBy(*by)
    (w.option("header", True).option("escape", chr(34)).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) if fmt == "csv" else w).save(path)


DONE = "_DONE"  # the marker in the folder of a result that is complete


def files(spark: SparkSession, path: str):
    """The path and the file system that the session uses for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark_done(spark: SparkSession, folder: str) -> None:
    """Put the marker of completion into a folder; marking twice changes nothing."""
    at, fs = files(spark, f"{folder.rstrip('/')}/{DONE}")
    fs.create(at, True).close()


def is_done(spark: SparkSession, folder: str) -> bool:
    at, fs = files(spark, f"{folder.rstrip('/')}/{DONE}")
    return fs.exists(at)


def replace_table(df: DataFrame, path: str, backup: str = ".bak") -> None:
    """Put a new Parquet table in the place of one that df may read: written beside it, then swapped in by renaming. The first table replaced stays as a backup; later ones don't."""
    spark = df.sparkSession
    path = path.rstrip("/")
    new, old, kept = f"{path}.new", path, f"{path}{backup}"
    df.write.mode("overwrite").parquet(new)
    at, fs = files(spark, old)
    spare = files(spark, kept)[0]
    gone = spare if not fs.exists(spare) else files(spark, f"{path}.old")[0]
    if not fs.rename(at, gone):
        raise OSError(f"{old} cannot be renamed")
    if not fs.rename(files(spark, new)[0], at):
        fs.rename(gone, at)
        raise OSError(f"{new} cannot be renamed")
    if gone is not spare:
        fs.delete(gone, True)


def best_flags(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """The table with best_<column>: whether a value is the column's largest."""
    most = matrix.agg(*[F.max(c).alias(c) for c in columns]).first()  # one row
    return matrix.withColumns({f"best_{c}": F.coalesce(F.col(c) == F.lit(most[c]), F.lit(False)) for c in columns})


def latex_cell(value: Column, best: Column, digits: int = 3) -> Column:
    text = F.format_string(f"%.{digits}f", value)
    return F.when(value.isNull(), "--").when(best, F.concat(F.lit(r"\textbf{"), text, F.lit("}"))).otherwise(text)


def latex_rows(matrix: DataFrame, columns: list[str] = (*DATASETS, "general_avg", "literary_avg", "overall_avg")) -> DataFrame:
    """(config, line): each row of the results matrix as a line of a LaTeX table, the largest value of a column bold, missing ones dashes."""
    d = best_flags(matrix, list(columns))
    cells = [latex_cell(F.col(c), F.col(f"best_{c}")) for c in columns]
    return d.select("config", F.concat(F.concat_ws(" & ", "model", "regime", "shot", *cells), F.lit(r" \\")).alias("line"))


def write_latex(matrix: DataFrame, path: str) -> None:
    """The LaTeX table, with a rule between models. The matrix has thirty rows; one of more than MOST_ROWS raises."""
    rows = latex_rows(matrix).join(matrix.select("config", "model"), "config").orderBy("config")
    rows = gathered(rows)
    lines = [r"\begin{tabular}{lll" + "r" * (len(DATASETS) + 3) + "}", r"\toprule"]
    for k, r in enumerate(rows):
        if k and r["model"] != rows[k - 1]["model"]:
            lines.append(r"\midrule")
        lines.append(r["line"])
    Path(path).write_text("\n".join([*lines, r"\bottomrule", r"\end{tabular}", ""]), encoding="utf-8")


def write_page(payload: DataFrame, template: str, path: str, spark: SparkSession | None = None, mark: str = "__DATA__") -> None:
    """A page whose placeholder is replaced by the one row of JSON columns; raises if the template has none. With a session the path may be of any of its file systems."""
    if mark not in template:
        raise ValueError(f"the template has no {mark}")
    row = payload.first()
    body = "{" + ", ".join(f'"{k}": {row[k]}' for k in payload.columns) + "}"
    page = template.replace(mark, body)
    if spark is None:
        Path(path).write_text(page, encoding="utf-8")
        return
    at, fs = files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(page.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any of the session's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]
