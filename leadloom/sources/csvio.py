"""CSV files: UTF-8 with or without byte order mark, header row, every value a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import casefold_key, fold_keep


def read_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, missing_as_empty: bool = False, line_breaks: bool = True
) -> DataFrame:
    """An empty cell is NULL, or the empty text if asked. Quoted fields may hold line breaks, for which a file must be
    read in one piece; files without any are split over the cluster with ``line_breaks=False``.

    With ``columns`` the schema is fixed and no file is opened to infer it; a header-only file gives no rows.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("enforceSchema", False).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    out = reader.csv(path)
    return out.na.fill("") if missing_as_empty else out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", byte_order_mark: bool = False) -> None:
    """Header, all fields quoted, NULL as the empty text; one folder of part files, each with a mark before its header
    if asked (spreadsheets need it to read UTF-8)."""
    names = [f"\ufeff{c}" if byte_order_mark and i == 0 else c for i, c in enumerate(df.columns)]
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(df.columns, names, strict=True)]).write.mode(mode).option(
        "header", True
    ).option("quoteAll", not byte_order_mark).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def exclusion_lists(frames: list[DataFrame], email: str = "email", company: str = "company") -> tuple[DataFrame, DataFrame]:
    """(emails, company keys): the distinct folded contacts of several lists."""
    both = frames[0].select(email, company)
    for f in frames[1:]:
        both = both.unionByName(f.select(email, company))
    key: list[Column] = [casefold_key(F.col(email)).alias("email_key"), fold_keep(F.col(company)).alias("company_key")]
    emails = both.select(key[0]).where("email_key <> ''").distinct()
    companies = both.select(key[1]).where("company_key <> ''").distinct()
    return emails, companies


def existing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The given paths that exist, on whatever file system they name."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out
