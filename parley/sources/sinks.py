"""Writers of tables and small reports, and guards of what is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a report is one file.
REPORT_ROWS = 100_000


def require_rows(df: DataFrame, least: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """The table itself; an error if it lacks a column or has fewer rows."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows of at least {least}")
    return df


def with_ids(df: DataFrame, ordinal: str, pattern: str) -> DataFrame:
    """Adds record_id from an explicit ordinal, never from where a row happens to lie."""
    return df.withColumn("record_id", F.format_string(pattern, F.col(ordinal)))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def create_from(df: DataFrame, path: str) -> None:
    """A new table; an error if there is one."""
    df.write.mode("errorifexists").parquet(path)


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """All rows of the parents in ``df`` in place of those stored for them; other parents' stay. The table is partitioned by parent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def common_columns(tables: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Sources under common names (``{old: new}`` for each), columns that one lacks are null."""
    out = None
    for df, names in tables:
        df = df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv_report(tables: list[DataFrame], path: str) -> None:
    """A report as CSV: the sorted columns of all tables. Small ones are one file (their rows are counted)."""
    rows = common_columns([(t, {}) for t in tables])
    rows = rows.select(*sorted(rows.columns))
    if rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS:
        rows = rows.coalesce(1)
    rows.write.csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    """Each row as one JSON object, nulls included."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    if rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS:
        rows = rows.coalesce(1)
    rows.write.text(path)


def markdown(df: DataFrame, columns: list[str], order: list[Column]) -> Column:
    """Rows of a small table as lines of a Markdown table, in order (an aggregate)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), cells.alias("l")))), lambda r: r["l"]), "\n"))


def changed_state(spark: SparkSession, events: str, key: str, order: str) -> DataFrame:
    """The latest state of each key of an append-only table, in place of updates."""
    return spark.read.parquet(events).groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
