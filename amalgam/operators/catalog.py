"""Tables of the catalog: descriptions, constraints at write time, results of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def describe(spark: SparkSession, table: str, comment: str, columns: dict[str, str] | None = None, tags: dict[str, str] | None = None) -> None:
    """Comments of a table and its columns; tags become table properties."""
    spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(comment)}")
    for name, text in (columns or {}).items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{name}` COMMENT {_quoted(text)}")
    if tags:
        pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in tags.items())
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({pairs})")


def require(df: DataFrame, not_null: list[str] = (), schema: dict[str, str] | None = None) -> DataFrame:
    """``df``, failing when written if a column that must be known isn't; at once if names or types aren't those agreed."""
    if schema is not None and dict(df.dtypes) != schema:
        raise ValueError(f"columns {dict(df.dtypes)}, agreed {schema}")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(dict(df.dtypes)[c])).alias(c)
    return df.select(*(known(c) if c in not_null else F.col(c) for c in df.columns))


def overwrite(df: DataFrame, table: str) -> None:
    """Replaces all rows of a table, which stays the same table; creates it the first time. ``df`` may not read the table."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.select(spark.table(table).columns).write.mode("overwrite").insertInto(table)
        spark.catalog.refreshTable(table)
    else:
        df.write.saveAsTable(table)


def refresh(spark: SparkSession, tables: list[str]) -> None:
    """Makes readers see what others wrote."""
    for t in tables:
        spark.catalog.refreshTable(t)


def run_results(results: DataFrame, run: str, command: str, at: Column) -> DataFrame:
    """Outcomes of checks as rows to append to a table of runs."""
    return results.select(
        F.lit(run).alias("run"), F.lit(command).alias("command"), F.col("check").alias("node"), F.lit("test").alias("kind"), F.col("outcome").alias("state"), F.col("failed").alias("failures"),
        at.alias("executed_at"),
    )


def write_labelling_csv(df: DataFrame, path: str) -> None:
    """Semicolon CSV with a header, arrays and maps as JSON, for people to label."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).option("sep", ";").mode("overwrite").csv(path)


def as_dicts(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a small result for a client; more than ``most`` are an error, not a truncation."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return [r.asDict(True) for r in rows]
