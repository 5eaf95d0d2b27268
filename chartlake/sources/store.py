"""Reading and writing the store's tables: Parquet, JDBC, JSON, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.schemas import TABLES, conform


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared columns."""
    return conform(spark.read.parquet(f"{folder}/{name}"), TABLES[name])


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, timeout_s: int = 180) -> DataFrame:
    """A table or query of a database, read side by side by ranges of a column."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", query).option("queryTimeout", timeout_s)
    if column and bounds:
        r = r.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replaces the partitions that ``df`` has, and only these."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def checked_copy(df: DataFrame, keys: Sequence[str], json_arrays: Sequence[str] = ()) -> DataFrame:
    """``df``, of which any use fails on an empty key or a text that is no JSON
    array."""
    ok: Column = F.lit(True)
    for k in keys:
        ok &= F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False))
    for c in json_arrays:
        ok &= F.coalesce(F.expr(f"schema_of_variant(try_parse_json(`{c}`)) like 'ARRAY%'"), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("row with an empty key or no JSON array: "), F.to_json(F.struct(*keys))))
    return df.where(F.when(ok, True).otherwise(failed.cast("boolean")))


def playlist_items(df: DataFrame, order: Sequence[Column], by: Sequence[str], chunk: int = 50) -> DataFrame:
    """Ordered items of each playlist with the number of their chunk."""
    from pyspark.sql import Window as W

    return df.withColumn("item_order", F.row_number().over(W.partitionBy(*by).orderBy(*order))).withColumn("chunk_no", F.floor((F.col("item_order") - 1) / chunk).cast("int"))


def names_of(json_text: Column) -> Column:
    """Filled names of a JSON array of texts."""
    return F.filter(F.coalesce(F.from_json(json_text, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def update_audit(items: DataFrame, job: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Run and ordered items of a playlist update (``items`` has ``action,
    video_id, item_order``), with an id that depends on job and time only."""
    run = F.sha1(F.concat_ws("|", F.lit(job), now.cast("string")))
    runs = items.agg(F.count_if(F.col("action") == "add").alias("requested"), F.count_if(F.col("action") == "remove").alias("existing"))
    runs = runs.select(run.alias("update_run_id"), F.lit(job).alias("job_name"), F.col("requested").cast("int"), F.col("existing").cast("int"), now.alias("created_at"))
    return runs, items.select(run.alias("update_run_id"), "action", "video_id", "item_order", now.alias("created_at"))


def source_audit(deliveries: DataFrame, now: Column) -> DataFrame:
    """One audit row per delivery (``job_name, expected_period, fetched_period,
    status, entry_count``); its id depends on these and the time."""
    cols = ["job_name", "expected_period", "fetched_period", "status", "entry_count"]
    key = F.sha1(F.to_json(F.struct(*cols, now.cast("string").alias("at"))))
    return deliveries.select(key.alias("audit_id"), *cols, now.alias("created_at"))


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A random order that is the same for the same seed and keys, however the
    rows are partitioned."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def digest_lines(df: DataFrame, by: Sequence[str], order: str, line: Column, output: str = "lines") -> DataFrame:
    """Lines of each group as one text, in order."""
    xs = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return xs.select(*by, F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias(output))
