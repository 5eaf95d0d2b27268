"""Jobs, weights and aliases as data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.functions.text import norm_match

JOBS = (
    "job_name string, enabled string, service string, frequency string, list_type string, playlist_name string, source_urls string, "
    "target_id string, entity_limit int, schedule string, shuffle boolean, include_in_hype boolean, hype_group string, hype_weight double"
)
ALIASES = "artists array<array<string>>, titles array<array<string>>, albums array<array<string>>, overrides map<string,string>"
# Weights of groups whose jobs give none.
GROUP_WEIGHTS = {"apple": 0.4, "melon_genz": 0.4, "ytmusic": 0.2}


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of a JSON array; a missing file is no jobs. Source URLs, which
    are texts or objects, stay JSON."""
    try:
        return spark.read.schema(JOBS).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], JOBS)


def weighted_jobs(jobs: DataFrame, defaults: dict[str, float] = GROUP_WEIGHTS) -> DataFrame:
    """Jobs of the report: ``job_name, hype_group, hype_weight``. A weight that
    is null or 0 is that of the group, else 1."""
    pairs = [F.lit(x) for kv in defaults.items() for x in kv]
    group = F.trim(F.coalesce("hype_group", F.lit("")))
    weight = F.coalesce(F.nullif(F.col("hype_weight"), F.lit(0.0)), F.create_map(*pairs)[group], F.lit(1.0))
    rows = jobs.where(F.col("include_in_hype") & (F.trim("job_name") != ""))
    return rows.select(F.trim("job_name").alias("job_name"), F.nullif(group, F.lit("")).alias("hype_group"), weight.alias("hype_weight"))


def due_jobs(jobs: DataFrame, today, retry_days: int = 2) -> DataFrame:
    """Enabled jobs whose weekday is today; weekly charts also on the
    ``retry_days`` days after. Jobs without a schedule are always due."""
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    name = F.lower(F.trim("schedule"))
    at = F.coalesce(*[F.when(name == d, i) for i, d in enumerate(days)])
    on = F.coalesce(F.lower(F.col("enabled").cast("string")).isin("true", "1", "yes"), F.lit(True))
    weekly = (F.col("list_type") == "chart") & (F.col("frequency") == "weekly")
    late = F.pmod(F.weekday(F.lit(today).cast("date")) - at, F.lit(7))
    return jobs.where(on & (at.isNull() | (late <= F.when(weekly, retry_days).otherwise(0))))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``kind, key, variants``: each member of a cluster of names, normalised,
    with all names of its clusters; and ``kind = 'override'`` with the id."""
    raw = spark.read.schema(ALIASES).json(path, multiLine=True)
    out = None
    for kind in ("artists", "titles", "albums"):
        one = raw.select(F.explode(F.coalesce(kind, F.array().cast("array<array<string>>"))).alias("c"))
        one = one.select(F.filter(F.transform("c", lambda x: F.trim(x)), lambda x: x != "").alias("c"))
        one = one.select(F.lit(kind).alias("kind"), F.explode("c").alias("name"), "c").withColumn("key", norm_match(F.col("name")))
        out = one if out is None else out.unionByName(one)
    names = out.where("key <> ''").groupBy("kind", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("variants"))
    o = raw.select(F.explode("overrides").alias("name", "id")).withColumn("parts", F.split("name", r"\|"))
    o = o.select("id", F.posexplode("parts"), "name").select("id", "name", "pos", norm_match(F.col("col")).alias("part"))
    o = o.groupBy("name", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "|").alias("key"))
    return names.unionByName(o.select(F.lit("override").alias("kind"), "key", F.array("id").alias("variants")))


def setting(name: str, default, kind=str):
    """A setting of the environment; one that cannot be read is the default."""
    value = os.environ.get(name, "").strip()
    if not value:
        return default
    if kind is bool:
        return value.lower() in ("1", "true", "yes", "on")
    try:
        return kind(value)
    except ValueError:
        return default
