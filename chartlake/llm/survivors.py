"""The best representative of each group of duplicate records.

Fields are unpivoted to long rows; each row votes for its normalised value with
the trust of its source times a decay by age; the votes are summed per value,
the winner of each field is chosen by ``max_by``, and the winners are pivoted
back to one record per group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.operators.components import connected_components

#: Days after which a vote counts half.
HALF_LIFE = 180.0

# Statuses of a good match; trust in a record by its status, any other of which has 1.
GOOD = ("matched", "cached_match", "proxy_matched", "manual_override")
TRUST = dict.fromkeys(GOOD, 3.0)


def tight(c: Column) -> Column:
    """Text without case and white space; null if nothing is left. Case goes
    first: the lower form of a letter may depend on where its word ends."""
    low = F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return F.nullif(F.regexp_replace(low, r"(?U)[\s\p{Z}]+", ""), F.lit(""))


def video_id(c: Column) -> Column:
    """The video that a text names as an id or inside a link."""
    t = F.regexp_replace(c, r"(?U)[\s\p{Z}]+", "")
    link = F.coalesce(
        F.nullif(F.regexp_extract(t, r"[?&]v=([0-9A-Za-z_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?([0-9A-Za-z_-]+)/?(?:[?#].*)?$", 1), F.lit("")),
    )
    return F.when(t != "", F.when(F.contains(t, F.lit("://")), F.coalesce(link, t)).otherwise(t))


def duplicate_groups(records: DataFrame, key: str, links: Mapping[str, Column]) -> DataFrame:
    """``records`` with ``group_id``: records that share the value of any link
    are in one group, and groups join through common members. A null link links
    nothing; a record without links is alone. Repeated rows share their group.

    Only the values of links form the graph (a record with several links is an
    edge between their values), so records never meet in one task.
    """
    names = list(links)
    src = records.drop("group_id").withColumns({f"__l{i}": F.concat(F.lit(f"{i}:"), links[n]) for i, n in enumerate(names)})
    cols = [f"__l{i}" for i in range(len(names))]
    first = F.coalesce(*cols)
    edges = src.select(first.alias("a"), F.explode(F.array_compact(F.array(*cols))).alias("b")).distinct()
    found = connected_components(edges, "a", "b")
    out = src.withColumn("__first", first).join(found, F.col("__first") == found["node"], "left")
    own = F.concat(F.lit("="), F.col(key).cast("string"))
    return out.withColumn("group_id", F.coalesce("component", "__first", own)).drop(*cols, "__first", "node", "component")


#: Decimals to which sums of votes are compared, so that their order of adding does not decide.
DIGITS = 9


def _long(grouped: DataFrame, key: str, fields: Mapping[str, Column], trust: Column, updated: str, group: str, half_life: float) -> DataFrame:
    """One row per record and filled field, with the record's vote."""
    age = F.coalesce(F.unix_micros(F.col(updated).cast("timestamp")).cast("double"), F.lit(-2e15)) / (86400e6 * half_life)
    vote = F.greatest(F.coalesce(trust, F.lit(0.0)), F.lit(0.0)) * F.pow(F.lit(2.0), age - F.lit(20000.0 / half_life))
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), n.cast("string").alias("norm")) for f, n in fields.items()]
    )
    long = grouped.select(F.col(group).alias("__g"), F.col(key).cast("string").alias("__id"), vote.alias("__vote"), F.explode(rows).alias("x"))
    return long.select("__g", "__id", "__vote", "x.*").where("norm is not null")


def best_records(
    grouped: DataFrame,
    key: str,
    fields: Mapping[str, Column],
    trust: Column,
    updated: str,
    group: str = "group_id",
    half_life: float = HALF_LIFE,
) -> DataFrame:
    """One row per group: ``group, members`` and the winner of each field.

    ``fields`` maps each field to its normalised value, null where it is
    missing. A value's votes are the sum of trust times ``2 ** (age / -half
    life)`` of the records that have it; it is returned in the spelling of its
    strongest record. A null time counts as very old, a null or negative trust
    as none. Ties go to the greater normalised value, and in spelling to the
    greater key, then the greater text. A field that no record has is null.
    Repeated rows vote repeatedly. A null group is a group of its own; an empty
    table gives no rows; other columns are ignored.

    Sums are aggregated before they are shuffled, so a group of any size is
    spread over all tasks.
    """
    long = _long(grouped, key, fields, trust, updated, group, half_life)
    votes = long.groupBy("__g", "field", "norm").agg(
        F.round(F.sum("__vote"), DIGITS).alias("votes"), F.max(F.struct("__vote", "__id", "value")).alias("best")
    )
    # max_by over (votes, normalised value): the winner of each field.
    wide = votes.groupBy("__g").agg(
        *[
            F.max_by(F.when(F.col("field") == f, F.col("best.value")), F.when(F.col("field") == f, F.struct("votes", "norm"))).alias(f"__w{i}")
            for i, f in enumerate(fields)
        ]
    )
    sizes = grouped.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("members"))
    out = sizes.join(wide, sizes["__g"].eqNullSafe(wide["__g"]), "left").select(sizes["__g"], "members", *[f"__w{i}" for i in range(len(fields))])
    return out.select(F.col("__g").alias(group), "members", *[F.col(f"__w{i}").alias(f) for i, f in enumerate(fields)])


def strongest_members(
    grouped: DataFrame,
    key: str,
    fields: Mapping[str, Column],
    trust: Column,
    updated: str,
    group: str = "group_id",
    half_life: float = HALF_LIFE,
) -> DataFrame:
    """``group, key, strength`` of the records that represent their group best
    as they are: those whose filled fields have the greatest sum of votes.

    A record votes with each filled field as in ``best_records``; equal sums are
    all returned, each record once. Members of which no field is filled, or
    whose votes are all 0, are returned only if the whole group is so; then all
    of them are. Groups of one return their record; a null group is a group.
    """
    long = _long(grouped, key, fields, trust, updated, group, half_life)
    each = grouped.select(F.col(group).alias("__g"), F.col(key).cast("string").alias("__id"), F.lit(0.0).alias("__vote"))
    each = long.select("__g", "__id", "__vote").unionByName(each)
    each = each.groupBy("__g", "__id").agg(F.round(F.sum("__vote"), DIGITS).alias("strength"))
    top = each.groupBy(F.col("__g").alias("__t")).agg(F.max("strength").alias("__most"))
    best = each.join(top, F.col("__g").eqNullSafe(F.col("__t")) & (F.col("strength") == F.col("__most")))
    return best.select(F.col("__g").alias(group), F.col("__id").alias(key), "strength")
