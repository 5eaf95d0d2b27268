"""Queries of the text problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm import abuse, bpe, lookalike, matching, mixture, survivors
from chartlake.runtime import materialize, table


def _values(spark: SparkSession, d: str) -> DataFrame:
    """The texts of problem 3, one row per value."""
    parts = []
    for name, key, fields in (("source_tracks", "row_id", ("title", "artist")), ("ytmusic_song_translations", "video_id", ("title_ko",))):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
        parts.append(
            table(spark, d, name)
            .select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), pairs.alias("x"))
            .select("table_name", "row_key", "x.field", "x.value")
        )
    return reduce(DataFrame.unionByName, parts)


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its consistent form."""
    return lookalike.canonical_text(_values(spark, d), "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that had to change."""
    return p3_canonical(spark, d).where("value <> canonical").select("table_name", "row_key", "field").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per source."""
    return bpe.token_statistics(bpe.count_tokens(table(spark, d, "documents").select("source", "text")), "source")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = materialize(bpe.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text")), "sizes")
    return mixture.mix_sources(docs, table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture in order."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixture.shares(*_mixture(spark, d))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matching rows of different services with their confidence."""
    return matching.match_records(table(spark, d, "match_results"), "result_id", "service")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The matching pairs."""
    return p4_pairs(spark, d).select(F.col("id_a").alias("result_id_a"), F.col("id_b").alias("result_id_b"))


FILLED = ("canonical_yt_video_id", "yt_title", "yt_artist", "yt_album")
GOOD = survivors.GOOD


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, dict, Column]:
    """Tracks with their groups, the normal form of each field, and the trust
    in a record: that in its status times its score."""
    t = table(spark, d, "tracks")
    meta = [survivors.tight(F.col(c)) for c in FILLED[1:]]
    same = F.when(meta[0].isNotNull() & meta[1].isNotNull() & meta[2].isNotNull(), F.concat_ws("\u0001", *meta))
    grouped = survivors.duplicate_groups(t, "track_uid", {"video": survivors.video_id(F.col(FILLED[0])), "meta": same})
    grouped = materialize(grouped, "tracks")
    status = F.lower(F.trim("match_status"))
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in survivors.TRUST.items() for x in kv])[status], F.lit(1.0))
    trust = level * (F.coalesce("best_score", F.lit(0.0)) + 0.5)
    fields = {FILLED[0]: survivors.video_id(F.col(FILLED[0])), **{c: survivors.tight(F.col(c)) for c in FILLED[1:]}, "match_status": F.nullif(status, F.lit(""))}
    return grouped, fields, trust


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per group of two or more, built field by field, with
    the group's strongest member (of equal ones the least) as its key."""
    grouped, fields, trust = _tracks(spark, d)
    best = survivors.best_records(grouped, "track_uid", fields, trust, "updated_at").where("members > 1")
    first = survivors.strongest_members(grouped, "track_uid", fields, trust, "updated_at").groupBy("group_id").agg(F.min("track_uid").alias("track_uid"))
    top = grouped.groupBy("group_id").agg(F.max(F.coalesce("best_score", F.lit(0.0))).alias("best_score"), F.max("updated_at").alias("updated_at"))
    out = best.join(first, "group_id").join(top, "group_id")
    return out.select("track_uid", "members", survivors.video_id(F.col(FILLED[0])).alias(FILLED[0]), *FILLED[1:], "match_status", "best_score", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that no other member of their group surpasses.

    The votes choose them: such a record has all fields, the greatest trust and
    the latest time, so no member has more votes. An exact check follows: it
    must have all that any member has.
    """
    grouped, fields, trust = _tracks(spark, d)
    strongest = survivors.strongest_members(grouped, "track_uid", {c: fields[c] for c in FILLED}, trust, "updated_at").select("group_id", "track_uid")
    score, good = F.coalesce("best_score", F.lit(0.0)), F.coalesce(F.lower(F.trim("match_status")).isin(*GOOD), F.lit(False))
    facts = {"__score": score, "__at": F.col("updated_at"), "__good": good, **{f"__{c}": fields[c].isNotNull() for c in FILLED}}
    rows = grouped.select("group_id", "track_uid", *[v.alias(k) for k, v in facts.items()])
    top = rows.groupBy("group_id").agg(F.count("*").alias("members"), *[F.max(k).alias(f"{k}_top") for k in facts]).where("members > 1")
    chosen = rows.join(strongest, ["group_id", "track_uid"]).join(top, "group_id")
    return chosen.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_top")) for k in facts])).select("track_uid").distinct()


#: Probability from which a document counts as abusive.
ABUSIVE = 0.7


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = abuse.fit(docs, table(spark, d, "labels"))
    return abuse.score(docs.select("doc_id", "source", "text"), model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, d).where(F.col("abuse") >= ABUSIVE).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d).select("doc_id", "source", "abuse")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of abusive documents per source."""
    return abuse.rates(_scored(spark, d), threshold=ABUSIVE)


QUERIES = {
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p6_ids": p6_ids,
    "p6_sizes": p6_sizes,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_TIGHT = "nullif(regexp_replace(replace(translate(lower({0}), 'ς', 'σ'), 'ß', 'ss'), '\\s+', '', 'g'), '')"
_GROUPS = f"""
with recursive t as (
  select *, {_TIGHT.format('yt_title')} as a, {_TIGHT.format('yt_artist')} as b, {_TIGHT.format('yt_album')} as c,
    regexp_replace(canonical_yt_video_id, '\\s+', '', 'g') as x
  from tracks),
k as (
  select *, case when x = '' then null when x like '%://%v=%' then regexp_extract(x, '[?&]v=([0-9A-Za-z_-]+)', 1)
    when x like '%://%' then regexp_extract(x, '([0-9A-Za-z_-]+)/?([?#].*)?$', 1) else x end as v,
    case when a is not null and b is not null and c is not null then a || chr(1) || b || chr(1) || c end as m,
    coalesce(lower(trim(match_status)) in ('matched', 'cached_match', 'proxy_matched', 'manual_override'), false) as good
  from t),
near as (
  select p.track_uid as p, q.track_uid as q from k p join k q on p.v = q.v
  union select p.track_uid, q.track_uid from k p join k q on p.m = q.m),
reach as (select track_uid as p, track_uid as q from k union select reach.p, near.q from reach join near on reach.q = near.p)
"""
_P5 = f"""{_GROUPS},
best as (
  select reach.p, count(*) as n, max(nullif(x, '')) as x, max(a) as a, max(b) as b, max(c) as c, bool_or(good) as good,
    max(coalesce(best_score, 0)) as s, max(updated_at) as u
  from reach join k on k.track_uid = reach.q group by reach.p)
select track_uid from k join best on best.p = k.track_uid
where n > 1 and coalesce(best_score, 0) = s and updated_at is not distinct from u and (not best.good or k.good)
  and (best.x is null or k.x <> '') and (best.a is null or k.a is not null) and (best.b is null or k.b is not null)
  and (best.c is null or k.c is not null)
"""
_SURVIVORS = f"""{_GROUPS},
mine as (select p as track_uid, min(q) as g from reach group by p having count(*) > 1),
voter as (
  select k.*, g, case when good then 3e0 else 1e0 end * (coalesce(best_score, 0) + 0.5e0)
    * pow(2e0, coalesce(epoch_us(updated_at), -2e15) / (86400e6 * 180e0) - 20000e0 / 180e0) as vote
  from k join mine using (track_uid)),
long as (
  select g, track_uid, vote, 'v' as field, canonical_yt_video_id as value, v as norm from voter union all select g, track_uid, vote, 'a', yt_title, a from voter
  union all select g, track_uid, vote, 'b', yt_artist, b from voter union all select g, track_uid, vote, 'c', yt_album, c from voter
  union all select g, track_uid, vote, 's', match_status, nullif(lower(trim(match_status)), '') from voter),
votes as (select g, field, norm, round(sum(vote), 9) as n, arg_max(value, (vote, track_uid, value)) as value from long where norm is not null group by all),
won as (select g, field, arg_max(value, (n, norm)) as value, arg_max(norm, (n, norm)) as norm from votes group by all),
weight as (select g, track_uid, round(sum(case when norm is null then 0 else vote end), 9) as w from long group by all),
first as (select g, arg_min(track_uid, (-w, track_uid)) as track_uid from weight group by g),
top as (select g, count(*) as members, max(coalesce(best_score, 0)) as best_score, max(updated_at) as updated_at from voter group by g)
select first.track_uid, members, (select norm from won where won.g = top.g and field = 'v') as canonical_yt_video_id,
  (select value from won where won.g = top.g and field = 'a') as yt_title, (select value from won where won.g = top.g and field = 'b') as yt_artist,
  (select value from won where won.g = top.g and field = 'c') as yt_album, (select value from won where won.g = top.g and field = 's') as match_status,
  best_score, strftime(updated_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as updated_at
from top join first on first.g = top.g
"""

ORACLE: dict[str, str] = {"p5_found": _P5, "p5_survivors": _SURVIVORS}
