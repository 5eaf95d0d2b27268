"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, repeated at most a capped
number of times. A document's virtual finish time is the tokens of its source
up to and with it, divided by the source's weight; in the order of finish times
the sources keep their weights at every point. All documents are then sorted by
finish time, and the mixture ends where their tokens reach the budget. Running
sums are made of two levels (buckets of the order, then rows of a bucket), so
that neither a source nor the mixture has to fit into one task; only the sums of
buckets, one per ``BUCKET_ROWS`` documents, are added up in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.runtime import materialize

#: Documents of a source per bucket of its shuffled order.
BUCKET_ROWS = 20_000


def _queues(docs: DataFrame, targets: DataFrame, budget: float | None) -> DataFrame:
    """One row per target source: weight, tokens there are, tokens wanted and
    passes needed. Targets are few (one row per source), and so are the rows
    that are aggregated for them."""
    want = targets.groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).cast("int").alias("max_repeats"),
    ).where("source is not null")
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.count("*").alias("documents"))
    q = want.join(have, "source", "left").fillna(0, ["there", "documents"])
    everyone = W.partitionBy(F.lit(0))  # all targets: a bounded handful of rows
    share = F.when(F.col("there") > 0, F.col("target_share")).otherwise(0.0)
    q = q.withColumn("weight", share / F.nullif(F.sum(share).over(everyone), F.lit(0.0)))
    most = F.min(F.when(F.col("weight") > 0, F.col("there") * F.col("max_repeats") / F.col("weight"))).over(everyone)
    q = q.withColumn("budget", F.coalesce(F.lit(budget).cast("double"), F.floor(most).cast("double"), F.lit(0.0)))
    passes = F.ceil(F.col("weight") * F.col("budget") / F.col("there"))
    return q.withColumn(
        "passes", F.when(F.col("weight") > 0, F.least(F.col("max_repeats"), passes.cast("int"))).otherwise(0)
    ).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("documents") / BUCKET_ROWS)).cast("int"))


def mix_sources(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of its shares.

    ``docs`` has ``doc_id, source, n_tokens``; ``targets`` has ``source,
    target_share, max_repeats``. The mixture has ``doc_id, source, epoch,
    n_tokens, finish_time``, one row per use of a document, in the order of
    finish times. Without a ``budget`` (in tokens) it is as long as it can be
    with every source at its share. The report has one row per target.

    - Shares are taken relative to the sources that have documents; a target
      without documents gets nothing and is reported with an actual share of 0.
    - The budget is never exceeded: documents are taken in the order of finish
      times up to the first one that would, so a source is off by about one
      document at most.
    - A budget beyond what a source can give with its repeats makes that
      source fall short; the report shows it.
    - Documents of other or null sources, and documents without tokens (null
      and empty texts), are not used. Null or negative shares count as 0, null
      repeats as 1; shares of a source that is named twice add up.
    - Repeated rows of ``docs`` are documents of their own. Ties in the shuffled
      order go by doc_id, ties in finish time by source, doc_id and epoch.
    - Empty tables give an empty mixture. Other columns are ignored.
    """
    docs = docs.select("doc_id", "source", "n_tokens").where("n_tokens > 0 and source is not null")
    queues = materialize(_queues(docs, targets, budget), "queues")
    uses = F.sum(F.col("documents") * F.col("passes")).over(W.partitionBy(F.lit(0))).alias("documents")
    few = F.broadcast(queues.where("passes > 0").select("source", "weight", "budget", "passes", "buckets", uses))  # one row per target
    used = (
        docs.join(few, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "epoch"))
        .withColumn("bucket", F.floor((F.shiftrightunsigned("turn", 11) / F.lit(float(1 << 53))) * F.col("buckets")).cast("int"))
    )
    place = ["source", "epoch", "bucket"]
    # The order of turns within an epoch is that of buckets, then of the unsigned turn.
    sums = used.groupBy(*place).agg(F.sum("n_tokens").alias("in_bucket"))
    sums = sums.withColumn("ahead", F.sum("in_bucket").over(W.partitionBy("source").orderBy("epoch", "bucket")) - F.col("in_bucket"))
    inner = W.partitionBy(*place).orderBy(F.shiftrightunsigned("turn", 1), "turn", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    timed = (
        used.withColumn("run", F.sum("n_tokens").over(inner))
        .join(sums.select(*place, "ahead"), place)
        .withColumn("finish_time", (F.col("ahead") + F.col("run")) / F.col("weight"))
        .where(F.col("finish_time") <= F.col("budget"))  # no source makes up for another that falls short
    )
    return _cut(timed), queues


def _cut(timed: DataFrame) -> DataFrame:
    """The documents up to the budget, in the order of finish times. Tokens come
    evenly over finish time, so its slices hold about as many each."""
    slices = F.greatest(F.lit(1.0), F.ceil(F.col("documents") / BUCKET_ROWS))
    at = F.floor(F.col("finish_time") / F.col("budget") * slices).cast("bigint")
    t = materialize(timed.select("doc_id", "source", "epoch", "n_tokens", "finish_time", "budget", at.alias("slice")), "timed")
    sums = t.groupBy("slice").agg(F.sum("n_tokens").alias("in_slice"))
    sums = sums.withColumn("before", F.sum("in_slice").over(W.orderBy("slice")) - F.col("in_slice")).select("slice", "before")
    order = ["finish_time", "source", "doc_id", "epoch"]
    run = F.sum("n_tokens").over(W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    kept = t.withColumn("run", run).join(sums, "slice").where(F.col("before") + F.col("run") <= F.col("budget"))
    return kept.select("doc_id", "source", "epoch", "n_tokens", "finish_time").orderBy(*order)


def shares(mixture: DataFrame, queues: DataFrame) -> DataFrame:
    """Target and actual share, tokens, uses and repeats of every target."""
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("epoch").alias("repeats")
    )
    q = queues.select("source", "target_share", "max_repeats", "there", "documents", "budget")
    out = q.join(got, "source", "left").fillna(0, ["tokens", "uses", "repeats"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))  # one row per target
    return out.withColumn("actual_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)))
