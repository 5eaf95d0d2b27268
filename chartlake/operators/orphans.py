"""References to records that are missing, deleted or newer than the reference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    target: DataFrame,
    on: Sequence[tuple[str, str]],
    match: str = "simple",
    ref_time: str | None = None,
    target_time: str | None = None,
) -> DataFrame:
    """The rows of ``refs`` whose key finds no row of ``target``, with
    ``reason``: ``missing``, or ``late`` if a target row was created after
    ``ref_time``.

    ``on`` pairs the columns of a composite key. References are grouped by
    their null mask and each mask is anti-joined on its non-null columns, as
    the declared ``match`` says (the rules of SQL foreign keys):

    - ``simple``: a key with any null refers to nothing, so it is no orphan;
    - ``full``: a key that is partly null is an orphan, one that is null
      throughout refers to nothing;
    - ``partial``: the non-null columns must be found together in one row.

    A null time is never late. Repeated references are all returned; repeated
    targets count once. An empty target makes all references orphans; extra
    columns of ``refs`` are kept, those of ``target`` never appear. Texts are
    compared as they are: normalise them first.
    """
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}")
    if "reason" in refs.columns:
        refs = refs.drop("reason")
    timed = ref_time is not None and target_time is not None
    out = []
    for mask in product((True, False), repeat=len(on)):
        if not any(mask):  # null throughout: refers to nothing
            continue
        test = reduce(lambda a, b: a & b, [F.col(r).isNotNull() if m else F.col(r).isNull() for (r, _), m in zip(on, mask)])
        if not all(mask):
            if match == "simple":
                continue
            if match == "full":
                out.append(refs.where(test).withColumn("reason", F.lit("missing")))
                continue
        used = [(r, f"__t{i}") for i, ((r, _), m) in enumerate(zip(on, mask)) if m]
        keys = [F.col(t).alias(f"__t{i}") for i, ((_, t), m) in enumerate(zip(on, mask)) if m]
        born = F.max(target_time) if timed else F.lit(None).cast("timestamp")
        there = target.groupBy(*keys).agg(born.alias("__born"), F.lit(True).alias("__hit"))
        there = there.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for _, k in used]))
        # The anti-join: rows without a hit. The hit's age comes with it, so
        # that missing and late references need one join.
        joined = refs.where(test).join(there, reduce(lambda a, b: a & b, [refs[r] == there[k] for r, k in used]), "left")
        late = (F.col("__born") > F.col(ref_time)) if timed else F.lit(False)
        out.append(
            joined.withColumn("reason", F.when(F.col("__hit").isNull(), "missing").when(late, "late"))
            .where("reason is not null")
            .select(*refs.columns, "reason")
        )
    return reduce(DataFrame.unionByName, out)
