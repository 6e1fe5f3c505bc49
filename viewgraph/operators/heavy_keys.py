"""Per-key results where a few keys hold most rows.

The method: map-side combining with native aggregates. Tasks fold their rows into tables of
mergeable states that spill, and only those states are shuffled; a hot key costs the shuffle one state a task.

Repeated rows and distinct values need rows side by side, so the finer keys that a key falls into
(such as the scenes of a name) and buckets of the values are one shuffle key: rows travel once, folded into
sets, and repeated rows, distinct values, counts and sums are all taken from that one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Workspace

#: Values, or places of rows without a value, that one bucket may hold.
BUCKET = 1 << 16


def folded(rows: DataFrame, parts: list[str], identity: list[str], carried: list[str], bucket: Column) -> DataFrame:
    """Distinct rows (parts, bucket, identity, carried), in one shuffle by parts and bucket.

    Rows that agree in all these columns are one; those that differ in any are several. Each task folds its
    rows into sets first, so a row repeated at will is shuffled once a task, and what names a part is shuffled once for
    its set. bucket must be a function of identity and carried, and bounds what a set holds.
    """
    sets = rows.withColumn("bucket", bucket).groupBy(*parts, "bucket").agg(F.collect_set(F.struct(*identity, *carried)).alias("set"))
    return sets.select(*parts, "bucket", F.inline("set"))


def key_profile(rows: DataFrame, key: str, within: list[str], value: str | None = None, group: str | None = None, means: dict[str, str] = {}, names: tuple[str, str] = ("values", "groups")) -> DataFrame:  # noqa: B006
    """key, rows, values, groups, a mean for each of means, total.

    rows: distinct ones with a bucket, partitioned by key, within and bucket, as folded gives them. values: how many
    distinct combinations of within and value a key has; a null value is none. value must be what bucket comes from where it
    isn't null, so that equal values share a bucket. groups: how many distinct values of the column
    group (one of within) a key has. Both counts are left out where no column is named; names renames them. means: name of
    a mean -> column; nulls are left out, and a mean of nothing is null. total counts the rows of all keys. Rows with a
    null key count in total but have no result. The profile is written to the shared folder, whole.
    """
    sums = {f"__s_{n}": F.sum(c) for n, c in means.items()} | {f"__c_{n}": F.count(c) for n, c in means.items()}
    state, counts = {"__rows": F.count(F.lit(1))} | sums, []
    out = rows.withColumn("__key", F.col(key))
    if value is not None:
        out = out.groupBy(key, *within, "bucket", "__key", value).agg(*[v.alias(n) for n, v in state.items()])
        state = {n: F.sum(n) for n in state} | {"__values": F.count(value)}
        counts.append(F.col("__values").alias(names[0]))
    if group is not None:
        out = out.groupBy("__key", group).agg(*[v.alias(n) for n, v in state.items()])
        state = {n: F.sum(n) for n in state} | {"__groups": F.count(group)}
        counts.append(F.col("__groups").alias(names[1]))
    out = out.groupBy("__key").agg(*[v.alias(n) for n, v in state.items()])
    average = [(F.col(f"__s_{n}") / F.col(f"__c_{n}")).alias(n) for n in means]
    named = out.select(F.col("__key").alias(key), F.col("__rows").alias("rows"), *counts, *average)
    done = Workspace(rows.sparkSession, "profile").write(named, F.sum("rows"))
    return done.df.where(F.col(key).isNotNull()).withColumn("total", F.lit(done.mark).cast("long"))


def heavy(profile: DataFrame, parts: int = 50) -> DataFrame:
    """The keys of a profile with more than one part in `parts` of all rows: fewer than parts of them."""
    return profile.where(F.col("rows") > F.expr(f"total div {int(parts)}"))
