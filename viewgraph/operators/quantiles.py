"""Exact quantiles of groups of any size, by refining histograms: only counts of buckets are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import BROADCAST_NAMES, Workspace, small

#: Buckets of a bracket in a round.
BUCKETS = 1000
#: Values of a bracket that one aggregate may hold at the end.
HELD = 100_000


def quantile(rows: DataFrame, keys: list[str], column: str, share: float, held: int = HELD) -> DataFrame:
    """keys, value: the share-quantile of a column, between two neighbours in proportion, as percentile() has it.

    percentile() keeps all distinct values of a group in one task. Here each wanted place has a bracket of values, at first
    all of its group; a round counts the bracket's values in BUCKETS buckets, and the bucket that holds the place is the next
    bracket. When no bracket has more than `held` values or different ones, the rest is sorted. rows is read once a
    round; write it first if it is costly. Nulls, NaN and infinite values don't count; groups without values give nothing.
    """
    space = Workspace(rows.sparkSession, "quantiles")
    plain = rows.select(*keys, F.col(column).cast("double").alias("__v")).where("__v is not null and abs(__v) < double('infinity')")
    at = F.lit(float(share)) * (F.col("__n") - 1)
    whole = plain.groupBy(*keys).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
    places = F.explode(F.array(F.struct(F.floor(at).alias("place"), (1 - at + F.floor(at)).alias("part")), F.struct(F.ceil(at).alias("place"), (at - F.floor(at)).alias("part"))))
    state = whole.withColumn("__p", places).select(*keys, F.col("__p.place").alias("__place"), F.col("__p.part").alias("__part"), "__low", "__high", F.lit(0).cast("long").alias("__below"), "__n")
    half = F.col("__high") / 2 - F.col("__low") / 2  # of halves, as the difference may be infinite
    large = (F.col("__n") > held) & (half > 0)
    now = space.write(state, F.count_if(large))

    def inside(brackets: DataFrame, n: int) -> DataFrame:
        side = small(brackets, n, BROADCAST_NAMES)
        both = plain.join(side, keys) if keys else plain.join(F.broadcast(brackets))  # without keys two rows
        return both.where((F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))

    names = [*keys, "__place", "__part"]
    while now.mark:
        bucket = F.least(F.floor((F.col("__v") / 2 - F.col("__low") / 2) / half * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside(now.df.where(large), now.rows).groupBy(*names, "__below", bucket.alias("__b")).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
        up_to = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # of at most BUCKETS rows
        before = F.col("__below") + F.coalesce(F.sum("__n").over(up_to), F.lit(0))
        held_by = counts.withColumn("__before", before).where((F.col("__before") <= F.col("__place")) & (F.col("__before") + F.col("__n") > F.col("__place")))
        after = held_by.select(*names, "__low", "__high", F.col("__before").alias("__below"), "__n")
        now = space.write(now.df.where(~large).unionByName(after), F.count_if(large))
    flat = F.col("__low") >= F.col("__high")
    few = inside(now.df.where(~flat), now.rows).groupBy(*names, "__below").agg(F.array_sort(F.collect_list("__v")).alias("__s"))
    found = few.select(*names, F.get("__s", (F.col("__place") - F.col("__below")).cast("int")).alias("__v"))
    found = found.unionByName(now.df.where(flat).select(*names, F.col("__low").alias("__v")))
    return found.groupBy(*keys).agg(F.sum(F.col("__v") * F.col("__part")).alias("value"))
