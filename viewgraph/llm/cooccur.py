"""Items that appear together.

The method: basket collapsing. Identical sets of items become one basket with a weight, pairs
are enumerated once per distinct basket, and their weights are summed before and after the
shuffle. Baskets are first put in order, in ranges of equal weight that no basket is too hot for, as each
occurs once: those that share items come to the same task, which sums their pairs before the shuffle. Long
baskets are cut into blocks; a row then holds two blocks at most, and the pairs of a basket of any length are
enumerated by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import BROADCAST_NAMES, Workspace, small

#: Items in a block; a task enumerates at most BLOCK² pairs from a row.
BLOCK = 128


def baskets(records: DataFrame, record: str, items: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """group_cols, basket (sorted distinct items), weight (number of records with that set).

    A record named by several rows, equal or not, holds the items of all of them once. Null
    items, null or empty arrays and null records give nothing.
    """
    rows = records.select(*group_cols, F.col(record).alias("record"), F.array_sort(F.array_distinct(F.array_compact(items))).alias("basket"))
    rows = rows.where(F.col("record").isNotNull() & (F.size("basket") > 0))
    # Sets of the same record: equal ones fold before the shuffle, so a record repeated at will stays small.
    rows = rows.groupBy(*group_cols, "record").agg(F.collect_set("basket").alias("sets"))
    one = F.when(F.size("sets") == 1, F.element_at("sets", 1)).otherwise(F.array_sort(F.array_distinct(F.flatten("sets"))))
    return rows.select(*group_cols, one.alias("basket")).groupBy(*group_cols, "basket").agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence(records: DataFrame, record: str, items: str, group_cols: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """One row per pair of items of a group in at least `least` common records:
    group_cols, item_a < item_b, n_ab, n_a, n_b, n, lift, conviction.

    n counts the records of the group that hold any item. lift = n_ab n / (n_a n_b) is the ratio
    to the number expected by chance. conviction of a -> b = (1 - n_b / n) / (1 - n_ab / n_a); it is
    null where a never comes without b. Null group columns match nothing and give no rows.
    """
    space = Workspace(records.sparkSession, "cooccurrence")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = space.write(baskets(records, record, items, group_cols).repartitionByRange(tasks, *group_cols, "basket")).df
    partners = F.when(F.col("same"), F.slice("right", F.col("p") + 2, BLOCK)).otherwise(F.col("right"))

    def enumerated(halves: DataFrame) -> DataFrame:
        firsts = halves.select(*group_cols, "weight", F.posexplode("left").alias("p", "item_a"), "same", "right")
        return firsts.select(*group_cols, "weight", "item_a", F.explode(partners).alias("item_b"))

    short = found.where((F.size("basket") > 1) & (F.size("basket") <= BLOCK))
    pairs = enumerated(short.select(*group_cols, "weight", F.col("basket").alias("left"), F.lit(True).alias("same"), F.col("basket").alias("right")))
    n_blocks = F.ceil(F.size("basket") / BLOCK).cast("int")
    block = lambda i: F.slice("basket", F.col(i) * BLOCK + 1, F.lit(BLOCK))
    long = found.where(F.size("basket") > BLOCK).select(*group_cols, "weight", "basket", n_blocks.alias("n"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("i"))
    long = long.select(*group_cols, "weight", "basket", "i", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j"))
    halves = long.select(*group_cols, "weight", block("i").alias("left"), (F.col("i") == F.col("j")).alias("same"), block("j").alias("right"))
    pairs = pairs.unionAll(enumerated(halves.repartition(tasks)))
    together = pairs.groupBy(*group_cols, "item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= least)

    single = found.select(*group_cols, "weight", F.explode("basket").alias("item")).groupBy(*group_cols, "item").agg(F.sum("weight").alias("n_item"))
    totals = space.write(found.groupBy(*group_cols).agg(F.sum("weight").alias("n")))
    # A group, or an item with its many partners, may hold most rows: both sides of the joins are tables or exchanges, so that a hot
    # key is broadcast or split, and single is written for that.
    if group_cols:
        single = space.write(single.join(small(totals.df, totals.rows, BROADCAST_NAMES), list(group_cols)))
    else:
        single = space.write(single.crossJoin(F.broadcast(totals.df)))  # one row, not a cross join of tables
    of_a = single.df.select(*group_cols, F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    of_b = single.df.select(*group_cols, F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    together = space.write(together)
    out = together.df
    for side, end in ((of_a, "item_a"), (of_b, "item_b")):
        out = out.join(small(side, single.rows, BROADCAST_NAMES), [*group_cols, end])
    share = lambda a, b: F.col(a).cast("double") / F.col(b)
    product = lambda a, b: F.col(a).cast("double") * F.col(b)  # noqa: E731  # of longs it would overflow
    lift = product("n_ab", "n") / product("n_a", "n_b")
    conviction = F.when(F.col("n_ab") < F.col("n_a"), (1 - share("n_b", "n")) / (1 - share("n_ab", "n_a")))
    return out.select(*group_cols, "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), conviction.alias("conviction"))


def at_least_times_chance(times: int) -> Column:
    """Whether n_ab n >= times n_a n_b, in whole numbers of 38 digits: exact for counts up to 10^18."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return whole("n_ab") * whole("n") >= whole("n_a") * whole("n_b") * F.lit(times).cast("decimal(3,0)")
