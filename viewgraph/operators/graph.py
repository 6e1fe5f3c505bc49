"""Image graphs: building, filtering and co-observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import center_distance
from ..schema import PAIR_BASE

MIN_MATCHES = 16
MIN_COMMON_POINTS = 50
MIN_NODES, MIN_EDGES = 24, 23


def pair_id(a: Column, b: Column) -> Column:
    """The key of a pair of image ids, the same in either order."""
    return F.least(a, b).cast("long") * PAIR_BASE + F.greatest(a, b).cast("long")


def pair_images(pair: Column) -> tuple[Column, Column]:
    """The image ids of a key. The quotient is under 2^31, so rounding the double one is exact."""
    second = F.pmod(pair, F.lit(PAIR_BASE))
    return F.round((pair - second) / PAIR_BASE).cast("long"), second


def flat_name(name: Column) -> Column:
    """A name as databases write it: blanks as underscores."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def build_graph(matches: DataFrame, order: list[str], keys: list[str] = ["scene", "recon"], weight: str = "matches_num", least: int | None = MIN_MATCHES) -> DataFrame:  # noqa: B006
    """keys, src < dst, weight: undirected edges; of repeated pairs the last in `order` wins. Only pairs
    of more than `least` matches count; those with null ends or counts don't. Isolated images are no part of a graph."""
    rows = matches.where(F.col(weight).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    if least is not None:
        rows = rows.where(F.col(weight) > least)
    rows = rows.where("src <> dst").select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight, *order)
    last = F.max_by(weight, F.struct(*order, weight)).alias("weight")
    return rows.groupBy(*keys, "a", "b").agg(last).withColumnsRenamed({"a": "src", "b": "dst"})


def nodes_of(edges: DataFrame, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    return edges.select(*keys, F.col("src").alias("id")).unionAll(edges.select(*keys, F.col("dst").alias("id"))).distinct()


def induced(edges: DataFrame, nodes: DataFrame, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    """Edges with both ends among nodes (keys, id)."""
    columns = edges.columns
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*keys, F.col("id").alias(end)), [*keys, end], "left_semi")
    return edges.select(*columns)


def without(edges: DataFrame, nodes: DataFrame, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    """Edges with no end among nodes (keys, id)."""
    columns = edges.columns
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(*keys, F.col("id").alias(end)), [*keys, end], "left_anti")
    return edges.select(*columns)


def co_observation(observed: DataFrame, keys: list[str], image: str, point: str, least: int = 1, edges: DataFrame | None = None) -> DataFrame:
    """keys, src < dst, common_pts: images and the number of distinct points that both see.

    One equi-join on the point, with pre-aggregated counts; a point below 0 or null is none. With edges, only
    their pairs are counted (edges has keys, src, dst). Points seen by very many images go through
    the skew split of adaptive execution; nothing is dropped.
    """
    seen = observed.where(F.col(point) >= 0).select(*keys, F.col(image).alias("i"), F.col(point).alias("p")).distinct()
    a, b = seen.withColumnRenamed("i", "src"), seen.withColumnRenamed("i", "dst")
    if edges is not None:
        wanted = edges.select(*keys, "src", "dst").distinct()
        pairs = a.join(wanted, [*keys, "src"]).join(b, [*keys, "dst", "p"])
    else:
        pairs = a.join(b, [*keys, "p"]).where("src < dst")
    return pairs.groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("common_pts")).where(F.col("common_pts") >= least)


def common_points(a: Column, b: Column) -> Column:
    """Common points of two arrays of point ids by the rule of the original graphs: the size of the
    intersection as sets, less one, which assumes that both hold -1."""
    return F.size(F.array_intersect(a, b)) - 1


def degrees(edges: DataFrame, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    ends = edges.select(*keys, F.col("src").alias("id")).unionAll(edges.select(*keys, F.col("dst").alias("id")))
    return ends.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("degree"))


def mean_scale(poses: DataFrame, center: Column, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    """keys, mean_scale: the mean distance of camera centres from the world's origin."""
    c = [F.get(center, F.lit(i)) for i in range(3)]
    return poses.groupBy(*keys).agg(F.avg(F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])).alias("mean_scale"))


def edge_distance(edges: DataFrame, centers: DataFrame, scales: DataFrame, keys: list[str] = ["scene", "recon"]) -> DataFrame:  # noqa: B006
    """Edges with distance: that of the camera centres over the mean scale. centers: keys, id, center."""
    a = centers.select(*keys, F.col("id").alias("src"), F.col("center").alias("ca"))
    b = centers.select(*keys, F.col("id").alias("dst"), F.col("center").alias("cb"))
    out = edges.drop("distance").join(a, [*keys, "src"]).join(b, [*keys, "dst"]).join(scales, keys)
    return out.withColumn("distance", center_distance(F.col("ca"), F.col("cb")) / F.col("mean_scale")).drop("ca", "cb", "mean_scale")


def large_enough(edges: DataFrame, keys: list[str] = ["scene", "recon"], nodes: int = MIN_NODES, links: int = MIN_EDGES) -> DataFrame:  # noqa: B006
    """The graphs (keys, nodes, edges) with at least so many nodes and edges in all."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("id")).groupBy(*keys).agg(F.countDistinct("id").alias("nodes"))
    size = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))
    return ends.join(size, keys).where((F.col("nodes") >= nodes) & (F.col("edges") >= links))


# Nearest-neighbour graphs


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, with 1e-6 added to the norms."""
    sum_of = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return sum_of(a, b) / ((F.sqrt(sum_of(a, a)) + 1e-6) * (F.sqrt(sum_of(b, b)) + 1e-6))


def all_similarities(features: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    """keys, src < dst, weight: (cosine + 1) / 2 of the pairs of one group, such as the images of a sequence.

    Pairs stay within a group, and groups are the images of one sequence; for nearest neighbours over
    everything see nearest.knn, which compares blocks and keeps only the best.
    """
    a = features.select(*keys, F.col(id_col).alias("src"), F.col(vector).alias("va"))
    b = features.select(*keys, F.col(id_col).alias("dst"), F.col(vector).alias("vb"))
    return a.join(b, keys).where("src < dst").select(*keys, "src", "dst", ((cosine(F.col("va"), F.col("vb")) + 1) / 2).alias("weight"))


def strongest(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The undirected edges (src < dst) that are among the k strongest of either end; ties go to the greater neighbour."""
    both = edges.select(*keys, "src", "dst", "weight").unionAll(edges.select(*keys, F.col("dst"), F.col("src"), "weight"))
    w = Window.partitionBy(*keys, "src").orderBy(F.col("weight").desc(), F.col("dst").desc())
    top = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").distinct().withColumnsRenamed({"a": "src", "b": "dst"})
