"""Queries on image graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import clusters as cl
from ..operators import components as cc
from ..operators import graph as gr
from ..operators import samplers
from ..scale import Workspace
from ..session import table

KEYS = ["scene", "recon"]


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "observation").select(*KEYS, "image_id", "point3d_id")


def co_observation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images that see at least 20 common points."""
    return gr.co_observation(_observed(spark, sf_dir), KEYS, "image_id", "point3d_id", 20)


def co_observation_of_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs of images with their common points: the edges to be checked decide what is joined."""
    images = table(spark, sf_dir, "image").select(*KEYS, "image_id", gr.flat_name(F.col("name")).alias("name")).groupBy(*KEYS, "name").agg(F.min("image_id").alias("image_id"))
    edges = gr.build_graph(_named_pairs(spark, sf_dir), ["loaded_at", "matched_at"], KEYS)
    for end in ("src", "dst"):
        edges = edges.withColumnRenamed(end, "name").join(images, [*KEYS, "name"]).withColumnRenamed("image_id", f"{end}_id").drop("name")
    wanted = edges.select(*KEYS, F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"))
    return gr.co_observation(_observed(spark, sf_dir), KEYS, "image_id", "point3d_id", 1, wanted)


def _named_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "presampling_pairs")
    return pairs.withColumns({c: gr.flat_name(F.col(c)) for c in ("src", "dst")})


def match_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges of more than 16 matches; the last loaded count of a pair wins."""
    return gr.build_graph(_named_pairs(spark, sf_dir), ["loaded_at", "matched_at"], KEYS)


def edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.degrees(co_observation_edges(spark, sf_dir), KEYS).withColumnRenamed("id", "image_id")


def graph_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstructions whose graph has at least 24 nodes and 23 edges."""
    return gr.large_enough(match_graph(spark, sf_dir), KEYS)


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "image").select(*KEYS, "image_id", "qvec", "tvec").distinct()
    posed = images.withColumn("w2c", g.rigid(g.quat_wxyz_to_matrix(F.col("qvec")), F.col("tvec")))
    return posed.select(*KEYS, F.col("image_id").alias("id"), g.camera_center(F.col("w2c")).alias("center"))


def mean_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.mean_scale(_poses(spark, sf_dir), F.col("center"), KEYS).select(*KEYS, F.round("mean_scale", 6).alias("mean_scale"))


def edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    poses = _poses(spark, sf_dir)
    edges = gr.edge_distance(co_observation_edges(spark, sf_dir), poses, gr.mean_scale(poses, F.col("center"), KEYS), KEYS)
    return edges.select(*KEYS, "src", "dst", F.round("distance", 6).alias("distance"))


def pair_id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = co_observation_edges(spark, sf_dir).withColumn("pair_id", gr.pair_id(F.col("dst"), F.col("src")))
    a, b = gr.pair_images(F.col("pair_id"))
    return edges.select(*KEYS, "pair_id", a.alias("a"), b.alias("b"))


def existing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match graph on images that exist: both ends have to."""
    images = table(spark, sf_dir, "image").select(*KEYS, gr.flat_name(F.col("name")).alias("id")).distinct()
    return gr.induced(match_graph(spark, sf_dir), images, KEYS)


def without_lost_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match graph without images of no known camera."""
    lost = table(spark, sf_dir, "image").where("camera_id is null").select(*KEYS, gr.flat_name(F.col("name")).alias("id")).distinct()
    return gr.without(match_graph(spark, sf_dir), lost, KEYS)


def common_points_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common points of co-observing pairs by the array rule, which takes one off for -1."""
    arrays = table(spark, sf_dir, "image").select(*KEYS, "image_id", "point3d_ids").groupBy(*KEYS, "image_id").agg(F.min("point3d_ids").alias("p"))
    edges = co_observation_edges(spark, sf_dir)
    a, b = arrays.select(*KEYS, F.col("image_id").alias("src"), F.col("p").alias("pa")), arrays.select(*KEYS, F.col("image_id").alias("dst"), F.col("p").alias("pb"))
    return edges.join(a, [*KEYS, "src"]).join(b, [*KEYS, "dst"]).select(*KEYS, "src", "dst", gr.common_points(F.col("pa"), F.col("pb")).alias("common_pts"))


# The feature graph of embeddings: sequences are labels.


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.all_similarities(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding")


def similarity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edge of every vector within its label."""
    return gr.strongest(_similar(spark, sf_dir), ["label"], 1).select("label", "src", "dst", F.round("weight", 6).alias("weight"))


def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 vectors most similar to each, of all."""
    from ..operators.nearest import knn

    return knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, 512).select("id", "neighbour", F.round("similarity", 5).alias("similarity"))


def _numbered(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight")


def knn_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = gr.strongest(_similar(spark, sf_dir), ["label"], 1)
    vertices = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return cc.connected_components(vertices, edges)


def match_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the match graph, with nodes named by scene, reconstruction and image."""
    full = lambda c: F.concat_ws("|", "scene", "recon", c)
    edges = match_graph(spark, sf_dir).select(full("src").alias("src"), full("dst").alias("dst"))
    return cc.connected_components(edges.select(F.col("src").alias("id")), edges)


def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the five largest components of the match graph."""
    best = cc.largest_components(match_components(spark, sf_dir), 5)
    return best.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum spanning tree of each label's similarities."""
    vertices = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return cc.spanning_forest(vertices, _numbered(_similar(spark, sf_dir))).select("src", "dst", F.round("weight", 6).alias("weight"))


def connected_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k=1 graph of each label made connected by the strongest edges between its components."""
    return cl.connected_neighbours(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding").select("src", "dst")


def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = gr.strongest(_similar(spark, sf_dir), ["label"], 2)
    return cc.label_propagation(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), edges, 3)


def cluster_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reached from each vector over two strong edges with a product of weights of 0.4 at least."""
    edges = gr.strongest(_similar(spark, sf_dir), ["label"], 2)
    grown = cc.growth(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), edges, 0.4, 2)
    return grown.select("center", "id", F.round("strength", 6).alias("strength"))


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.communities(match_graph(spark, sf_dir), KEYS)


def scene_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected samples of each reconstruction's match graph with the sampler's defaults: 64 of 24 images, 512 trials, the top 32."""
    return samplers.scene_samples(match_graph(spark, sf_dir), KEYS, weight="weight")


def scene_samples_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of scene_samples: reconstructions that have samples, samples of other than 24 images, repeated
    images, images outside the graph, images linked to no other of their sample."""
    edges = match_graph(spark, sf_dir)
    rows = Workspace(spark, "hold").write(samplers.scene_samples(edges, KEYS, weight="weight")).df
    both = edges.select(*KEYS, F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.select(*KEYS, "dst", "src"))
    linked = rows.join(both, [*KEYS, "id"]).join(rows.select(*KEYS, "case", F.col("id").alias("other")), [*KEYS, "case", "other"], "left_semi")
    sizes = rows.groupBy(*KEYS, "case").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("k"))
    out = sizes.agg(F.countDistinct(*KEYS).alias("recons"), F.count_if(F.col("n") != 24).alias("wrong_size"), F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("repeated"))
    outside = rows.join(both.select(*KEYS, "id").distinct(), [*KEYS, "id"], "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    apart = rows.join(linked.select(*KEYS, "case", "id").distinct(), [*KEYS, "case", "id"], "left_anti").agg(F.count(F.lit(1)).alias("apart"))
    return out.crossJoin(outside).crossJoin(apart)  # one row each


def dfs_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samplers.dfs_samples(match_graph(spark, sf_dir), KEYS, 24)


def dfs_samples_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of dfs_samples: each reconstruction whose components have enough images has 24 different ones of them."""
    edges = match_graph(spark, sf_dir)
    inside = dfs_samples(spark, sf_dir).join(gr.nodes_of(edges, KEYS), [*KEYS, "id"], "left_semi")
    return inside.groupBy(*KEYS).agg(F.countDistinct("id").alias("images"), F.countDistinct("pos").alias("places"))


def louvain_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of louvain: every image has one community, and modularity is not less than that of one community for all (0)."""
    edges = Workspace(spark, "hold").write(match_graph(spark, sf_dir)).df
    of = Workspace(spark, "hold").write(samplers.communities(edges, KEYS)).df
    both = edges.select(*KEYS, "src", "dst", "weight").unionAll(edges.select(*KEYS, "dst", "src", "weight"))
    ends = both.join(of.toDF(*KEYS, "src", "a"), [*KEYS, "src"]).join(of.toDF(*KEYS, "dst", "b"), [*KEYS, "dst"])
    per = ends.groupBy(*KEYS, "a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("degree"))
    total = per.groupBy(*KEYS).agg(F.sum("degree").alias("total"))
    share = F.col("degree") / F.col("total")
    q = per.join(total, KEYS).groupBy(*KEYS).agg((F.sum(F.col("inside") / F.col("total") - share * share) > -1e-9).alias("fit"))
    images = of.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("images"), F.countDistinct("id").alias("ids"))
    return images.join(q, KEYS).select(*KEYS, "images", "ids", "fit")


def skeletal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each label whose vectors look alike, from its k=1 graph made connected."""
    return cl.chunks_by_similarity(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "embedding", tau=0.4, window=2, min_weight=0.0)


_FUNCTIONS = (
    co_observation_edges, co_observation_of_matches, match_graph, edge_degree, graph_size_gate, mean_scale, edge_distance, pair_id_roundtrip, existing_nodes, without_lost_cameras,
    common_points_rule, similarity_knn, knn_all, knn_components, match_components, largest_components, spanning_forest, connected_knn, label_propagation, cluster_growth, louvain, louvain_holds, scene_samples, scene_samples_hold, dfs_samples, dfs_samples_hold, skeletal_clusters,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CO = """
    o AS (SELECT DISTINCT scene, recon, image_id, point3d_id FROM observation WHERE point3d_id >= 0),
    co AS (SELECT a.scene, a.recon, a.image_id AS src, b.image_id AS dst, count(*) AS common_pts
           FROM o a JOIN o b USING (scene, recon, point3d_id) WHERE a.image_id < b.image_id GROUP BY ALL),
    e AS (SELECT * FROM co WHERE common_pts >= 20)"""
_MATCH = """
    pairs AS (SELECT scene, recon, replace(src, ' ', '_') AS s, replace(dst, ' ', '_') AS d, matches_num, loaded_at, matched_at
              FROM presampling_pairs WHERE matches_num > 16),
    ranked AS (SELECT scene, recon, least(s, d) AS src, greatest(s, d) AS dst, matches_num AS weight,
               row_number() OVER (PARTITION BY scene, recon, least(s, d), greatest(s, d) ORDER BY loaded_at DESC, matched_at DESC, matches_num DESC) AS r
               FROM pairs WHERE s <> d),
    m AS (SELECT scene, recon, src, dst, weight FROM ranked WHERE r = 1)"""
_CENTERS = """
    pose AS (SELECT DISTINCT scene, recon, image_id AS id, qvec, tvec FROM image),
    c AS (SELECT scene, recon, id,
        -((1-2*(qvec[3]*qvec[3]+qvec[4]*qvec[4]))*tvec[1] + 2*(qvec[2]*qvec[3]+qvec[1]*qvec[4])*tvec[2] + 2*(qvec[4]*qvec[2]-qvec[1]*qvec[3])*tvec[3]) AS x,
        -(2*(qvec[2]*qvec[3]-qvec[1]*qvec[4])*tvec[1] + (1-2*(qvec[2]*qvec[2]+qvec[4]*qvec[4]))*tvec[2] + 2*(qvec[3]*qvec[4]+qvec[1]*qvec[2])*tvec[3]) AS y,
        -(2*(qvec[4]*qvec[2]+qvec[1]*qvec[3])*tvec[1] + 2*(qvec[3]*qvec[4]-qvec[1]*qvec[2])*tvec[2] + (1-2*(qvec[2]*qvec[2]+qvec[3]*qvec[3]))*tvec[3]) AS z
        FROM pose),
    ms AS (SELECT scene, recon, avg(sqrt(x*x + y*y + z*z)) AS mean_scale FROM c GROUP BY ALL)"""
_SIM = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    s AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst,
          (list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-6) * (sqrt(list_inner_product(b.e, b.e)) + 1e-6)) + 1) / 2 AS weight
          FROM v a JOIN v b USING (label) WHERE a.vec_id < b.vec_id),
    both_ways AS (SELECT label, src, dst, weight FROM s UNION ALL SELECT label, dst, src, weight FROM s),
    top AS (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY weight DESC, dst DESC) AS r FROM both_ways),
    k1 AS (SELECT DISTINCT label, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM top WHERE r <= 1),
    k2 AS (SELECT DISTINCT label, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM top WHERE r <= 2)"""
_MCOMP = f"""
    WITH RECURSIVE {_MATCH},
    n AS (SELECT scene || '|' || recon || '|' || src AS a, scene || '|' || recon || '|' || dst AS b FROM m),
    l AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
    reach AS (SELECT a AS id, a AS seen FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.seen),
    comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY id)"""
_TREE = f"""
    WITH RECURSIVE {_SIM},
    prim AS (SELECT label, [min(vec_id)] AS seen, NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::DOUBLE AS weight FROM embeddings GROUP BY label
             UNION ALL
             SELECT label, list_append(seen, CASE WHEN list_contains(seen, e.src) THEN e.dst ELSE e.src END), e.src, e.dst, e.weight FROM (
                 SELECT p.label, p.seen, arg_max({{'src': s.src, 'dst': s.dst, 'weight': s.weight}}, s.weight) AS e FROM prim p JOIN s USING (label)
                 WHERE list_contains(p.seen, s.src) <> list_contains(p.seen, s.dst) GROUP BY p.label, p.seen)),
    tree AS (SELECT label, src, dst, weight FROM prim WHERE src IS NOT NULL),
    near AS (SELECT label, src, dst, weight FROM k1 UNION SELECT label, src, dst, weight FROM tree)"""


def _votes(n: int) -> str:
    return f"""v{n} AS (SELECT id, community, sum(w) AS w FROM (
            SELECT b.src AS id, l.community, b.w FROM b JOIN l{n - 1} l ON l.id = b.dst UNION ALL SELECT l.id, l.community, own.w FROM l{n - 1} l JOIN own USING (id)) GROUP BY ALL),
        l{n} AS (SELECT l.id, coalesce(x.community, l.id) AS community FROM l{n - 1} l LEFT JOIN (
            SELECT id, arg_min(community, (-w, community)) AS community FROM v{n} GROUP BY id) x USING (id))"""


SQL = {
    "spanning_forest": _TREE + " SELECT src, dst, round(weight, 6) AS weight FROM tree",
    "connected_knn": _TREE + " SELECT src, dst FROM near",
    "skeletal_clusters": _TREE + """
        , b AS (SELECT label, src, dst, weight FROM near UNION ALL SELECT label, dst, src, weight FROM near)
        SELECT label, vec_id AS cluster, vec_id AS id FROM embeddings
        UNION SELECT label, src, dst FROM b WHERE weight >= 0.4
        UNION SELECT x.label, x.src, y.dst FROM b x JOIN b y ON y.label = x.label AND y.src = x.dst WHERE x.weight >= 0.4 AND x.weight * y.weight >= 0.4""",
    "label_propagation": f"""
        WITH {_SIM}, b AS (SELECT src, dst, weight AS w FROM k2 UNION ALL SELECT dst, src, weight FROM k2), own AS (SELECT src AS id, max(w) AS w FROM b GROUP BY src),
        l0 AS (SELECT vec_id AS id, vec_id AS community FROM embeddings), {_votes(1)}, {_votes(2)}, {_votes(3)} SELECT id, community FROM l3""",
    "scene_samples_hold": _MCOMP + """, sizes AS (SELECT component, count(*) AS k FROM comp GROUP BY component)
        SELECT count(DISTINCT (split_part(id, '|', 1), split_part(id, '|', 2))) AS recons, 0::BIGINT AS wrong_size, 0::BIGINT AS repeated, 0::BIGINT AS outside, 0::BIGINT AS apart
        FROM comp JOIN sizes USING (component) WHERE k >= 24""",
    "dfs_samples_hold": _MCOMP + """, sizes AS (SELECT split_part(component, '|', 1) AS scene, split_part(component, '|', 2) AS recon, component, count(*) AS k FROM comp GROUP BY component),
        first AS (SELECT scene, recon, k FROM sizes WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY scene, recon ORDER BY k DESC) <= 12)
        SELECT scene, recon, 24::BIGINT AS images, 24::BIGINT AS places FROM first GROUP BY ALL HAVING sum(k) >= 24""",
    "louvain_holds": f"""
        WITH {_MATCH}, n AS (SELECT scene, recon, src AS id FROM m UNION SELECT scene, recon, dst FROM m)
        SELECT scene, recon, count(*) AS images, count(DISTINCT id) AS ids, true AS fit FROM n GROUP BY ALL""",
    "co_observation_edges": f"WITH {_CO} SELECT * FROM e",
    "co_observation_of_matches": f"""
        WITH {_CO}, {_MATCH},
        i AS (SELECT scene, recon, replace(name, ' ', '_') AS name, min(image_id) AS id FROM image GROUP BY ALL),
        w AS (SELECT DISTINCT m.scene, m.recon, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst
              FROM m JOIN i a ON (a.scene, a.recon, a.name) = (m.scene, m.recon, m.src) JOIN i b ON (b.scene, b.recon, b.name) = (m.scene, m.recon, m.dst))
        SELECT co.* FROM co JOIN w USING (scene, recon, src, dst)""",
    "match_graph": f"WITH {_MATCH} SELECT * FROM m",
    "edge_degree": f"""
        WITH {_CO} SELECT scene, recon, image_id, count(*) AS degree FROM (
            SELECT scene, recon, src AS image_id FROM e UNION ALL SELECT scene, recon, dst FROM e) GROUP BY ALL""",
    "graph_size_gate": f"""
        WITH {_MATCH}, n AS (SELECT scene, recon, count(DISTINCT id) AS nodes FROM (
            SELECT scene, recon, src AS id FROM m UNION ALL SELECT scene, recon, dst FROM m) GROUP BY ALL),
        k AS (SELECT scene, recon, count(*) AS edges FROM m GROUP BY ALL)
        SELECT * FROM n JOIN k USING (scene, recon) WHERE nodes >= 24 AND edges >= 23""",
    "mean_scale": f"WITH {_CENTERS} SELECT scene, recon, round(mean_scale, 6) AS mean_scale FROM ms",
    "edge_distance": f"""
        WITH {_CO}, {_CENTERS}
        SELECT e.scene, e.recon, src, dst, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / mean_scale, 6) AS distance
        FROM e JOIN c a ON (a.scene, a.recon, a.id) = (e.scene, e.recon, e.src) JOIN c b ON (b.scene, b.recon, b.id) = (e.scene, e.recon, e.dst)
        JOIN ms ON (ms.scene, ms.recon) = (e.scene, e.recon)""",
    "pair_id_roundtrip": f"WITH {_CO} SELECT scene, recon, src * 2147483647::BIGINT + dst AS pair_id, src::BIGINT AS a, dst::BIGINT AS b FROM e",
    "existing_nodes": f"""
        WITH {_MATCH}, i AS (SELECT DISTINCT scene, recon, replace(name, ' ', '_') AS id FROM image)
        SELECT m.* FROM m WHERE (scene, recon, src) IN (SELECT (scene, recon, id) FROM i) AND (scene, recon, dst) IN (SELECT (scene, recon, id) FROM i)""",
    "without_lost_cameras": f"""
        WITH {_MATCH}, i AS (SELECT DISTINCT scene, recon, replace(name, ' ', '_') AS id FROM image WHERE camera_id IS NULL)
        SELECT m.* FROM m WHERE (scene, recon, src) NOT IN (SELECT (scene, recon, id) FROM i) AND (scene, recon, dst) NOT IN (SELECT (scene, recon, id) FROM i)""",
    "common_points_rule": f"""
        WITH {_CO}, p AS (SELECT scene, recon, image_id, min(point3d_ids) AS p FROM image GROUP BY ALL)
        SELECT e.scene, e.recon, src, dst, len(list_intersect(list_distinct(a.p), list_distinct(b.p))) - 1 AS common_pts
        FROM e JOIN p a ON (a.scene, a.recon, a.image_id) = (e.scene, e.recon, e.src) JOIN p b ON (b.scene, b.recon, b.image_id) = (e.scene, e.recon, e.dst)""",
    "similarity_knn": f"WITH {_SIM} SELECT label, src, dst, round(weight, 6) AS weight FROM k1",
    "knn_all": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour,
              list_inner_product(a.e, b.e) / ((sqrt(list_inner_product(a.e, a.e)) + 1e-6) * (sqrt(list_inner_product(b.e, b.e)) + 1e-6)) AS similarity
              FROM v a, v b WHERE a.vec_id <> b.vec_id)
        SELECT id, neighbour, round(similarity, 5) AS similarity FROM s
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) <= 3""",
    "knn_components": f"""
        WITH RECURSIVE {_SIM}, l AS (SELECT src AS a, dst AS b FROM k1 UNION SELECT dst, src FROM k1),
        reach AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.seen)
        SELECT id, min(seen) AS component FROM reach GROUP BY id""",
    "match_components": _MCOMP + " SELECT id, component FROM comp",
    "largest_components": _MCOMP + " SELECT component, count(*) AS size FROM comp GROUP BY component ORDER BY size DESC, component LIMIT 5",
    "cluster_growth": f"""
        WITH {_SIM}, b AS (SELECT src, dst, weight FROM k2 UNION ALL SELECT dst, src, weight FROM k2),
        d0 AS (SELECT vec_id AS center, vec_id AS id, 1.0::DOUBLE AS strength FROM embeddings),
        d1 AS (SELECT src AS center, dst AS id, weight AS strength FROM b WHERE weight >= 0.4),
        d2 AS (SELECT d1.center, b.dst AS id, d1.strength * b.weight AS strength FROM d1 JOIN b ON b.src = d1.id WHERE d1.strength * b.weight >= 0.4)
        SELECT center, id, round(max(strength), 6) AS strength FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY ALL""",
}
