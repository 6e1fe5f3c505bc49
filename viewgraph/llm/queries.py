"""The queries of the problems for training data, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import Workspace, attach
from ..session import table
from .consolidate import consolidate
from .cooccur import at_least_times_chance, cooccurrence
from .leaks import leaked_passages
from .overlap import expand, overlaps, photo_of
from .packing import pack, unused
from .sentences import sentence_spans
from .splits import assign_splits, related_groups

GRAPH = ("scene", "recon")


# 1: groups of matched images


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, recon, name, group_name for every name linked by more than 16 matches."""
    pairs = table(spark, sf_dir, "presampling_pairs").where(F.col("matches_num") > 16)
    name = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_")).alias(c)
    return consolidate(pairs.select(*GRAPH, name("src"), name("dst")), graph_cols=GRAPH)


# 2: the same photos in train and in val or test


def _sample_overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    photos = F.transform(F.map_keys("imgs"), photo_of)
    return overlaps(table(spark, sf_dir, "sampled_case"), "sample_uid", "split", photos)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_uid_a < sample_uid_b: samples of train and of val or test with similar photos."""
    pairs = expand(*_sample_overlaps(spark, sf_dir))
    a, b = F.least("record_eval", "record_train"), F.greatest("record_eval", "record_train")
    return pairs.where(a < b).select(a.alias("sample_uid_a"), b.alias("sample_uid_b")).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, scene_recon_name, n_pairs, n_samples (of the split that overlap with train)."""
    pairs = expand(*_sample_overlaps(spark, sf_dir))
    source = table(spark, sf_dir, "sampled_case").where(F.col("split").isin("val", "test"))
    source = source.select(F.col("sample_uid").alias("record_eval"), F.col("split").alias("split_eval"), "scene_recon_name").distinct()
    per = pairs.groupBy("record_eval", "split_eval").agg(F.count(F.lit(1)).alias("n"))
    out = per.join(source, ["record_eval", "split_eval"]).groupBy(F.col("split_eval").alias("split"), "scene_recon_name")
    return out.agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_samples"))


# 3: images that see the same points


def _images(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    pairs = cooccurrence(table(spark, sf_dir, "point3d"), "point3d_id", "image_ids", GRAPH, least)
    return pairs.withColumnsRenamed({"item_a": "image_id_a", "item_b": "image_id_b"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images with 12 or more common points, at least twice as many as by chance."""
    pairs = _images(spark, sf_dir, 12)
    return pairs.where(at_least_times_chance(2)).select(*GRAPH, "image_id_a", "image_id_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of images with a common point: n_ab, and its ratio to the number expected by chance."""
    return _images(spark, sf_dir, 1).select(*GRAPH, "image_id_a", "image_id_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


# 4: splits that keep related entries together


def _place(c: str) -> Column:
    return F.upper(F.replace(F.replace(F.col(c), F.lit(" ")), F.lit("-")))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = table(spark, sf_dir, "recon_split").where(F.col("scene_recon_name").isNotNull())
    scene = F.replace(F.lower(F.substring_index("scene_recon_name", ">", 1)), F.lit(" "), F.lit("_"))
    contributor = F.lower(F.trim("contributor"))
    some = lambda c: F.when(c != "", c)
    keys = {"scene": some(scene), "place": some(_place("place_id")), "contributor": F.when(~contributor.isin("unknown", "n/a"), some(contributor))}
    return entries, related_groups(entries, "scene_recon_name", keys)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_recon_name, group_name of groups that the present lists put into several splits."""
    entries, groups = _entries(spark, sf_dir)
    listed = entries.where(F.col("split").isNotNull()).select(F.col("scene_recon_name").alias("name"), "split").distinct()
    space = Workspace(spark, "torn")
    named = space.write(groups)
    torn = space.write(named.df.join(listed, "name").groupBy("group_name").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low < high").select("group_name"))
    # One group may hold most names; groups are as many as there are torn ones.
    return attach(named.df, torn.df, "group_name", named.rows).select(F.col("name").alias("scene_recon_name"), "group_name")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_recon_name, group_name, split: one split for every name, in the proportions of split_target."""
    _, groups = _entries(spark, sf_dir)
    rows = table(spark, sf_dir, "split_target").where("split is not null and proportion > 0").orderBy("split").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 split targets")
    return assign_splits(groups, {r["split"]: r["proportion"] for r in rows}).withColumnRenamed("name", "scene_recon_name")


def p4_splits_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p4_splits: names, groups, groups in several splits, names without a split, and whether every split is
    off its target by no more than the largest group."""
    rows = Workspace(spark, "hold").write(p4_splits(spark, sf_dir)).df
    groups = rows.groupBy("group_name").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("split").alias("splits"))
    per = groups.agg(F.sum("k").alias("names"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col("splits") > 1).alias("torn"), F.max("k").alias("largest"))
    without = rows.agg(F.count_if(F.col("split").isNull()).alias("unassigned"))
    targets = table(spark, sf_dir, "split_target").where("split is not null and proportion > 0").distinct()
    shares = targets.join(targets.agg(F.sum("proportion").alias("whole"))).select("split", (F.col("proportion") / F.col("whole")).alias("share"))
    given = shares.join(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").join(per)
    near = given.agg(F.bool_and(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("names")) <= F.col("largest")).alias("near"))
    return per.join(without).join(near).select("names", "groups", "torn", "unassigned", "near")  # one row each


# 6: documents in containers


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "container_size")
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", kinds, "container_kind", "capacity_tokens")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than the capacity: those whose placement has several pieces."""
    cut = _packed(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece") == 0))
    return cut.select(F.col("kind").alias("container_kind"), F.col("item").alias("doc_id"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each kind."""
    return _packed(spark, sf_dir).withColumnsRenamed({"kind": "container_kind", "item": "doc_id"})


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused room of each kind."""
    return unused(_packed(spark, sf_dir), table(spark, sf_dir, "container_size"), "container_kind", "capacity_tokens").withColumnRenamed("kind", "container_kind")


def p6_containers_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p6_containers, for each kind: documents, their tokens, all placed once and in order; containers over
    their capacity, documents cut without need, and whether under 1 % of the room is unused."""
    kinds = table(spark, sf_dir, "container_size").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    rows = Workspace(spark, "hold").write(p6_containers(spark, sf_dir)).df.join(F.broadcast(kinds.limit(1000)), "container_kind")
    docs = rows.groupBy("container_kind", "doc_id", "capacity").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("k"), F.max("n_pieces").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"))
    whole = (F.col("k") == F.col("n")) & (F.col("last") == F.col("tokens"))
    per = docs.groupBy("container_kind").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.count_if(~whole).alias("broken"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_without_need"))
    boxes = rows.groupBy("container_kind", "container", "capacity").agg(F.sum("n_tokens").alias("t")).groupBy("container_kind").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.sum("t") >= 0.99 * F.sum(F.col("capacity") - F.lit(0)) - F.max("capacity")).alias("full"))
    return per.join(boxes, "container_kind")


# 7: evaluation items in documents


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 13 consecutive words of an item: the hits at which Myers' distance is 0."""
    return _leaks(spark, sf_dir).where("errors = 0").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 13 words of an item that differ by one word edit at most."""
    return _leaks(spark, sf_dir).withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


# 8: sentences of commit messages


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent_start, sent_end for every sentence of every message."""
    return sentence_spans(table(spark, sf_dir, "documents"), "doc_id", "text", "msg_start", "msg_end").withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p3_found, p3_pairs, p4_found, p4_splits, p4_splits_hold, p6_found, p6_containers, p6_containers_hold, p6_unused, p7_found, p7_near, p8_found)}

_PHOTOS = """
    SELECT DISTINCT sample_uid, split, list_sort(list_distinct(list_transform(map_keys(imgs),
        lambda k: replace(lower(regexp_extract(k, '[^/]*$')), ' ', '_')))) AS photos
    FROM sampled_case WHERE imgs IS NOT NULL AND split IN ('train', 'val', 'test')"""
_SIMILAR = f"""
    WITH s AS ({_PHOTOS}), w AS (SELECT DISTINCT sample_uid, split, unnest(photos) AS photo, len(photos) AS n FROM s),
    c AS (SELECT e.sample_uid AS ue, e.split, t.sample_uid AS ut, any_value(e.n) AS ne, any_value(t.n) AS nt, count(*) AS common
          FROM w e JOIN w t ON e.photo = t.photo AND t.split = 'train' AND e.split <> 'train' GROUP BY ALL),
    found AS (SELECT * FROM c WHERE common * 10 >= 8 * (ne + nt - common))"""
_TRACKS = """
    WITH t AS (SELECT DISTINCT scene, recon, point3d_id, unnest(image_ids) AS image FROM point3d),
    n AS (SELECT scene, recon, count(DISTINCT point3d_id) AS n FROM t GROUP BY ALL),
    i AS (SELECT scene, recon, image, count(*) AS k FROM t GROUP BY ALL),
    p AS (SELECT a.scene, a.recon, a.image AS image_id_a, b.image AS image_id_b, count(*) AS n_ab
          FROM t a JOIN t b USING (scene, recon, point3d_id) WHERE a.image < b.image GROUP BY ALL),
    r AS (SELECT p.*, n.n, x.k AS n_a, y.k AS n_b FROM p JOIN n USING (scene, recon)
          JOIN i x ON (x.scene, x.recon, x.image) = (p.scene, p.recon, p.image_id_a)
          JOIN i y ON (y.scene, y.recon, y.image) = (p.scene, p.recon, p.image_id_b))"""
_CHARACTER = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"


def _runs_sql(name: str, table: str, key: str, n: int = 13) -> str:
    """All runs of n words: characters of the ranges get blanks around them and are words of their own."""
    apart = f"regexp_replace(lower(text), '([{_CHARACTER}])', ' \\1 ', 'g')"
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all({apart}, '[\\p{{L}}\\p{{N}}{_CHARACTER}]+') AS w FROM {table} WHERE {key} IS NOT NULL),
        {name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM {name}_w, unnest(range(1, len(w) - {n - 2})) AS t(i))"""


def _near_sql() -> str:
    """Passages within one word edit: the same run, or runs that are equal once a word is taken out of either or of both at one place."""
    words = lambda table, key: f"SELECT DISTINCT {key}, regexp_extract_all(regexp_replace(lower(text), '([{_CHARACTER}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}{_CHARACTER}]+') AS w FROM {table} WHERE {key} IS NOT NULL"
    run = lambda n: f"array_to_string(w[s:s + {n - 1}], ' ')"
    less = lambda n: f"array_to_string(list_concat(w[s:s + k - 2], w[s + k:s + {n - 1}]), ' ')"  # noqa: E731  # without the k-th word
    return f"""
        WITH iw AS ({words('eval_items', 'item_id')}), dw AS ({words('documents', 'doc_id')}),
        i AS (SELECT item_id, w, s FROM iw, unnest(range(1, len(w) - 11)) AS t(s)),
        pieces AS (SELECT DISTINCT {run(6)} AS piece FROM iw, unnest(range(1, len(w) - 4)) AS t(s) WHERE len(w) >= 13),
        hits AS (SELECT doc_id, s AS p FROM (SELECT doc_id, s, {run(6)} AS piece FROM dw, unnest(range(1, len(w) - 4)) AS t(s)) JOIN pieces USING (piece)),
        starts AS (SELECT DISTINCT doc_id, p - o AS s FROM hits, range(9) AS t(o) WHERE p > o),
        d AS (SELECT doc_id, w, s FROM starts JOIN dw USING (doc_id)),
        whole AS (SELECT DISTINCT item_id, {run(13)} AS run FROM i),
        gone AS (SELECT DISTINCT item_id, k, {less(13)} AS run FROM i, range(1, 14) AS t(k)),
        found AS (
            SELECT item_id, doc_id, 0 AS errors FROM whole JOIN (SELECT doc_id, {run(13)} AS run FROM d WHERE s + 12 <= len(w)) USING (run)
            UNION ALL SELECT item_id, doc_id, 1 FROM gone JOIN (SELECT doc_id, {run(12)} AS run FROM d WHERE s + 11 <= len(w)) USING (run)
            UNION ALL SELECT item_id, doc_id, 1 FROM gone JOIN (SELECT doc_id, k, {less(13)} AS run FROM d, range(1, 14) AS t(k) WHERE s + 12 <= len(w)) USING (k, run)
            UNION ALL SELECT item_id, doc_id, 1 FROM whole JOIN (SELECT doc_id, {less(14)} AS run FROM d, range(1, 15) AS t(k) WHERE s + 13 <= len(w)) USING (run))
        SELECT item_id, doc_id, min(errors)::INT AS errors FROM found GROUP BY ALL"""


_BYTES = "SELECT DISTINCT container_kind, doc_id FROM documents, container_size WHERE strlen(text) > capacity_tokens"
_GROUPS = """
        WITH RECURSIVE k AS (
            SELECT DISTINCT scene_recon_name AS name, unnest([
                'scene:' || nullif(replace(lower(split_part(scene_recon_name, '>', 1)), ' ', '_'), ''),
                'place:' || nullif(upper(replace(replace(place_id, ' ', ''), '-', '')), ''),
                'contributor:' || CASE WHEN lower(trim(contributor)) NOT IN ('', 'unknown', 'n/a') THEN lower(trim(contributor)) END]) AS key
            FROM recon_split WHERE scene_recon_name IS NOT NULL),
        e AS (SELECT DISTINCT x.name AS a, y.name AS b FROM k x JOIN k y USING (key)),
        r AS (SELECT DISTINCT scene_recon_name AS name, scene_recon_name AS seen FROM recon_split WHERE scene_recon_name IS NOT NULL
              UNION SELECT r.name, e.b FROM r JOIN e ON e.a = r.seen),
        g AS (SELECT name, min(seen) AS group_name FROM r GROUP BY name)"""

SQL = {
    "p1_found": """
        WITH RECURSIVE l AS (
            SELECT DISTINCT scene, recon, replace(src, ' ', '_') AS a, replace(dst, ' ', '_') AS b FROM presampling_pairs
            WHERE matches_num > 16 AND replace(src, ' ', '_') <> replace(dst, ' ', '_')),
        e AS (SELECT * FROM l UNION SELECT scene, recon, b, a FROM l),
        r AS (SELECT scene, recon, a AS name, a AS seen FROM e UNION
              SELECT r.scene, r.recon, r.name, e.b FROM r JOIN e ON (e.scene, e.recon, e.a) = (r.scene, r.recon, r.seen))
        SELECT scene, recon, name, min(seen) AS group_name FROM r GROUP BY ALL""",
    "p2_found": _SIMILAR + " SELECT DISTINCT least(ue, ut) AS sample_uid_a, greatest(ue, ut) AS sample_uid_b FROM found WHERE ue <> ut",
    "p2_report": _SIMILAR + """
        , per AS (SELECT ue, split, count(*) AS n FROM found GROUP BY ALL),
        src AS (SELECT DISTINCT sample_uid AS ue, split, scene_recon_name FROM sampled_case)
        SELECT split, scene_recon_name, sum(n)::BIGINT AS n_pairs, count(*) AS n_samples FROM per JOIN src USING (ue, split) GROUP BY ALL""",
    "p3_found": _TRACKS + " SELECT scene, recon, image_id_a, image_id_b FROM r WHERE n_ab >= 12 AND n_ab * n >= 2 * n_a * n_b",
    "p3_pairs": _TRACKS + """
        SELECT scene, recon, image_id_a, image_id_b, n_ab, round(n_ab * n / (n_a * n_b), 6) AS lift,
               CASE WHEN n_ab < n_a THEN round((1 - n_b / n) / (1 - n_ab / n_a), 6) END AS conviction FROM r""",
    "p4_found": _GROUPS + """,
        torn AS (SELECT group_name FROM g JOIN recon_split s ON s.scene_recon_name = g.name GROUP BY group_name HAVING count(DISTINCT split) > 1)
        SELECT name AS scene_recon_name, group_name FROM g WHERE group_name IN (SELECT group_name FROM torn)""",
    "p4_splits_hold": _GROUPS + " SELECT count(*) AS names, count(DISTINCT group_name) AS groups, 0::BIGINT AS torn, 0::BIGINT AS unassigned, true AS near FROM g",
    "p6_found": _BYTES,
    "p6_containers_hold": """
        SELECT container_kind, count(*) AS docs, sum(coalesce(strlen(text), 0))::BIGINT AS tokens, 0::BIGINT AS broken, 0::BIGINT AS cut_without_need, 0::BIGINT AS overfull, true AS "full"
        FROM documents, (SELECT DISTINCT container_kind FROM container_size) GROUP BY container_kind""",
    "p7_found": f"WITH {_runs_sql('a', 'eval_items', 'item_id')}, {_runs_sql('b', 'documents', 'doc_id')} SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (run)",
    "p7_near": _near_sql(),
}
