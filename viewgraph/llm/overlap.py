"""Same or nearly the same records in evaluation and training splits.

The method: hash the word n-grams of evaluation records, scan training records for hits and
compute containment. A record here is a set of words (the photos of a sample), so its words
are first put in one order that holds for all records (rare in evaluation first), and its n-grams are the runs of
n = 2 neighbours in that order; a set of one word has that word as its only gram.

Training is pruned by evaluation before it is first shuffled: each task of the scan keeps only words that occur in
evaluation, and only a training record with enough of them goes on, then only its grams that occur in evaluation.

Nothing is lost. If c of a and b words are common and c / (a + b - c) >= t, then c >= t a and c >= t b, so a training
record of b words goes on if ceil(t b) of them are evaluation words. Taking its other words away leaves c as it is and
makes a + b smaller. Of what is left, each of the a + b - 2c words that aren't common parts at most one pair of neighbouring
common words, so at least c - 1 - (a + b - 2c) >= (2 - 1/t) c - 1 grams are common (with t = 0.8: 0.75 c - 1). A record
therefore needs to offer only its (grams - needed + 1) rarest grams, where grams are those that evaluation has, which keeps
popular words from meeting each other. Where the bound does not reach 1 (tiny sets), single words are
offered too. Sets equal in all words form one class and are compared once.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import BROADCAST_NAMES, BROADCAST_ROWS, Workspace, Written, attach, small


def photo_of(key: Column) -> Column:
    """The photo a key stands for: no folders, lower case, blanks as underscores."""
    return F.replace(F.lower(F.substring_index(key, "/", -1)), F.lit(" "), F.lit("_"))


def needed_grams(words: int, threshold: float) -> int:
    """Two-word grams that a set of so many words shares with any set similar to it, at least."""
    t = Fraction(threshold).limit_denominator(10_000)
    least = ceil(t * words)
    return ceil((2 - 1 / t) * least) - 1


def overlaps(records: DataFrame, record: str, split: str, words: Column, train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members of classes).

    pairs: class_eval, class_train, n_common, containment (share of the evaluation words found
    in the training record), similarity (intersection / union), one row per pair of classes with
    similarity >= threshold. A class is the set of words itself, by its id; it meets itself if
    both sides have it.
    members: class_id, record, split, side, once for every row. Records with null or empty sets, a null id or a
    split outside both sides belong to no class. threshold must be over 0.5, below which neighbouring grams prove nothing.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be over 0.5 and at most 1")
    t = Fraction(threshold).limit_denominator(10_000)
    space = Workspace(records.sparkSession, "overlaps")
    side = F.when(F.col(split) == train, F.lit("t")).when(F.col(split).isin(*evaluation), F.lit("e"))
    rows = records.select(F.col(record).alias("record"), F.col(split).alias("split"), side.alias("side"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("words"))
    rows = rows.where(F.col("record").isNotNull() & F.col("side").isNotNull() & (F.size("words") > 0))
    rows = rows.withColumn("class_id", F.unhex(F.md5(F.to_json(F.struct("words")))))
    members = rows.select("class_id", "record", "split", "side")

    # Evaluation: its classes, its words with the number of classes that have them, its grams.
    evals = rows.where("side = 'e'").groupBy("class_id").agg(F.any_value("words").alias("words"))
    evals = space.write(evals.select("class_id", F.size("words").alias("n"), F.explode("words").alias("word")))
    vocabulary = space.write(evals.df.groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    known = vocabulary.df
    in_order = F.array_sort(F.collect_set(F.struct("count", "word"))).alias("w")
    sets_e = space.write(_with_counts(evals.df, vocabulary, evals.rows).groupBy("class_id", "n").agg(in_order), F.sum("n"))

    # Training: one scan that keeps evaluation words. Copies fold into one set before the shuffle.
    trains = rows.where("side = 't'").select("class_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    if vocabulary.rows <= BROADCAST_NAMES:
        hits = trains.join(F.broadcast(known), "word")
    else:
        kept = space.write(trains.join(known.select("word"), "word", "left_semi").distinct())
        hits = _with_counts(kept.df, vocabulary, kept.rows)
    least = F.floor((F.col("n") * t.numerator + (t.denominator - 1)) / t.denominator)
    sets_t = hits.groupBy("class_id", "n").agg(in_order).where(F.size("w") >= least)
    sets_t = space.write(sets_t, F.sum("n"))

    grams_of = _grams(t, threshold)
    every = space.write(sets_e.df.select("class_id", F.explode(grams_of["all"]).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("count")))
    offers_e = _offered(space, sets_e, grams_of, every)
    offers_t = _offered(space, sets_t, grams_of, every)
    of_e = offers_e.df.select("gram", F.col("class_id").alias("class_eval"), F.col("n").alias("n_eval"))
    of_t = offers_t.df.select("gram", F.col("class_id").alias("class_train"), F.col("n").alias("n_train"))
    low, high = F.least("n_eval", "n_train"), F.greatest("n_eval", "n_train")
    # Evaluation grams are broadcast, and training is scanned; if they are too many, both sides are tables, and hot grams are split.
    near = of_t.join(small(of_e, offers_e.rows), "gram").where(low * t.denominator >= high * t.numerator).select("class_eval", "class_train").distinct()
    near = space.write(near)

    of_e = sets_e.df.select(F.col("class_id").alias("class_eval"), F.col("n").alias("n_eval"), F.col("w").alias("we"))
    of_t = sets_t.df.select(F.col("class_id").alias("class_train"), F.col("n").alias("n_train"), F.col("w").alias("wt"))
    both = near.df.join(of_e, "class_eval").join(of_t, "class_train")
    common = both.withColumn("n_common", F.size(F.array_intersect("we", "wt")))
    union = F.col("n_eval") + F.col("n_train") - F.col("n_common")
    found = common.where(F.col("n_common") * t.denominator >= union * t.numerator)
    found = found.select("class_eval", "class_train", "n_common", (F.col("n_common") / F.col("n_eval")).alias("containment"), (F.col("n_common") / union).alias("similarity"))
    return found, members


def _with_counts(words: DataFrame, vocabulary: Written, rows: int) -> DataFrame:
    """words with the count of each: a word may be in most sets."""
    if vocabulary.rows <= BROADCAST_NAMES:
        return words.join(F.broadcast(vocabulary.df), "word")
    return attach(words, vocabulary.df, "word", rows)


def _grams(t: Fraction, threshold: float) -> dict[str, Column | int]:
    """Of a set (n words in all, w of them in order): all its grams, and how many any similar set shares at least."""
    word = lambda i: F.element_at("w", i.cast("int"))["word"]
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(word(i), word(i + 1)))).otherwise(F.array().cast("array<long>"))
    rate = 2 - 1 / t
    least = F.floor((F.col("n") * t.numerator + (t.denominator - 1)) / t.denominator)
    needed = F.floor((least * rate.numerator + (rate.denominator - 1)) / rate.denominator) - 1
    # Sets so small that a partner may share no gram offer their words instead; so do the sets a partner may then have.
    tiny = max([n for n in range(1, int(2 / (t * rate)) + 3) if needed_grams(n, threshold) < 1], default=0)
    reach = int(tiny / threshold) + 1
    singles = F.when(F.col("n") <= reach, F.transform("w", lambda x: F.xxhash64(F.lit(0), x["word"]))).otherwise(F.array().cast("array<long>"))
    return {"all": F.when(F.col("n") > tiny, F.array_distinct(pairs)).otherwise(F.array().cast("array<long>")), "singles": singles, "needed": F.greatest(needed, F.lit(1))}


def _offered(space: Workspace, sets: Written, grams: dict[str, Column], every: Written) -> Written:
    """(class_id, n, gram): the rarest grams of each set, of those that evaluation has, any of which a similar set shares."""
    mine = sets.df.select("class_id", "n", grams["needed"].alias("needed"), F.explode(grams["all"]).alias("gram"))
    mine = mine.join(F.broadcast(every.df), "gram") if every.rows <= BROADCAST_ROWS else attach(space.write(mine).df, every.df, "gram", sets.mark)
    ranked = mine.groupBy("class_id", "n", "needed").agg(F.array_sort(F.collect_set(F.struct("count", "gram"))).alias("g"))
    rarest = ranked.select("class_id", "n", F.explode(F.slice("g", F.lit(1), F.greatest(F.size("g") - F.col("needed") + 1, F.lit(0)).cast("int"))).alias("o"))
    tiny = sets.df.select("class_id", "n", F.explode(grams["singles"]).alias("gram"))
    return space.write(rarest.select("class_id", "n", F.col("o.gram").alias("gram")).unionAll(tiny))


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records (record_eval, split_eval, record_train, similarity) from pairs of classes.

    Members of classes without a pair are dropped in the scan, where those with one are few, before anything is made distinct."""
    found = Workspace(pairs.sparkSession, "pairs").write(pairs)

    def of(side: str, name: str) -> DataFrame:
        wanted = found.df.select(F.col(f"class_{name}").alias("class_id")).distinct()
        kept = members.where(F.col("side") == side).join(small(wanted, found.rows), "class_id", "left_semi")
        return kept.select(F.col("class_id").alias(f"class_{name}"), F.col("record").alias(f"record_{name}"), F.col("split").alias(f"split_{name}")).distinct()

    return found.df.join(of("e", "eval"), "class_eval").join(of("t", "train"), "class_train").select("record_eval", "split_eval", "record_train", "containment", "similarity")


#: The type of a class id.
CLASS_ID = T.BinaryType()
