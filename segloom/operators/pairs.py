"""Pairs of candidates for one source: all of them, or k for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from segloom.functions.scalar import hash_60
from segloom.operators.sampling import SEED, order_key
from segloom.schema import GROUP_COLS
from segloom.util import digest, table

#: Primes above 2^59, one of which is the step of a draw. No group has as many
#: candidates, so a step is prime to the number of pairs and visits each pair once.
STEPS = [
    576460752303423619,
    666532744850833541,
    756604737398243501,
    846676729945653427,
    936748722493063351,
    1026820715040473279,
    1116892707587883323,
    1206964700135293249,
]
#: Sources with more candidates are numbered by a range sort, not gathered.
GATHERED = 1000
#: Pairs that the sequential draw may hold on the driver.
MOST_SEQUENTIAL = 5_000_000


def group_sizes(df: DataFrame, ordered: bool = False) -> DataFrame:
    """Candidates of each source: the group columns and n_candidates; in the order of the group
    columns on request."""
    out = df.groupBy(*GROUP_COLS).agg(F.count("*").alias("n_candidates"))
    return out.orderBy(*GROUP_COLS) if ordered else out


def all_pairs(df: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """All unordered pairs of candidates of each source, the one with the smaller id first.

    Duplicates and equal scores are kept; null languages and sources form no pair. The result
    is quadratic in the candidates of a source by its definition; `k_pairs` isn't.
    """
    left = df.select(*GROUP_COLS, F.col(id_col).alias("id1"), F.col("tgt").alias("tgt1"), F.col("score").alias("tgt1_score"))
    right = df.select(*GROUP_COLS, F.col(id_col).alias("id2"), F.col("tgt").alias("tgt2"), F.col("score").alias("tgt2_score"))
    return left.join(right, GROUP_COLS).where("id1 < id2")


def numbered(df: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """Adds `grp` (key of the group), `idx` (0.. in the order of the ids) and `n_candidates`.

    Not by a window over the group, which would bring a hot group to one task: rows are
    range-sorted by group and id, and the place of a row is its place in its partition plus
    the rows of its group in the partitions before.
    """
    keyed = df.withColumn("grp", digest(*GROUP_COLS))
    placed = keyed.repartitionByRange("grp", id_col).sortWithinPartitions("grp", id_col).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    placed = table(placed, "numbered")
    parts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # one row for each group and partition it reaches into
    over = Window.partitionBy("grp")
    before = F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(over).alias("n_candidates"))
    return placed.join(parts, ["grp", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _drawn(groups: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows of `groups` (group columns, n_candidates and more) once for each drawn pair, with i < j."""
    key = [F.col(c) for c in GROUP_COLS]
    count = F.expr("n_candidates * (n_candidates - 1) div 2")
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), (hash_60(F.lit(f"{seed}step"), *key) % len(STEPS) + 1).cast("int"))
    drawn = groups.withColumn("count", count).withColumn("start", hash_60(F.lit(str(seed)), *key) % F.col("count")).withColumn("step", step % F.col("count"))
    drawn = drawn.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("count")) - 1)))
    drawn = drawn.withColumn("number", (F.col("start") + F.col("t") * F.col("step") % F.col("count")) % F.col("count"))
    # pair number -> (i, j), i < j: j(j-1)/2 is the number of pairs below j; floats may be off by one
    drawn = drawn.withColumn("guess", F.floor((F.sqrt(F.col("number").cast("double") * 8 + 1) + 1) / 2).cast("bigint"))
    j = F.when(F.expr("guess * (guess - 1) div 2 > number"), F.col("guess") - 1).when(F.expr("(guess + 1) * guess div 2 <= number"), F.col("guess") + 1).otherwise(F.col("guess"))
    drawn = drawn.withColumn("j", j).withColumn("i", F.expr("number - j * (j - 1) div 2"))
    return drawn.drop("count", "start", "step", "t", "number", "guess")


def k_pairs(df: DataFrame, k: int = 8, seed: int = SEED, id_col: str = "seg_id", gathered: int = GATHERED) -> DataFrame:
    """k different pairs of each source (all of them if there are fewer), drawn by seed.

    The pairs of n candidates, in the order of their ids, are numbered 0..n(n-1)/2-1; a source
    draws the numbers start + t * step for t < k, modulo their count. Start and step come from
    two hashes of seed and group. No pair but the drawn ones is ever made. Sources of at most
    `gathered` candidates are one row with an array of them; larger ones are numbered by their
    ids alone and only drawn candidates are fetched. The result is the same either way.
    """
    if k < 1:
        raise ValueError("k_per_source must be >= 1")
    rows = df.where(" and ".join(f"{c} is not null" for c in GROUP_COLS)).select(*GROUP_COLS, "tgt", "score", F.col(id_col).alias("id"))
    sizes = table(group_sizes(rows).where("n_candidates >= 2"), "sizes")
    # one row for each source of several candidates: most rows have no partner and go no further
    own = rows.join(sizes.where(F.col("n_candidates") <= gathered), GROUP_COLS)
    few = own.groupBy(*GROUP_COLS).agg(F.sort_array(F.collect_list(F.struct("id", "tgt", "score"))).alias("c"))
    few = _drawn(few.withColumn("n_candidates", F.size("c").cast("bigint")), k, seed)
    few = few.select(*GROUP_COLS, F.element_at("c", (F.col("i") + 1).cast("int")).alias("a"), F.element_at("c", (F.col("j") + 1).cast("int")).alias("b"))
    few = few.select(*GROUP_COLS, F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), F.col("a.tgt").alias("tgt1"), F.col("b.tgt").alias("tgt2"), F.col("a.score").alias("tgt1_score"), F.col("b.score").alias("tgt2_score"))
    hot = sizes.where(F.col("n_candidates") > gathered)
    if hot.isEmpty():
        return few
    return few.unionByName(_pairs_of_hot(rows, hot, k, seed))


def _pairs_of_hot(rows: DataFrame, hot: DataFrame, k: int, seed: int) -> DataFrame:
    some = rows.join(hot.select(*GROUP_COLS), GROUP_COLS, "left_semi")
    places = table(numbered(some.select(*GROUP_COLS, "id"), "id").select("grp", "id", "idx"), "places")
    drawn = table(_drawn(hot.withColumn("grp", digest(*GROUP_COLS)), k, seed).drop("n_candidates"), "drawn")
    # a place of a group is one candidate; drawn ones are k for each group at most
    for side in ("i", "j"):
        drawn = drawn.join(places.select("grp", F.col("idx").alias(side), F.col("id").alias(f"id{side}")), ["grp", side])
    text = some.select(F.col("id").alias("idi"), F.col("tgt").alias("tgt1"), F.col("score").alias("tgt1_score"))
    other = some.select(F.col("id").alias("idj"), F.col("tgt").alias("tgt2"), F.col("score").alias("tgt2_score"))
    out = drawn.join(text, "idi").join(other, "idj")
    return out.select(*GROUP_COLS, F.col("idi").alias("id1"), F.col("idj").alias("id2"), "tgt1", "tgt2", "tgt1_score", "tgt2_score")


def limit_pairs(pairs: DataFrame, limit: int | None, seed: int = SEED) -> DataFrame:
    """Pairs in seeded order, the first `limit` of them."""
    if limit is not None and limit < 0:
        raise ValueError("max_examples must not be negative")
    out = pairs.orderBy(order_key(seed, "id1", "id2"), "id1", "id2")
    return out if limit is None else out.limit(limit)


def sequential_pairs(df: DataFrame, k: int = 8, seed: int = SEED, limit: int | None = None, id_col: str = "seg_id") -> DataFrame:
    """The draw of a sequential generator that goes through the sorted groups one by one.

    For comparisons with single-process runs: the driver draws index pairs from the group
    sizes alone and joins them to the rows. It holds one number for each pair, so inputs of more
    than MOST_SEQUENTIAL pairs are refused; `k_pairs` has no such limit.
    """
    import itertools
    import random

    if k < 1:
        raise ValueError("k_per_source must be >= 1")
    rows = table(numbered(df.where(" and ".join(f"{c} is not null" for c in GROUP_COLS)).select(*GROUP_COLS, "tgt", "score", F.col(id_col).alias("id")), "id"), "candidates")
    many = group_sizes(rows).agg(F.coalesce(F.sum(F.expr("n_candidates * (n_candidates - 1) div 2")), F.lit(0))).first()[0]
    if many > MOST_SEQUENTIAL:
        raise ValueError(f"{many} pairs are too many for a sequential draw (at most {MOST_SEQUENTIAL})")
    rng, drawn = random.Random(seed), []
    groups = rows.where("idx = 0 and n_candidates >= 2").select(*GROUP_COLS, "grp", "n_candidates").collect()
    for r in sorted(groups, key=lambda r: (r.src_lang, r.tgt_lang, r.src)):
        pairs = list(itertools.combinations(range(r.n_candidates), 2))
        rng.shuffle(pairs)
        drawn += [(r.grp, i, j) for i, j in pairs[:k]]
    rng.shuffle(drawn)
    picked = df.sparkSession.createDataFrame([(*x, n) for n, x in enumerate(drawn[:limit])], "grp binary, i bigint, j bigint, place bigint")
    one = rows.select("grp", F.col("idx").alias("i"), *GROUP_COLS, F.col("id").alias("id1"), F.col("tgt").alias("tgt1"), F.col("score").alias("tgt1_score"))
    two = rows.select("grp", F.col("idx").alias("j"), F.col("id").alias("id2"), F.col("tgt").alias("tgt2"), F.col("score").alias("tgt2_score"))
    out = picked.join(one, ["grp", "i"]).join(two, ["grp", "j"]).orderBy("place")
    return out.select(*GROUP_COLS, "id1", "id2", "tgt1", "tgt2", "tgt1_score", "tgt2_score")
