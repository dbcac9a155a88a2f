"""Splits that keep related records together.

Records that share an entity (a document, or a source text in one language), directly or
through other records, are one component. Components get their split by grouped iterative
stratification: the rarest label that is still outstanding goes first, to the split that
needs it most.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.functions.langs import entity_of, with_label_codes
from segloom.util import blank, cut, digest, strip, table

#: Components with at least this share of all rows are placed first, together (at most
#: 1 / HEAVY_SHARE of them); the others are dealt to shards of about SHARD_COMPONENTS.
HEAVY_SHARE = 1 / 200
SHARD_COMPONENTS = 20000
DOMAIN_LABELS = 64


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node in `edges` (u, v).

    Alternates large-star and small-star steps, each of which only takes minima over
    neighbours (combined before the shuffle) and joins them back (hot nodes are split by
    adaptive skew joins), until the edges are stars around the least nodes.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = now.select(mark.alias("m")).first().m
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = now.select(mark.alias("m")).first().m
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _keyed(df: DataFrame, id_col: str, doc_col: str, src_col: str, lang_col: str, names: DataFrame | None) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(src_col).alias("src"), F.col(lang_col).alias("label"))
    rows = with_label_codes(rows, names, code="label").withColumn("lang", entity_of(F.col("code"), "label"))
    named = F.col("lang").isNotNull() & ~blank(F.col("src"))
    return rows.select("id", "doc", F.when(named, digest(F.col("lang"), strip(F.col("src")))).alias("fp"))


def groups(df: DataFrame, id_col: str = "seg_id", doc_col: str = "doc_key", src_col: str = "src", lang_col: str = "src_lang", names: DataFrame | None = None) -> DataFrame:
    """Every row with its group: (id, group_key binary, group_doc, n_rows).

    group_key is the same exactly for the rows of one group, group_doc the least document of
    the group (null if it has none), n_rows the number of its rows. A null document, a null or
    blank source text, and a source text whose label names no language link nothing, so a row
    may be a group of its own. Languages are those of the table `names`; a label that isn't in
    it, but isn't a placeholder like `und` either, equals only itself. Ids should be unique; repeated rows each get their row.
    """
    rows = table(_keyed(df, id_col, doc_col, src_col, lang_col, names), "keyed")
    pairs = table(rows.where("doc is not null or fp is not null").groupBy("doc", "fp").agg(F.count("*").alias("n")), "pairs")
    # a text links its documents to the least of them
    texts = pairs.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    linking = texts.where("d0 != d1").select("fp", "d0")
    edges = pairs.where("doc is not null").join(linking, "fp").select(F.col("doc").alias("u"), F.col("d0").alias("v"))
    roots = connected(edges)
    # rows with a document follow it; rows without follow the least document of their text
    of_doc = pairs.where("doc is not null").groupBy("doc").agg(F.sum("n").alias("n")).join(roots, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("root", "doc").alias("root"), "n")
    of_doc = table(of_doc, "docs")
    lone = pairs.where("doc is null").select("fp", "n").join(texts.select("fp", "d0"), "fp").join(of_doc.select(F.col("doc").alias("d0"), "root"), "d0", "left")
    lone = table(lone.select("fp", "root", "n"), "lone-texts")
    sizes = of_doc.select("root", "n").unionByName(lone.where("root is not null").select("root", "n")).groupBy("root").agg(F.sum("n").alias("n_rows"))
    doc_groups = of_doc.select("doc", "root").join(sizes, "root").select("doc", "root", "n_rows")
    text_groups = lone.join(sizes, "root", "left").select("fp", "root", F.coalesce("n_rows", "n").alias("n_rows"))
    with_doc = rows.where("doc is not null").select("id", "doc").join(doc_groups, "doc").select("id", digest(F.lit("d"), F.col("root")).alias("group_key"), F.col("root").alias("group_doc"), "n_rows")
    key = F.when(F.col("root").isNotNull(), digest(F.lit("d"), F.col("root"))).otherwise(F.col("fp"))
    with_text = rows.where("doc is null and fp is not null").select("id", "fp").join(text_groups, "fp").select("id", key.alias("group_key"), F.col("root").alias("group_doc"), "n_rows")
    single = rows.where("doc is null and fp is null").select("id", digest(F.lit("r"), F.col("id")).alias("group_key"), F.lit(None).cast("string").alias("group_doc"), F.lit(1).cast("bigint").alias("n_rows"))
    return with_doc.unionByName(with_text).unionByName(single).withColumnRenamed("id", id_col)


def related_rows(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(seg_id, group_doc) of each row that has another row in its group."""
    return groups(df, names=names).where("n_rows > 1").select("seg_id", "group_doc")


def stratify(components: list[tuple[dict[int, int], int]], want: dict[int, list[float]], room: list[float]) -> list[int]:
    """Split of each component (label counts, rows) by iterative stratification.

    want: outstanding need of each label in each split; room: outstanding rows of each split.
    Both are changed in place. Ties go to the split with more room, then to the first one;
    components of one label go in falling size.
    """
    left: dict[int, int] = defaultdict(int)
    having: dict[int, list[int]] = defaultdict(list)
    for i, (labels, _) in enumerate(components):
        for label, n in labels.items():
            left[label] += n
            having[label].append(i)
    result = [-1] * len(components)
    heap = [(n, label) for label, n in left.items()]
    heapq.heapify(heap)
    while heap:
        n, label = heapq.heappop(heap)
        if n != left[label]:  # an older entry
            continue
        for i in sorted((i for i in having[label] if result[i] < 0), key=lambda i: (-components[i][0][label], -components[i][1], i)):
            need = want[label]
            best = max(range(len(room)), key=lambda s: (need[s], room[s], -s))
            result[i] = best
            room[best] -= components[i][1]
            for other, k in components[i][0].items():
                want[other][best] -= k
                left[other] -= k
                if other != label and left[other] > 0:
                    heapq.heappush(heap, (left[other], other))
    for i, (_, rows) in enumerate(components):  # components without any label
        if result[i] < 0:
            best = max(range(len(room)), key=lambda s: (room[s], -s))
            result[i] = best
            room[best] -= rows
    return result


def assign_splits(df: DataFrame, shares: list[tuple[str, float]], id_col: str = "seg_id", heavy_share: float = HEAVY_SHARE, shard_components: int = SHARD_COMPONENTS, names: DataFrame | None = None) -> DataFrame:
    """(`id_col`, split_name, group_doc): rows of one group get one split.

    Labels to be balanced are the pair of languages and the domain (hashed to 64 values), so
    their number is bounded. Heavy components are placed on the driver (at most
    1 / heavy_share); the rest is dealt to shards by hash, where each shard aims at its own
    label totals in the proportions that the heavy ones left open. An empty table gives an
    empty result; shares must be positive and are scaled to add up to 1.
    """
    total_share = sum(s for _, s in shares)
    if not shares or any(s is None or s < 0 for _, s in shares) or total_share <= 0:
        raise ValueError("shares must not be negative and must not all be 0")
    splits, parts = [n for n, _ in shares], [s / total_share for _, s in shares]
    member = table(groups(df, id_col, names=names), "members")
    labels = with_label_codes(df.select(F.col(id_col).alias("id"), "src_lang", "tgt_lang", "text_domain"), names, a="src_lang", b="tgt_lang")
    pair = F.abs(F.hash(F.lit("pair"), F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).cast("bigint")) % 4096
    domain = 4096 + F.pmod(F.xxhash64(F.coalesce("text_domain", F.lit(""))), F.lit(DOMAIN_LABELS))
    # one row for each row of the table: ids are unique, so this join has no hot key
    marked = labels.select("id", F.explode(F.array(pair.cast("int"), domain.cast("int"))).alias("label")).join(member.select(F.col(id_col).alias("id"), "group_key", "n_rows"), "id")
    vectors = marked.groupBy("group_key", "label").agg(F.count("*").cast("int").alias("n"), F.first("n_rows").alias("n_rows"))
    vectors = table(vectors.groupBy("group_key").agg(F.first("n_rows").alias("n_rows"), F.collect_list(F.struct("label", "n")).alias("labels")), "vectors")
    count, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    need = {r.label: r.n for r in vectors.select(F.explode("labels").alias("x")).groupBy("x.label").agg(F.sum("x.n").alias("n")).collect()}  # at most 4096 + 64 rows
    edge = max(2, math.ceil(total * heavy_share))
    heavy = vectors.where(F.col("n_rows") >= edge).orderBy(F.desc("n_rows"), "group_key").collect()  # at most 1 / heavy_share rows
    want = {label: [n * p for p in parts] for label, n in need.items()}
    room = [total * p for p in parts]
    placed = stratify([({x.label: x.n for x in r.labels}, r.n_rows) for r in heavy], want, room)
    ratio = {label: _open(w, parts) for label, w in want.items()}
    room_ratio = _open(room, parts)
    shards = max(1, math.ceil(count / shard_components))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group_key", key=lambda s: s.map(bytes)).reset_index(drop=True)
        parts_ = [({x["label"]: x["n"] for x in v}, int(n)) for v, n in zip(rows["labels"], rows["n_rows"])]
        totals: dict[int, int] = defaultdict(int)
        for vector, _ in parts_:
            for label, n in vector.items():
                totals[label] += n
        want_ = {label: [n * q for q in ratio[label]] for label, n in totals.items()}
        all_rows = sum(n for _, n in parts_)
        split = stratify(parts_, want_, [all_rows * q for q in room_ratio])
        return pd.DataFrame({"group_key": rows["group_key"], "split_name": [splits[s] for s in split]})

    light = vectors.where(F.col("n_rows") < edge).withColumn("shard", F.pmod(F.xxhash64("group_key"), F.lit(shards)))
    chosen = light.groupBy("shard").applyInPandas(run, "group_key binary, split_name string")
    fixed = df.sparkSession.createDataFrame([(bytearray(r.group_key), splits[s]) for r, s in zip(heavy, placed)], "group_key binary, split_name string")
    big = member.where(F.col("n_rows") >= edge).join(F.broadcast(fixed), "group_key")
    small = member.where(F.col("n_rows") < edge).join(chosen, "group_key")
    return big.unionByName(small).select(id_col, "split_name", "group_doc")


def _open(left: list[float], parts: list[float]) -> list[float]:
    """Proportions of what is still needed; those asked for if nothing is."""
    rest = [max(0.0, x) for x in left]
    return [x / sum(rest) for x in rest] if sum(rest) > 0 else list(parts)


def split_report(df: DataFrame, shares: list[tuple[str, float]], names: DataFrame | None = None) -> DataFrame:
    """By split: number of rows, share of all rows, and the share asked for."""
    got = assign_splits(df, shares, names=names).groupBy("split_name").agg(F.count("*").alias("n_rows"))
    asked = df.sparkSession.createDataFrame([(n, float(s)) for n, s in shares], "split_name string, split_share double")
    rows = F.broadcast(asked).join(got, "split_name", "left").select("split_name", "split_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # one row for each split
    return rows.withColumn("total", total).select("split_name", "split_share", "n_rows", (F.col("n_rows") / F.greatest("total", F.lit(1))).alias("got_share"))


def split_check(df: DataFrame, shares: list[tuple[str, float]], names: DataFrame | None = None, tolerance: float = 0.02) -> DataFrame:
    """One row of what must hold: rows in a split, groups that are in several splits, and splits
    whose share of the rows is further off than the tolerance, or than the largest group has:
    a group isn't divided."""
    got = table(assign_splits(df, shares, names=names), "assigned")
    own = groups(df, names=names).select("seg_id", "group_key").join(got.select("seg_id", "split_name"), "seg_id")
    each_group = table(own.groupBy("group_key").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"), F.count("*").alias("n")), "groups")
    torn = each_group.where("a != b")
    largest = each_group.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    asked = df.sparkSession.createDataFrame([(n, float(s)) for n, s in shares], "split_name string, split_share double")
    each = F.broadcast(asked).join(got.where("split_name is not null").groupBy("split_name").agg(F.count("*").alias("n")), "split_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row for each split
    far = (F.abs(F.col("n") / total - F.col("split_share")) > F.greatest(F.lit(tolerance), F.lit(largest) / total)).cast("bigint")
    found = each.select("n", F.lit(0).cast("bigint").alias("torn"), far.alias("far"))
    found = found.unionByName(torn.select(F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("torn"), F.lit(0).cast("bigint").alias("far")))
    return found.agg(F.sum("n").alias("n_rows"), F.sum("torn").alias("n_torn_groups"), F.sum("far").alias("n_far_splits"))
