"""Filling containers of fixed capacity with items that are split only if they must be.

Items are dealt to shards of bounded size, and each shard is packed on its own: pieces in
falling size go to the open container with the least room that still holds them. Containers
are ordered by their room in a bitmap (one bit for each room, so the successor is the lowest
set bit), and carry bitmaps of the sources and duplicate clusters in them. The search goes on
to the next larger room until a compatible container is found.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokenizers as T
from segloom.llm.corpus_encode import token_counts
from segloom.util import digest, table

#: Items of one shard: the unit one task packs, and the only place where room may be lost.
SHARD_ITEMS = 20000


def pack(sizes, sources, clusters, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers as lists of (item, part, offset, size).

    An item over the capacity is cut into full containers and a rest; other items are never
    split. Two items of one cluster never share a container, unless the cluster is -1 (no
    copies). Items of one source are kept apart where a container with enough room allows it;
    they share one before a new container is opened.
    """
    done: list[list[tuple[int, int, int, int]]] = []
    todo = []
    for item, size in enumerate(sizes):
        whole = size // capacity if size > capacity else 0
        for part in range(whole):
            done.append([(item, part, part * capacity, capacity)])
        if size - whole * capacity > 0:
            todo.append((size - whole * capacity, item, whole))
    todo.sort(key=lambda x: (-x[0], x[1]))
    room_bits = 0
    by_room: dict[int, list[list]] = {}  # open containers: [items, source bitmap, cluster bitmap]
    for size, item, part in todo:
        source = 1 << int(sources[item])
        cluster = 1 << int(clusters[item]) if clusters[item] >= 0 else 0
        found = second = None
        bits = room_bits >> size
        room = size
        while bits and found is None:
            step = (bits & -bits).bit_length() - 1
            room, bits = room + step, bits >> step
            for k, box in enumerate(by_room[room]):
                if not box[2] & cluster:
                    if not box[1] & source:
                        found = (room, k)
                        break
                    second = second or (room, k)
            room, bits = room + 1, bits >> 1
        found = found or second
        if found:
            room, k = found
            held = by_room[room]
            box = held[k]
            held[k] = held[-1]
            held.pop()
            if not held:
                room_bits &= ~(1 << room)
        else:
            room, box = capacity, [[], 0, 0]
            done.append(box[0])
        box[0].append((item, part, part * capacity, size))
        box[1] |= source
        box[2] |= cluster
        if left := room - size:
            by_room.setdefault(left, []).append(box)
            room_bits |= 1 << left
    return done


def fill_containers(df: DataFrame, capacities: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers of each capacity with the parts in them.

    Columns size_name, container_id (unique in a size), doc_id, part, start_token, n_tokens:
    tokens [start_token, start_token + n_tokens) of the document are in the container. Every
    document with tokens is in full once for each size; documents without tokens (null or
    empty text) come once for each size with a null container and 0 tokens. Documents whose
    texts differ in letter case, white space and punctuation only are one duplicate cluster. Ties in size go by place in the shard (by id).
    Capacities must be positive. Rows with one id are separate items.
    """
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    bare = F.lower(F.regexp_replace(F.col(text_col), r"[\s\p{Z}\p{P}\p{Cf}]+", ""))
    base = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), digest(bare).alias("cluster"))
    sized = table(token_counts(base, ["doc_id", "source", "cluster"], "text", vocab, vocab_dir), "sizes")
    items = sized.where("n_tokens > 0")
    shards = max(1, math.ceil(items.count() / shard_items))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "cluster"], kind="stable", na_position="first")
        sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        groups = rows["cluster"].map(bytes)
        copies = groups.duplicated(keep=False)
        clusters = pd.factorize(groups.where(copies))[0]  # -1: no copy in this shard
        sizes = rows["n_tokens"].to_numpy()
        ids = rows["doc_id"].to_numpy()
        out = []
        for name, capacity in capacities:
            for number, box in enumerate(pack(sizes.tolist(), sources, clusters, capacity)):
                for item, part, start, size in box:
                    out.append((name, f"{key[0]}-{number}", ids[item], part, start, size))
        return pd.DataFrame(out, columns=["size_name", "container_id", "doc_id", "part", "start_token", "n_tokens"])

    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"size_name string, container_id string, doc_id {kind}, part int, start_token bigint, n_tokens int"
    # a shard mixes all documents, whatever their source or cluster
    packed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, schema)
    names = F.array(*[F.lit(n) for n, _ in capacities]) if capacities else F.array().cast("array<string>")
    without = sized.where("n_tokens = 0").select(F.explode(names).alias("size_name"), F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).alias("n_tokens"))
    return packed.unionByName(without)


def fill_report(df: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """By size: n_containers, n_tokens in them, and the share of their room that is used."""
    parts = fill_containers(df, capacities).where("container_id is not null")
    asked = df.sparkSession.createDataFrame([(n, int(c)) for n, c in capacities], "size_name string, capacity_tokens int")
    boxes = parts.groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    sums = boxes.groupBy("size_name").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    return sums.join(F.broadcast(asked), "size_name").select("size_name", "capacity_tokens", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill_share"))


def fill_check(df: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """By size, what must hold: n_docs in containers, containers over their capacity, documents
    that are split though they fit, and documents whose parts leave out or repeat a token."""
    parts = table(fill_containers(df, capacities).where("container_id is not null"), "containers")
    asked = df.sparkSession.createDataFrame([(n, int(c)) for n, c in capacities], "size_name string, capacity_tokens int")
    boxes = parts.groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(asked), "size_name")
    boxes = boxes.groupBy("size_name").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("bigint")).alias("n_over"))
    # parts of a document are numbered from 0 and lie one after the other: each but the last is full
    docs = parts.groupBy("size_name", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("part").alias("last"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    docs = docs.join(F.broadcast(asked), "size_name")
    wrong = (F.col("k") != F.col("last") + 1) | (F.col("n") != F.col("end"))
    docs = docs.groupBy("size_name").agg(F.count("*").alias("n_docs"), F.sum(((F.col("k") > 1) & (F.col("n") <= F.col("capacity_tokens"))).cast("bigint")).alias("n_split"), F.sum(wrong.cast("bigint")).alias("n_wrong"))
    return docs.join(boxes, "size_name").select("size_name", "n_docs", "n_over", "n_split", "n_wrong")
