"""Texts that lost their end, found by a classifier trained on texts cut for the purpose.

Intact texts of the table are cut at random places and at the length limits of its sources;
hashed logistic regression learns to tell them from uncut ones by closing characters and
words, punctuation, open quotes and brackets, and the distance of the length to a limit. Then
every text is scored.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.util import blank, table

#: Weights of the model.
WIDTH = 1 << 18
#: Texts that the model is trained on at most (those with a hash of id and field below a bound
#: that about as many have); each gives one uncut and up to CUTS cut examples.
TRAIN_TEXTS = 30000
CUTS = 2
EPOCHS = 4
#: Share of uncut examples repeated as if their length were a limit.
AT_LIMIT = 0.05
#: Probability from which a text counts as cut.
THRESHOLD = 0.9
#: A length is a limit of a source if it is SPIKE times as frequent as the lengths around it,
#: and at least SPIKE_LEAST texts and SPIKE_SHARE of the source's texts have it. Lengths
#: under SHORTEST_LIMIT aren't limits: headings and names cluster there (with 16 instead of 64,
#: 12 of 13 more texts found on sf0.1 were whole headings).
SPIKE, SPIKE_LEAST, SPIKE_SHARE, SPIKE_WINDOW = 6, 5, 1 / 200, 12
SHORTEST_LIMIT = 64
#: Limits at which training texts are cut at most, the most frequent ones; every limit counts
#: where texts are scored.
MOST_LIMITS = 1000
#: A text may fall short of its limit by this much (white space taken off, a character of
#: several bytes that didn't fit).
SHORT_BY = 3

#: Signs added where a text was cut.
MARKS = ("…", "...", " …", " ...", " [...]", "[…]", " (...)")
MARK = re.compile(r"\s*(?:\[(?:…|\.{3})\]|\((?:…|\.{3})\)|…|\.{3})\s*$")
FINAL = ".!?。！？؟۔।॥።։។"
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "(": ")", "（": "）", "[": "]", "‹": "›", "『": "』", "《": "》", "【": "】"}
#: Signs that may close a sentence after its end.
CLOSING = "”»“」\"')）›』》】"
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\S")


def _kind(ch: str) -> str:
    if ch.isdigit():
        return "d"
    if ch.isalpha():
        return "j" if ch >= "　" else "u" if ch.isupper() else "l"
    if ch.isspace():
        return "s"
    return ch if ch.isascii() or ch in "”“»«…。！？」）؟۔।॥።։។›』》】" else unicodedata.category(ch)


def _open(text: str) -> str:
    """Which quotes and brackets are left open."""
    out = []
    for left, right in PAIRS.items():
        if left == "“" and "„" in text:  # here it closes
            continue
        if text.count(left) > sum(text.count(r) for r in right):
            out.append(left)
    return "".join(out)


def features(text: str, limits: list[tuple[str, int]] | None) -> list[int]:
    """Hashed features of a text and of the limits ((`c` or `b`, length)) of its source."""
    body = text.rstrip()
    mark = MARK.search(body)
    core = body[: mark.start()] if mark and mark.start() > 0 else body
    short = SHORT_BY + 1
    for unit, limit in limits or ():
        size = len(text) if unit == "c" else len(text.encode("utf-8", "replace"))
        if 0 <= limit - size <= SHORT_BY:
            short = min(short, limit - size)
    tail = core[-60:]
    found = TOKEN.findall(tail.lower())[-4:]
    found = ["0" if t.isdigit() else t for t in found]
    kinds = "".join(_kind(c) for c in core[-4:])
    last = _kind(core[-1]) if core else ""
    left_open = _open(core)
    n_words = core.count(" ") + 1
    size = min(n_words, 12) if " " in core else 12 + min(len(core) // 12, 8)
    inner = any(c in FINAL for c in core[:-2])
    colon = ":" in core or "：" in core
    final = last in FINAL or (last in CLOSING and len(core) > 1 and core.rstrip(CLOSING)[-1:] in FINAL)
    head = colon and n_words < 14
    ended = max(tail.rfind(c) for c in FINAL)
    after = tail[ended + 1 :] if ended >= 0 else " "  # closing signs that were garbled
    after = "no" if " " in after or len(after) > 8 else len(after)
    marked = "m" if mark else "-"
    gone = text[len(body) :][:2]
    names = [
        f"k1{last}",
        f"k4{kinds}",
        f"t1{found[-1:]}",
        f"t2{found[-2:]}",
        f"t3{found[-3:]}",
        f"c3{core[-3:].lower()}",
        f"m{marked}{final}",
        f"mk{marked}{last}",
        f"o{left_open}{final}{last}",
        f"h{head}{inner}{last}",
        f"s{size}{head}{last}",
        f"i{inner}{colon}{last}{size}",
        f"f{final}{bool(left_open)}{inner}",
        f"w{gone}{final}",
        f"a{after}{last.isdigit() or last == 'd'}",
        f"l{short}",
        f"lf{short}{final}{marked}",
        f"lo{min(short, SHORT_BY)}{bool(left_open)}",
        f"u{core[:20].isupper()}{last}{head}",
        f"n{re.sub(chr(92) + 'd+', '0', core[-12:].lower())}" if last == "d" else f"e{last}{found[-2:-1]}",
    ]
    return [zlib.crc32(n.encode("utf-8", "replace")) % WIDTH for n in names]


def boundary(text: str, at: int) -> bool:
    """Whether a cut at this place can't be seen: what is left ends with a whole sentence."""
    head, rest = text[:at].rstrip(), text[at:].lstrip()
    if not head or not rest:
        return True
    core = head.rstrip(CLOSING)
    starts = rest.lstrip("“«„「¡¿\"'(")[:1]
    return core[-1:] in FINAL and rest[:1] not in CLOSING and (not starts or not starts.islower()) and not starts.isdigit()


def cut_text(text: str, at: int, unit: str, how: random.Random) -> str:
    """The text cut to a length, with a mark now and then; white space may be taken off."""
    mark = how.choice(MARKS) if how.random() < 0.2 else ""
    keep = max(1, at - len(mark if unit == "c" else mark.encode()))
    out = text[:keep] if unit == "c" else text.encode("utf-8")[:keep].decode("utf-8", "ignore")
    if how.random() < 0.5:
        out = out.rstrip() or out
    return out + mark


def examples(texts: list[tuple[str, list[tuple[str, int]] | None]], all_limits: list[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of uncut and cut texts. Texts at a limit of their source are left out."""
    how = random.Random(seed)
    rows, labels = [], []
    for text, limits in texts:
        sizes = {"c": len(text), "b": len(text.encode("utf-8"))}
        if any(0 <= limit - sizes[unit] <= SHORT_BY for unit, limit in limits or ()) or MARK.search(text.rstrip()):
            continue
        rows.append(features(text, limits))
        labels.append(0)
        if how.random() < AT_LIMIT:  # whole texts that happen to have the length
            unit = how.choice("cb")
            rows.append(features(text, [(unit, sizes[unit] + how.randint(0, SHORT_BY))]))
            labels.append(0)
        fit = [x for x in all_limits if x[1] < sizes[x[0]] - 1]
        for _ in range(CUTS):
            if fit and how.random() < 0.5:
                unit, at = how.choice(fit)
                made = cut_text(text, at, unit, how)
                own = [(unit, at)]
            else:
                if len(text) < 12:
                    continue
                unit, at = "c", how.randint(max(6, len(text) // 8), len(text) - 2)
                made = cut_text(text, at, unit, how)
                own = None
                if not MARK.search(made) and boundary(text, at):
                    continue
            rows.append(features(made, own))
            labels.append(1)
    return np.array(rows, np.int64), np.array(labels, np.float32)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of logistic regression by adaptive gradient steps; both
    classes weigh the same."""
    weights, squares = np.zeros(WIDTH + 1, np.float32), np.full(WIDTH + 1, 1e-3, np.float32)
    if not len(y) or not 0 < y.sum() < len(y):
        return weights
    x = np.hstack([x, np.full((len(x), 1), WIDTH, np.int64)])
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        index = order.permutation(len(y))
        for b in range(0, len(y), 256):
            at = index[b : b + 256]
            p = 1 / (1 + np.exp(-weights[x[at]].sum(axis=1)))
            grad = np.zeros(WIDTH + 1, np.float32)
            np.add.at(grad, x[at], (((p - y[at]) * share[at]) / len(at))[:, None])
            used = np.unique(x[at])
            g = grad[used] + decay * weights[used]
            squares[used] += g * g
            weights[used] -= rate * g / np.sqrt(squares[used])
    return weights


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    return 1 / (1 + np.exp(-(weights[x].sum(axis=1) + weights[WIDTH]).astype(np.float64)))


def length_counts(texts: DataFrame) -> DataFrame:
    """Texts of each length in characters and bytes, by source and field, over all texts."""
    sizes = texts.select("origin", "field", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("b").alias("unit"), F.octet_length("text").alias("size")))).alias("x")).select("origin", "field", "x.unit", "x.size")
    counts = sizes.groupBy("origin", "field", "unit", "size").agg(F.count("*").alias("n"))
    return table(counts, "lengths")


def length_limits(counts: DataFrame) -> DataFrame:
    """Limits of each source and field: (origin, field, limits array<struct<unit, size>>).

    A limit is a length, in characters or bytes, that stands out of the lengths around it.
    """
    total = counts.where("unit = 'c'").groupBy(F.col("origin").alias("o"), F.col("field").alias("f")).agg(F.sum("n").alias("total"))
    # each length counts for itself and for the surroundings of its neighbours
    reach = F.explode(F.sequence(F.lit(-SPIKE_WINDOW), F.lit(SPIKE_WINDOW))).alias("by")
    near = counts.select("origin", "field", "unit", "size", "n", reach).where((F.col("by") == 0) | (F.abs("by") > SHORT_BY))
    near = near.groupBy("origin", "field", "unit", (F.col("size") + F.col("by")).alias("size")).agg(F.sum(F.when(F.col("by") == 0, F.col("n"))).alias("n"), (F.coalesce(F.sum(F.when(F.col("by") != 0, F.col("n"))), F.lit(0)) / (2 * (SPIKE_WINDOW - SHORT_BY))).alias("usual"))
    marked = near.where("n is not null").join(total, F.col("origin").eqNullSafe(F.col("o")) & (F.col("field") == F.col("f"))).drop("o", "f")
    spikes = marked.where((F.col("n") >= SPIKE * F.col("usual")) & (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_SHARE * F.col("total")) & (F.col("size") >= SHORTEST_LIMIT))
    return spikes.groupBy("origin", "field").agg(F.sort_array(F.collect_list(F.struct("unit", "size"))).alias("limits"))


def _texts(df: DataFrame, id_col: str) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit("src").alias("field"), F.col("src").alias("text")), F.struct(F.lit("tgt").alias("field"), F.col("tgt").alias("text"))))
    rows = df.select(F.col(id_col).alias("id"), "origin", "src", "tgt").select("id", "origin", pairs.alias("x")).select("id", "origin", "x.field", "x.text")
    return rows.where(~blank(F.col("text")))


def _with_limits(texts: DataFrame, limits: DataFrame) -> DataFrame:
    lim = limits.select(F.col("origin").alias("o"), F.col("field").alias("f"), "limits")
    return texts.join(lim, F.col("origin").eqNullSafe(F.col("o")) & (F.col("field") == F.col("f")), "left").select("id", "origin", "field", "text", "limits")


def scored(df: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """The probability of each text of src and tgt to be cut: id, origin, field, p.

    Null and blank texts have no row. Tables without texts that can be cut give p = 0.5.
    """
    spark = df.sparkSession
    texts = _texts(df, id_col)
    counts = length_counts(texts)
    limits = table(length_limits(counts), "limits")
    n = max(1, counts.where("unit = 'c'").agg(F.sum("n")).first()[0] or 0)
    slot = F.pmod(F.xxhash64("id", "field"), F.lit(1 << 40))
    some = _with_limits(texts.where(slot < int(min(1.0, 0.95 * TRAIN_TEXTS / n) * (1 << 40))), limits)
    some = some.select(slot.alias("h"), "text", "limits").limit(TRAIN_TEXTS).collect()
    sample = [(r.text, [(x.unit, x.size) for x in r.limits] if r.limits else None) for r in sorted(some, key=lambda r: (r.h, r.text))]
    known = limits.select(F.explode("limits").alias("x")).groupBy("x.unit", "x.size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit", "size").limit(MOST_LIMITS)
    known = sorted((r.unit, r.size) for r in known.collect())
    weights = spark.sparkContext.broadcast(fit(*examples(sample, known)))

    def run(batches):
        for batch in batches:
            found = [features(t, [(x["unit"], x["size"]) for x in own] if own else None) for t, own in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            p = probabilities(np.array(found, np.int64), weights.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], ["id", "origin", "field", "p"])

    kind = texts.schema["id"].dataType.simpleString()
    return _with_limits(texts, limits).mapInArrow(run, f"id {kind}, origin string, field string, p double")


def cut_fields(df: DataFrame, id_col: str = "seg_id", threshold: float = THRESHOLD) -> DataFrame:
    """(`id_col`, field_name) of each text of src and tgt that was cut off before its end."""
    return scored(df, id_col).where(F.col("p") >= threshold).select(F.col("id").alias(id_col), F.col("field").alias("field_name"))


def cut_report(df: DataFrame, id_col: str = "seg_id", threshold: float = THRESHOLD) -> DataFrame:
    """By origin and field: texts, cut ones, and their share. A null origin is one of its own."""
    return scored(df, id_col).groupBy("origin", F.col("field").alias("field_name")).agg(F.count("*").alias("n_texts"), F.sum((F.col("p") >= threshold).cast("bigint")).alias("n_cut"), F.avg((F.col("p") >= threshold).cast("double")).alias("cut_share"))
