"""A minimal acyclic transducer from pieces to token ids, memory-mapped by the executors.

Words are compiled in sorted order into an automaton that shares suffixes (equal right
languages are one state). Each arc carries an output; the sum along a word's path is its
number in sorted order, which indexes the array of its ids. The arrays are one `.npy` file
that Spark ships once to each executor and that its Python workers map into memory, so the
workers of a machine share the pages. All words of a batch walk the automaton together, one
byte a step.
"""

from __future__ import annotations

import functools
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles

from segloom.llm import tokenizers as T
from segloom.util import run_dir, table, write_file


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer of `words` (distinct, sorted by bytes) with the ids of each."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)) of each registered state

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path = [[False, []]]  # unfrozen nodes along the last word
    last = b""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
    root = freeze(path[0])
    number = np.zeros(len(states), np.int64)  # words below each state; children come first
    final = np.zeros(len(states) + 1, bool)
    keys, to, out = [], [], []
    for s, (is_final, arcs) in enumerate(states):
        final[s] = is_final
        below = int(is_final)
        for byte, child in arcs:  # in rising order, so the keys rise as well
            keys.append(s << 8 | byte)
            to.append(child)
            out.append(below)
            below += number[child]
        number[s] = below
    key, arc, out = np.array(keys, np.int64), np.array(to, np.int32), np.array(out, np.int32)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=begin[1:])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(begin[-1]))
    slots, slot = _hashed(key)
    return {"slots": slots, "arc": arc[slot], "out": out[slot], "final": final, "begin": begin, "ids": flat, "root": np.array([root])}


def _spread(key: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each slot or -1, number of its arc) of an open hash table with room for twice as
    many arcs: a few bytes for each arc, however many bytes a state could have."""
    bits = max(4, (2 * max(1, len(keys)) - 1).bit_length())
    slots, number = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
    left, at = np.arange(len(keys)), _spread(keys, bits)
    while len(left):
        free = slots[at] < 0
        # of several arcs that want a free slot the last one gets it, the others go on
        slots[at[free]] = keys[left[free]]
        won = slots[at] == keys[left]
        number[at[won]] = left[won]
        left, at = left[~won], (at[~won] + 1) & ((1 << bits) - 1)
    return slots, number if len(keys) else number[:0]


class Lexicon:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.bits = (len(self.slots) - 1).bit_length()
        self.dead = len(self.final) - 1

    def _step(self, key: np.ndarray) -> np.ndarray:
        """Slot of each arc, -1 if there is none."""
        at, out = _spread(key, self.bits), np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            held = self.slots[at]
            hit = held == key[left]
            out[left[hit]] = at[hit]
            on = ~hit & (held >= 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def find(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of each byte slice in the lexicon, -1 if it isn't there."""
        order = np.argsort(-length, kind="stable")
        begin, size = begin[order], length[order]
        state = np.full(len(begin), int(self.root[0]), np.int64)
        total = np.zeros(len(begin), np.int64)
        alive = np.arange(len(begin))
        step = 0
        while len(alive):
            alive = alive[: np.searchsorted(-size[alive], -step, "left")]  # longer than step
            if not len(alive):
                break
            slot = self._step(state[alive] << 8 | data[begin[alive] + step])
            gone = slot < 0
            state[alive[gone]] = self.dead
            alive, slot = alive[~gone], slot[~gone]
            total[alive] += self.out[slot]
            state[alive] = self.arc[slot]
            step += 1
        result = np.where(self.final[state], total, -1)
        back = np.empty(len(order), np.int64)
        back[order] = result
        return back


FIELDS = ("slots", "arc", "out", "final", "begin", "ids", "root")


def ship(spark, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays to a file in the shared folder that every executor gets a copy of, also
    one that starts later; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    buffer = io.BytesIO()
    for field in FIELDS:
        np.save(buffer, arrays[field])
    path = f"{run_dir(spark)}/{name}"
    write_file(spark, path, buffer.getvalue())
    spark.sparkContext.addFile(path)
    return name


@functools.lru_cache(maxsize=2)
def load(name: str) -> Lexicon:
    """The lexicon from the file of this executor, memory-mapped."""
    path, arrays = SparkFiles.get(name), {}
    with open(path, "rb") as f:
        for field in FIELDS:
            np.lib.format.read_magic(f)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(f)
            if int(np.prod(shape)):
                arrays[field] = np.memmap(path, dtype, "r", f.tell(), shape)
            else:
                arrays[field] = np.zeros(shape, dtype)
            f.seek(int(np.prod(shape)) * dtype.itemsize, 1)
    return Lexicon(arrays)


def build(df, columns: list[str], vocab: str = T.DEFAULT, vocab_dir: str = T.VOCAB_DIR, least_share: float = T.FREQUENT_SHARE) -> str:
    """Compiles the frequent pieces of all texts in `columns`; returns the shipped file's name.

    The pieces are counted over the whole table. At most 1 / least_share pieces come to the
    driver.
    """
    spark = df.sparkSession
    counts = table(T.piece_counts(df, columns), "pieces")
    words = sorted(bytes(r[0]) for r in T.frequent(counts, least_share).select("piece").collect())
    return ship(spark, compile_words(words, [T.encode_piece(w, vocab, vocab_dir) for w in words]))


def encode_column(col: pa.Array, lexicon: Lexicon, vocab: str, vocab_dir: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, offsets by text). Frequent pieces by the lexicon, the rest
    by the exact merges, each distinct piece of the column once."""
    data, offsets, counts = T.pieces(col)
    text_end = np.cumsum(counts)
    if len(offsets) <= 1:
        return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64)
    first, inverse = T.unique_pieces(data, offsets)
    begin, length = offsets[:-1][first], np.diff(offsets)[first]
    number = lexicon.find(data, begin, length)
    raw = data.tobytes()
    encode = T.encoder(vocab, vocab_dir)._encode_single_piece
    unseen = np.flatnonzero(number < 0)
    extra = [encode(raw[begin[i] : begin[i] + length[i]]) for i in unseen]
    flat = np.fromiter((t for x in extra for t in x), np.int32)
    sizes = np.array([len(x) for x in extra], np.int64)
    known = number >= 0
    size = np.zeros(len(first), np.int64)
    at = np.zeros(len(first), np.int64)
    size[known] = (lexicon.begin[1:] - lexicon.begin[:-1])[number[known]]
    at[known] = lexicon.begin[:-1][number[known]]
    size[unseen] = sizes
    at[unseen] = len(lexicon.ids) + np.cumsum(sizes) - sizes
    pool = np.concatenate([lexicon.ids, flat])
    each = size[inverse]
    ends = np.cumsum(each)
    index = np.repeat(at[inverse] - (ends - each), each) + np.arange(int(ends[-1]))
    text_offsets = np.concatenate([[0], np.concatenate([[0], ends])[text_end]])
    return pool[index], text_offsets
