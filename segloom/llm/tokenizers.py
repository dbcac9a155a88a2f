"""Byte-level BPE from a public rank file, and a columnar pre-tokenizer.

Everything works on Arrow string buffers: a batch of texts is one array of code points, so no
Python object is made per piece or per character.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa

#: Folder of the vocabulary files; a parameter of every operator.
VOCAB_DIR = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"

#: The published splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=4)
def ranks(name: str = DEFAULT, vocab_dir: str = VOCAB_DIR) -> dict[bytes, int]:
    """Token bytes -> id (= merge rank)."""
    with open(os.path.join(vocab_dir, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(name: str = DEFAULT, vocab_dir: str = VOCAB_DIR):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, vocab_dir), special_tokens={})


def encode_piece(piece: bytes, name: str = DEFAULT, vocab_dir: str = VOCAB_DIR) -> list[int]:
    """Exact merges of one piece."""
    return encoder(name, vocab_dir)._encode_single_piece(piece)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point under the pattern."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            a, b = m.start(), m.end()
            a, b = (a + 0x800 if a >= 0xD800 else a), (b + 0x800 if b > 0xD800 else b)
            table[a:b] = value
    table[0x1C:0x20] = OTHER  # information separators aren't White_Space
    return table


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    col = col.cast(pa.large_string())
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "")
    n = len(col)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, byte position of each, text offsets counted in code points)."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, at, np.searchsorted(at, offsets)


def piece_starts(points: np.ndarray, text_offsets: np.ndarray) -> np.ndarray:
    """Positions (in code points) at which a piece of PATTERN starts; texts never share one.

    The pattern without a regex engine. Runs of one class are pieces, with these exceptions:
    a single plain space before a run of another class joins that run; the last white-space
    character of a longer run stands alone unless it is a plain space that joins, and white
    space up to the end of the text is one piece; a contraction after an apostrophe that
    starts a run of its class is a piece of its own, and what follows starts anew.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_offsets] = True  # also the end
    last = first[1:]
    first = first[:-1]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first
    space = kind == SPACE
    start = change.copy()
    # the last white space before something else: split off, or joined to what follows
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= before
    joins = before & (points == 32)
    follow = np.zeros(n, bool)
    follow[1:] = joins[:-1]
    start &= ~follow
    # contractions: ' is not joined by a space before it and starts a run of its class
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        start = _contractions(points, kind, start, last, quote)
    return np.flatnonzero(start)


def _contractions(points, kind, start, last, quote):
    n = len(points)

    def at(i, c):
        ok = i < n
        out = np.zeros(len(i), bool)
        out[ok] = points[i[ok]] == ord(c)
        return out

    def inside(i):  # no text ends between the quote and i
        out = np.ones(len(quote), bool)
        for d in range(1, int(i) + 1):
            j = quote + d - 1
            out &= ~last[np.minimum(j, n - 1)]
        return out

    one = inside(1) & (at(quote + 1, "s") | at(quote + 1, "t") | at(quote + 1, "m") | at(quote + 1, "d"))
    two = inside(2) & ((at(quote + 1, "r") & at(quote + 2, "e")) | (at(quote + 1, "v") & at(quote + 2, "e")) | (at(quote + 1, "l") & at(quote + 2, "l")))
    for length, hit in ((1, one), (2, two & ~one)):
        q = quote[hit]
        start[q + 1] = False
        if length == 2:
            start[q + 2] = False
        end = q + length + 1
        end = end[end < n]
        # the letters after the contraction start a new piece; a space joins as before
        start[end] = True
    return start


def pieces(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece offsets in bytes, number of pieces of each text)."""
    data, offsets = text_buffers(col)
    points, at, text_offsets = code_points(data, offsets)
    starts = piece_starts(points, text_offsets)
    counts = np.diff(np.searchsorted(starts, text_offsets))
    return data, np.append(at[starts] if len(starts) else np.zeros(0, np.int64), len(data)).astype(np.int64), counts


def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit key of each piece, from prefix sums of a polynomial (mod 2^64) and the length.

    Only used to find equal pieces within one batch faster; users compare the bytes.
    """
    n = len(data)
    if len(offsets) <= 1:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        x = (data.astype(np.uint64) + np.uint64(0x1F3D5B79)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:n], out=total[1:])
        key = (total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]]
        key ^= np.diff(offsets).astype(np.uint64) * MULT
    return key


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse mod 2^64."""
    size = len(_POWERS[0]) if _POWERS else 0
    if size < n + 1:
        size = max(n + 1, 2 * size, 1 << 16)
        out = []
        for base in (MULT, np.uint64(pow(int(MULT), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(p, out=p)
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def gather(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.BinaryArray:
    """The byte slices as a binary array."""
    out = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(length, out=out[1:])
    index = np.repeat(begin - out[:-1], length) + np.arange(out[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(out), pa.py_buffer(np.ascontiguousarray(data[index]))]).cast(pa.binary())


def unique_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct piece, for each piece its distinct piece).

    Pieces with one key but other bytes would be told apart by a second key; both are
    polynomial keys of 64 bits with the length mixed in, so equal pairs are taken as equal
    only after the bytes agree.
    """
    import pandas as pd

    inverse, distinct = pd.factorize(keys(data, offsets))
    first = np.empty(len(distinct), np.int64)
    first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
    length = np.diff(offsets)
    bad = length != length[first][inverse]
    if not bad.any():
        bad = _differ(data, offsets, length, first[inverse])
    if bad.any():  # practically never: redo exactly
        raw = data.tobytes()
        seen: dict[bytes, int] = {}
        order, inverse = [], np.empty(len(length), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            j = seen.setdefault(raw[a:b], len(seen))
            if j == len(order):
                order.append(i)
            inverse[i] = j
        first = np.array(order, np.int64)
    return first, inverse


def _differ(data, offsets, length, same_as):
    """Whether each piece differs from the piece it is held equal to, compared by bytes."""
    total = int(length.sum())
    if not total:
        return np.zeros(len(length), bool)
    shift = np.repeat(offsets[:-1][same_as] - offsets[:-1], length)
    unequal = data[offsets[0] : offsets[-1]] != data[np.arange(offsets[0], offsets[-1]) + shift]
    sums = np.zeros(total + 1, np.int64)
    np.cumsum(unequal, out=sums[1:])
    rel = offsets - offsets[0]
    return sums[rel[1:]] != sums[rel[:-1]]


def slices(batch: pa.RecordBatch, columns: list[str], most_bytes: int = 2 << 20):
    """Row ranges of the batch whose texts hold about `most_bytes` (at least one row each)."""
    if not batch.num_rows:
        return
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += np.diff(text_buffers(batch.column(batch.schema.get_field_index(c)))[1])
    total = np.cumsum(size)
    begin = 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + most_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def count_pieces(columns: list[str]):
    """mapInArrow function: (piece, n) of each slice, counted."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, columns):
                for c in columns:
                    data, offsets, _ = pieces(part.column(part.schema.get_field_index(c)))
                    if len(offsets) <= 1:
                        continue
                    first, inverse = unique_pieces(data, offsets)
                    n = np.bincount(inverse, minlength=len(first)).astype(np.int64)
                    length = np.diff(offsets)[first]
                    yield pa.RecordBatch.from_arrays([gather(data, offsets[:-1][first], length), pa.array(n)], ["piece", "n"])

    return run


def piece_counts(df, columns: list[str]):
    """Distinct pieces of all texts in `columns` with their number of occurrences."""
    from pyspark.sql import functions as F

    part = df.select(*columns).mapInArrow(count_pieces(columns), "piece binary, n bigint")
    return part.groupBy("piece").agg(F.sum("n").alias("n"))


#: A piece is frequent if it makes up at least this share of all pieces; so there are at most
#: 1 / FREQUENT_SHARE of them, however large the corpus is.
FREQUENT_SHARE = 1 / 65536


def frequent(counts, least_share: float = FREQUENT_SHARE):
    """Rows of `counts` (piece, n, ...) with at least the share; at most 1 / least_share rows."""
    from pyspark.sql import functions as F

    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(1.0, total * least_share))
