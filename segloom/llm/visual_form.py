"""One consistent form for texts that look the same.

A batch of texts is exploded to positioned code points (one row of three columns: text,
position, code point, held as arrays), joined with the broadcast tables of decompositions and
look-alikes (a lookup by code point; the tables have one entry for each code point at most),
ordered by combining class after each base, recomposed, and rebuilt to strings.

There are two forms. The look is a key: letters of all scripts that look alike are one. The
text form keeps the script of a word: a letter of another script is replaced only inside a word
(or beside words) whose other letters say which script it is in.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import tokenizers as T
from segloom.util import table

#: Letters of other scripts that look like Latin ones, and signs that look alike.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ԍ": "ɢ",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ү": "Y", "Ӏ": "I",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "γ": "y", "υ": "u", "κ": "к", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Γ": "Г",
    "ɑ": "a", "ɡ": "g", "ӕ": "æ", "Ӕ": "Æ", "Ð": "Đ", "Ɖ": "Đ", "ԑ": "ɛ", "ε": "ɛ", "ӡ": "ʒ",
    "‐": "-", "‑": "-", "﹣": "-", "ʼ": "’", "՚": "’", "ꞌ": "'", "∶": ":", "։": ":", "꞉": ":", "ː": ":",
    "օ": "o", "հ": "h", "յ": "j", "ս": "u", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    "⁄": "/", "∕": "/", "․": ".", "‥": "..", "…": "...", "µ": "μ", "Ω": "Ω", "℃": "°C", "℉": "°F", "ſ": "s",
}
#: Kinds of compatibility decompositions that keep the look; others (superscripts, circles,
#: fractions, squares) look different and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<final>", "<initial>", "<medial>")
#: Ranges of code points that are compatibility spellings of a look they share:
#: Latin ligatures and digraphs, Armenian ligatures, Roman numerals, other widths of spaces.
LIGATURES = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2000, 0x200A), (0x205F, 0x205F))
#: Format characters that do show or join (Arabic and other number signs).
VISIBLE_FORMAT = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110CD))
#: Characters without a look besides those of category Cf.
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))


#: Scripts whose letters are told apart, by the first word of a letter's name.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")


def _within(c: int, ranges) -> bool:
    return any(a <= c <= b for a, b in ranges)


def _script(ch: str) -> int:
    """1.. for a letter of one of SCRIPTS, else 0."""
    if unicodedata.category(ch)[0] != "L":
        return 0
    first = unicodedata.name(ch, "").partition(" ")[0]
    return SCRIPTS.index(first) + 1 if first in SCRIPTS else 0


@functools.lru_cache(maxsize=None)
def _spell(ch: str, keep: bool = False) -> str:
    """Full decomposition of one character into the basic characters of its look; `keep` leaves
    letters of the scripts what they are."""
    c = ord(ch)
    if _within(c, UNSEEN) or (unicodedata.category(ch) == "Cf" and not _within(c, VISIBLE_FORMAT)):
        return ""
    if ch in LOOK_ALIKES and LOOK_ALIKES[ch] != ch and not (keep and _script(ch) and ch != "µ"):
        return "".join(_spell(x, keep) for x in LOOK_ALIKES[ch])
    if unicodedata.category(ch) == "Zs":
        return " "
    if 0xAC00 <= c <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    kind = kind and kind + ">"
    if rest and (not kind or kind in SAME_LOOK or (kind == "<compat>" and _within(c, LIGATURES))):
        return "".join(_spell(chr(int(x, 16)), keep) for x in rest.split())
    return ch


@functools.lru_cache(maxsize=1)
def script_tables():
    """Script of each code point; its script again if no other script has its look; whether it
    is upper case; and for each script the letter of that script with the same look."""
    script = np.zeros(0x110000, np.uint8)
    upper = np.zeros(0x110000, bool)
    for c in range(0x20000):
        if s := _script(chr(c)):
            script[c], upper[c] = s, unicodedata.category(chr(c)) == "Lu"
    looks: dict[str, dict[int, str]] = {}
    for a, b in LOOK_ALIKES.items():
        if len(b) == 1 and _script(a):
            while b in LOOK_ALIKES and LOOK_ALIKES[b] != b:
                b = LOOK_ALIKES[b]
            own = looks.setdefault(b, {_script(b): b})
            own.setdefault(_script(a), a)
    clear = script.copy()
    to = np.tile(np.arange(0x110000, dtype=np.uint32), (len(SCRIPTS) + 1, 1))
    for a in {*LOOK_ALIKES, *looks}:
        look = a
        while look in LOOK_ALIKES and LOOK_ALIKES[look] != look:
            look = LOOK_ALIKES[look]
        if _script(a) and len(looks.get(look, {})) > 1:
            clear[ord(a)] = 0
            for s, letter in looks[look].items():
                to[s, ord(a)] = ord(letter)
    return script, clear, upper, to


def _before(known: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word the last known value of its text up to it, 0 if there is none."""
    at = np.maximum.accumulate(np.where(known > 0, np.arange(len(known)), -1))
    return np.where((at >= 0) & (text[at] == text), known[at], 0)


def one_script(points: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Decomposed code points with the look-alikes of other scripts replaced.

    A word's script is that of its letters that look like no other script's (the most frequent
    one, ties to the first of SCRIPTS). A word without such letters follows the word before it,
    or the next one, unless it is an abbreviation (several capitals). None of this looks at
    the letters that may be replaced, so it is the same however they are spelled.
    """
    script, clear, upper, to = script_tables()
    own = script[points]
    if len(np.unique(own[own > 0])) < 2:
        return points
    mark = tables()[3]
    inside = (own > 0) | (mark[points] > 0)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
    at = np.flatnonzero(inside)
    word = (np.cumsum(new) - 1)[at]
    n = int(new.sum())
    of = text[np.flatnonzero(new)]
    width = len(SCRIPTS) + 1
    sure = np.bincount(word * width + clear[points[at]], minlength=n * width).reshape(n, width)[:, 1:]
    known = np.where(sure.any(axis=1), sure.argmax(axis=1) + 1, 0)
    beside = _before(known, of)
    later = _before(known[::-1], of[::-1])[::-1]
    capitals = np.bincount(word, upper[points[at]], n)
    known = np.where((known > 0) | (capitals >= 2), known, np.where(beside > 0, beside, later))
    target = known[word]
    wrong = (target > 0) & (own[at] > 0) & (own[at] != target)
    if not wrong.any():
        return points
    points = points.copy()
    points[at[wrong]] = to[target[wrong], points[at[wrong]]]
    return points


@functools.lru_cache(maxsize=2)
def tables(keep: bool = False):
    """(length of each spelling, its begin, all spellings, combining classes, pairs, composites)."""
    size = np.ones(0x110000, np.uint8)
    begin = np.zeros(0x110000, np.int32)
    flat: list[int] = [0]  # so that begin is above 0 for every mapped code point
    mark = np.zeros(0x110000, np.uint8)
    compose = {}
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        mark[c] = unicodedata.combining(ch)
        if (s := _spell(ch, keep)) != ch:
            size[c], begin[c] = len(s), len(flat)
            flat.extend(map(ord, s))
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and unicodedata.normalize("NFC", ch) == ch:
            head = unicodedata.normalize("NFC", d[:-1])
            if len(head) == 1:
                compose[ord(head) << 21 | ord(d[-1])] = c
    pairs = np.array(sorted(compose), np.int64)
    return size, begin, np.array(flat, np.uint32), mark, pairs, np.array([compose[p] for p in pairs.tolist()], np.uint32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Composite of each pair, 0 if there is none."""
    *_, pairs, composites = tables()
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    return np.where(pairs[at] == key, composites[at], 0)


def consistent(points: np.ndarray, text: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their text numbers (rising) in the form of their look, or with `keep` in
    the text form."""
    size, begin, flat, mark, *_ = tables(keep)
    changed = begin[points] > 0
    if changed.any():
        n = size[points].astype(np.int64)
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        source = np.repeat(points, n)
        text = np.repeat(text, n)
        mapped = np.repeat(changed, n)
        points = source.copy()
        points[mapped] = flat[(begin[source[mapped]] + inside[mapped])]
    if not len(points):
        return points, text
    if keep:
        points = one_script(points, text)
    order = mark[points]
    if not order.any():
        return _join_starters(points, text)
    # a run is a base and the marks after it; marks don't cross texts
    base = (order == 0) | np.concatenate([[True], text[1:] != text[:-1]])
    run = np.cumsum(base) - 1
    late = np.zeros(len(points), bool)
    late[1:] = (order[1:] > 0) & (order[:-1] > order[1:]) & (run[1:] == run[:-1])
    if late.any():
        again = np.isin(run, run[late])
        at = np.flatnonzero(again)
        lead = base[at] & (order[at] == 0)
        points = points.copy()
        points[at] = points[at][np.lexsort((np.where(lead, -1, order[at].astype(np.int16)), run[at]))]
        order = mark[points]
    # recompose: marks of all runs together, by their place in the run
    first = np.flatnonzero(base)
    place = np.arange(len(points)) - first[run]
    keep = np.ones(len(points), bool)
    points = points.copy()
    kept = np.zeros(len(first), np.int16)  # class of the last mark that stayed in the run
    for p in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place == p)
        r = run[at]
        whole = _pair(points[first[r]], points[at])
        joins = (whole > 0) & (kept[r] < order[at]) & (order[first[r]] == 0)
        points[first[r[joins]]] = whole[joins]
        keep[at[joins]] = False
        kept[r[~joins]] = order[at[~joins]]
    return _join_starters(points[keep], text[keep])


@functools.lru_cache(maxsize=1)
def _seconds() -> np.ndarray:
    """Whether a code point without a combining class may join the one before it."""
    _, _, _, mark, pairs, _ = tables()
    second = np.zeros(0x110000, bool)
    second[pairs & 0x1FFFFF] = True
    return second & (mark == 0)


def _join_starters(points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins neighbours without combining classes that have a composite (Hangul and a few)."""
    while len(points) > 1 and _seconds()[points].any():
        whole = np.where((text[1:] == text[:-1]) & _seconds()[points[1:]], _pair(points[:-1], points[1:]), 0)
        at = np.flatnonzero(whole)
        if not len(at):
            break
        at = at[np.concatenate([[True], np.diff(at) > 1])]
        points = points.copy()
        points[at] = whole[at]
        keep = np.ones(len(points), bool)
        keep[at + 1] = False
        points, text = points[keep], text[keep]
    return points, text


def canonical_column(col: pa.Array, keep: bool = False) -> pa.Array:
    """The look of each text, or with `keep` its text form; null stays null."""
    data, offsets = T.text_buffers(col)
    points, _, text_offsets = T.code_points(data, offsets)
    text = np.repeat(np.arange(len(col)), np.diff(text_offsets))
    points, text = consistent(points, text, keep)
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    ends = np.append(lead, len(raw))[np.searchsorted(text, np.arange(len(col) + 1))]
    out = pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
    if col.null_count:
        import pyarrow.compute as pc

        out = pc.if_else(col.is_valid(), out, pa.nulls(len(col), pa.string()))
    return out


def consistent_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, text in its consistent form, look); null texts stay null, other columns are
    ignored.

    The text form is meant to be read and trained on: words of one script stay in it. `look` is
    a key that is equal exactly for texts that look the same, for comparisons; null for a text
    without anything to see.
    """

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, ["text"]):
                col = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), canonical_column(col, keep=True), pa.array(_looks(col), pa.binary())], ["id", "text", "look"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, text string, look binary").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "look")


def _hash16(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _looks(col: pa.Array) -> list[bytes | None]:
    """Digest of the look of each text, None for null, empty and blank ones."""
    form = canonical_column(col).cast(pa.binary()).to_pylist()
    return [_hash16(f) if f is not None and f and not f.decode().isspace() else None for f in form]


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, raw) of the texts with something to see, written once."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, ["text"]):
                col = part.column(1)
                look = _looks(col)
                raw = col.cast(pa.binary()).to_pylist()
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(look, pa.binary()), pa.array([_hash16(r) if r is not None else None for r in raw], pa.binary())], ["id", "look", "raw"])
                yield out.filter(pa.array([x is not None for x in look]))

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return table(texts.mapInArrow(run, f"id {kind}, look binary, raw binary"), "looks")


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents that look the same but differ in characters: (a, b) as `id_col`_a < _b.

    Null, empty and blank texts (also of zero-width characters only) are in no pair; documents
    with the same characters aren't a pair, but each of them pairs with every look-alike. Only
    looks with more than one spelling reach the self-join: that is decided by the least and the
    greatest key of the spellings, which combine before the shuffle.
    """
    keyed = _digests(df, id_col, text_col)
    several = keyed.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select("look")
    rows = keyed.join(several, "look", "left_semi")
    a, b = (rows.select("look", F.col("id").alias(f"{id_col}_{x}"), F.col("raw").alias(f"raw_{x}")) for x in "ab")
    return a.join(b, "look").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).where("raw_a != raw_b").select(f"{id_col}_a", f"{id_col}_b").distinct()


def look_alike_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose look has more than one spelling: (`id_col`, class_id, n_docs, n_spellings).

    class_id is the least id of the documents that look the same. One row for each document,
    so a template with many spellings isn't expanded to pairs.
    """
    keyed = _digests(df, id_col, text_col)
    spelled = keyed.groupBy("look", "raw").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    sizes = spelled.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_spellings")).where("n_spellings > 1")
    return keyed.join(sizes, "look").select(F.col("id").alias(id_col), "class_id", "n_docs", "n_spellings")


def spelling_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """By source: documents with text, and those whose characters the consistent form changes."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, ["text"]):
                import pyarrow.compute as pc

                changed = pc.not_equal(canonical_column(part.column(1), keep=True), part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), changed], ["source", "changed"])

    texts = df.where(F.col(text_col).isNotNull()).select(F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "source string, changed bigint").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("changed").alias("n_changed"))
