"""Text decoded with the wrong encoding: found and restored through the corpus's own words.

Every distinct clean word of the corpus is garbled under all chains of a right and a wrong
encoding. The garbled forms are hash-joined with the tokens of the corpus; a token that is the
garbled form of a more frequent word marks its text and is replaced by that word.

Three kinds of words are garbled: whole words (`w`), runs of non-ASCII characters inside words
(`r`, for encodings of several bytes a character, where a run garbles on its own), and single
characters (`c`), whose garbled forms are n-grams (`g`) of long runs: scripts without spaces
have no other words that repeat.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import bitfilter
from segloom.util import parallelism, shuffle_partitions, table

#: Characters outside ASCII but those of East Asian writing and its punctuation: a text may be
#: garbled in part, and a run that ends where clean characters begin is looked at on its own.
_OTHER = "\x80-\u2fff\u3100-\u33ff\ua000-\uff00\uffa0-\U0010ffff"
WORD = re.compile(f"[A-Za-z{_OTHER}]*[{_OTHER}][A-Za-z{_OTHER}]*")
RUN = re.compile(f"[{_OTHER}]+")
CJK = re.compile("[々-ヿ㐀-鿿ｦ-ﾟ]")
SIGN = re.compile(r"[^\w\s]|[\x80-\x9f\xa0]|_")
#: Longer tokens aren't words; they are known by their n-grams.
LONGEST = 48
LOST = "�"

#: Right encodings, and for each the encodings it is mistaken for. utf-8 as the
#: wrong one loses bytes (U+FFFD); a text that survives it whole was no garbling.
SINGLE = ["latin_1", "cp1252", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r"]
CHAINS: dict[str, list[str]] = {
    "utf_8": SINGLE,
    "cp1252": ["mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "latin_1", "utf_8"],
    "cp1250": ["cp1252", "latin_1", "iso8859_2", "cp1251", "cp852", "mac_roman", "utf_8"],
    "iso8859_2": ["cp1252", "latin_1", "cp1250", "utf_8"],
    "cp1251": ["latin_1", "cp1252", "cp1250", "koi8_r", "cp866", "cp437", "mac_roman", "utf_8"],
    "koi8_r": ["cp1251", "cp1252", "latin_1", "cp866", "cp437", "mac_roman", "utf_8"],
    "koi8_u": ["cp1251", "cp1252", "latin_1", "cp866", "utf_8"],
    "cp866": ["cp1251", "cp1252", "latin_1", "koi8_r", "cp437", "utf_8"],
    "iso8859_5": ["cp1251", "cp1252", "latin_1", "koi8_r", "utf_8"],
    "mac_roman": ["cp1252", "latin_1", "cp437", "utf_8"],
    "cp437": ["cp1252", "latin_1", "utf_8"],
    "cp850": ["cp1252", "latin_1", "utf_8"],
    "cp852": ["cp1250", "cp1252", "latin_1", "utf_8"],
    "cp932": ["cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "utf_8"],
    "euc_jp": ["cp1252", "latin_1", "mac_roman", "cp1251", "cp437", "utf_8"],
    "gbk": ["cp1252", "latin_1", "utf_8"],
}
EAST = {"cp932", "euc_jp", "gbk"}
SEVERAL = {"utf_8", *EAST}
#: Wrong twice: the garbled text was written as utf-8 and read wrongly again.
TWICE = [("utf_8", a, b) for a in ("cp1252", "latin_1") for b in ("cp1252", "latin_1")]
#: A word must be this many times as frequent as the token it explains: 1 where garbling
#: turns characters into several (no clean text looks like that), more where letters only
#: become other letters.
TIMES_SEVERAL, TIMES_SINGLE = 1, 4
#: A text counts so many times at most, however many copies it has: one garbled text in many
#: rows doesn't make its tokens frequent.
COPIES = 4


@functools.lru_cache(maxsize=None)
def _windows(name: str) -> dict[int, int]:
    """latin-1 to the encoding as browsers read it: undefined bytes stay control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = ord(bytes([b]).decode(name))
        except UnicodeDecodeError:
            pass
    return out


def decode(raw: bytes, name: str) -> str:
    """Bytes as a lenient reader of the encoding shows them; never fails."""
    if name in ("utf_8", "cp932", "gbk", "euc_jp"):
        return raw.decode(name, "replace")
    return raw.decode("latin_1").translate(_windows(name))


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def chains() -> list[tuple[str, ...]]:
    return [(right, wrong) for right, wrongs in CHAINS.items() for wrong in wrongs] + TWICE


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """The text as it reads after the chain; None if it can't be written or stays the same."""
    raw = _encode(text, chain[0])
    if raw is None:
        return None
    out = decode(raw, chain[1])
    for wrong in chain[2:]:
        if out == text:
            return None
        out = decode(out.encode("utf_8"), wrong)
    if out == text or (chain[1] == "utf_8" and LOST not in out):
        return None
    return out


def restore(text: str, chain: tuple[str, ...]) -> str | None:
    """Undoes a chain on a whole run, if garbling the result gives the run again."""
    out = text
    for step in range(len(chain) - 1, 0, -1):
        table_ = {v: k for k, v in _windows(chain[step]).items()} if chain[step] not in SEVERAL else None
        raw = _encode(out.translate(table_), "latin_1") if table_ is not None else _encode(out, chain[step])
        if raw is None:
            return None
        try:
            out = raw.decode(chain[0] if step == 1 else "utf_8")
        except UnicodeDecodeError:
            return None
    return out if garble(out, chain) == text else None


def tokens(text: str) -> set[tuple[str, str]]:
    """The tokens of a text that may be garbled forms, or words to garble, by kind."""
    out: set[tuple[str, str]] = set()
    for word in WORD.findall(text):
        if len(word) <= LONGEST:
            out.add(("w", word))
        for run in RUN.findall(word):
            if len(run) <= LONGEST and run != word:  # a whole word is known as such
                out.add(("r", run))
            if len(run) >= 6 and SIGN.search(run):
                out.update(("g", run[i : i + n]) for n in (2, 3) for i in range(len(run) - n + 1))
                # a character of three bytes mistaken twice is five to eight characters long
                out.update(("g", run[i : i + n]) for i, c in enumerate(run) if c == "Ã" for n in range(5, 9) if i + n <= len(run))
    if LOST in text:
        out.add(("g", LOST))
    return out


def _key(kind: str, token: str) -> int:
    """A key of a token for the filters that keep forms which the corpus doesn't have out of the
    shuffle."""
    raw = (kind + token).encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) * 0x9E3779B1 ^ zlib.adler32(raw)) & 0x7FFFFFFFFFFFFFFF


def _fields(df: DataFrame, id_col: str, text_cols) -> DataFrame:
    """(id, field, text) of the texts that have a character outside ASCII."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in text_cols]))
    rows = df.select(F.col(id_col).alias("id"), *text_cols).select("id", pairs.alias("x")).select("id", "x.field", "x.text")
    return rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))


def _count(batches):
    for batch in batches:
        seen: Counter = Counter()
        for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key in tokens(text):
                seen[key] += copies
            for c in set(text):
                if c > "\x7f":
                    seen["c", c] += copies
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()), pa.array([_key(k, t) for k, t in keys], pa.int64()), pa.array(seen.values(), pa.int64())], ["kind", "token", "key", "n"]
        )


def clean(token: str) -> bool:
    """No control characters and no lost ones: may be right as it is."""
    return not any("\x7f" <= c <= "\x9f" or c == LOST for c in token)


def possible(chars: list[str], every: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each code point, for each number and chain whether it may occur in a word that
    the chain garbles into characters of the corpus). ASCII, and number 0, may always.

    A form with a character that no text of the corpus has can't be one of its tokens, so no
    form is lost; most words fall out of most chains here, before they are garbled.
    """
    known = {*chars, *map(chr, range(128))}
    number = np.zeros(0x110000, np.int32)
    may = np.ones((len(chars) + 1, len(every)), bool)
    for i, c in enumerate(chars, 1):
        number[ord(c)] = i
        for k, chain in enumerate(every):
            form = garble(c, chain)
            # bytes that are read together with their neighbours' can't be told by themselves
            may[i, k] = LOST in known if chain[1] == "utf_8" else _encode(c, chain[0]) is not None and (form is None or known.issuperset(form))
    return number, may


def _garbler(bits_of, chars: list[str]):
    """mapInArrow: clean words (kind, token, n) to the forms that the corpus may have."""
    every = chains()
    name = [">".join(c) for c in every]
    # encodings of East Asian text garble its characters, and only those; a single character
    # that is lost on its own is a form as well
    use = {"w": [c[0] not in EAST for c in every], "r": [c[0] == "utf_8" for c in every], "c": [(c[0] in SEVERAL) != (c[1] == "utf_8") for c in every]}

    def forms(chain, words: list[str]):
        raw = "\n".join(words).encode(chain[0], "replace")
        out = decode(raw, chain[1])
        for wrong in chain[2:]:
            out = decode(out.encode("utf_8"), wrong)
        return [None if b"?" in r or f == w or (chain[1] == "utf_8" and LOST not in f) else f for w, f, r in zip(words, out.split("\n"), raw.split(b"\n"))]

    def run(batches):
        number, may = possible(chars, every)
        bits = bits_of.value
        for batch in batches:
            kinds, words, n = (batch.column(k).to_pylist() for k in range(3))
            rows: list[tuple] = []
            for kind in use:
                at = np.array([i for i, k in enumerate(kinds) if k == kind and clean(words[i])], np.int64)
                if not len(at):
                    continue
                want = "g" if kind == "c" else kind
                points = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
                first = np.cumsum([0, *(len(words[i]) for i in at[:-1])])
                fits = np.logical_and.reduceat(may[number[points]], first, axis=0) & np.array(use[kind])
                if kind == "c":  # n-grams are forms of characters that are written without spaces
                    fits &= np.array([bool(CJK.match(words[i])) for i in at])[:, None] | np.array([c[1] == "utf_8" for c in every])
                for k in np.flatnonzero(fits.any(axis=0)).tolist():
                    own = at[fits[:, k]].tolist()
                    made = [(i, f) for i, f in zip(own, forms(every[k], [words[i] for i in own])) if f is not None and (kind != "c" or every[k][1] != "utf_8" or f == LOST)]
                    has = bits.has(np.array([_key(want, f) for _, f in made], np.int64))
                    rows += [(want, f, words[i], name[k], n[i]) for (i, f), h in zip(made, has.tolist()) if h]
            types = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(5)], ["kind", "token", "word", "chain", "n_word"])

    return run


def garbled_tokens(fields: DataFrame) -> DataFrame:
    """Tokens of the corpus that are garbled forms: kind, token, key, word, chain, n_words.

    One row for each token, with its most frequent explanation.
    """
    spark = fields.sparkSession
    texts = fields.groupBy("text").agg(F.least(F.count("*"), F.lit(COPIES)).alias("copies"))
    part = texts.mapInArrow(_count, "kind string, token string, key bigint, n bigint")
    seen = table(part.groupBy("kind", "token").agg(F.first("key").alias("key"), F.sum("n").alias("n")), "tokens")
    bits = bitfilter.build(seen.where("kind != 'c'"), "key")
    chars = sorted(r.token for r in seen.where("kind = 'c'").select("token").collect())  # as many as Unicode has at most
    words = seen.where("kind != 'g'").select("kind", "token", "n")
    # the table's few files would be few tasks for much work
    forms = words.repartition(max(shuffle_partitions(spark), parallelism(spark)), "token").mapInArrow(_garbler(bits, chars), "kind string, token string, word string, chain string, n_word bigint")
    one = F.substring_index("chain", ">", 1)
    least = F.when(one.isin(*SEVERAL), TIMES_SEVERAL).otherwise(TIMES_SINGLE)
    lost = F.col("token").contains(LOST)
    hits = forms.join(seen.select("kind", "token", "key", "n"), ["kind", "token"]).where((F.col("n_word") >= least * F.col("n")) | lost)
    best = F.max_by(F.struct("word", "chain"), F.struct("n_word", "word", "chain"))
    return hits.groupBy("kind", "token", "key").agg(best.alias("b"), F.max("n_word").alias("n_word"), F.countDistinct("word").alias("n_words")).select("kind", "token", "key", "b.word", "b.chain", "n_words")


def _hits(fields: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, field, kind, token, word, chain, n_words) for each garbled token of each text."""
    bits_of = bitfilter.build(marked, "key")

    def run(batches):
        bits = bits_of.value
        for batch in batches:
            rows, own = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                here = tokens(text)
                rows += [i] * len(here)
                own += here
            some = np.flatnonzero(bits.has(np.array([_key(k, t) for k, t in own], np.int64))).tolist()
            at = pa.array([rows[j] for j in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([own[j][0] for j in some], pa.string()), pa.array([own[j][1] for j in some], pa.string())], ["id", "field", "kind", "token"])

    kind = fields.schema["id"].dataType.simpleString()
    few = fields.mapInArrow(run, f"id {kind}, field string, kind string, token string")
    return few.join(marked.drop("key"), ["kind", "token"])


def _evidence(hits: DataFrame) -> DataFrame:
    """Texts with enough of it: one word or run, a lost character, or two different weak tokens
    explained by one chain. Weak are n-grams and single characters, unless the character is a
    sign that no text of letters has by itself (a box, a mathematical sign, a control)."""
    single = (F.col("kind") == "w") & (F.length("token") == 1) & ~F.col("token").rlike(r"^[\p{S}\p{C}]$")
    lone = (F.col("kind") == "r") & (F.length("token") == 1)
    weak = ((F.col("kind") == "g") & (F.col("token") != LOST)) | single | lone
    chain = hits.groupBy("id", "field", "chain").agg(F.max((~weak).cast("int")).alias("strong"), F.countDistinct("token").alias("n"))
    return chain.where("strong = 1 or n >= 2").select("id", "field").distinct()


def garbled_fields(df: DataFrame, id_col: str = "seg_id", text_cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """(`id_col`, field_name) of each text that holds garbled text, recoverable or not.

    Null, empty and pure ASCII texts are never found. Ids should be unique; rows with one id
    give one row for each field.
    """
    fields = _fields(df, id_col, text_cols)
    hits = _hits(fields, table(garbled_tokens(fields), "garbled"))
    return _evidence(hits).select(F.col("id").alias(id_col), F.col("field").alias("field_name"))


def repair(text: str, words: dict[str, str], runs: dict[str, str], used: list[tuple[str, ...]]) -> tuple[str, bool]:
    """(restored text, whether nothing garbled is left), by verified words, then runs, then
    the chains that explained other tokens of the text, each checked by garbling again."""

    def run_of(m):
        run = m.group()
        if run in runs:
            return runs[run]
        for chain in used:
            if (back := restore(run, chain)) is not None:
                return back
        return run

    def word_of(m):
        word = m.group()
        if word in words:
            return words[word]
        for chain in used:  # trailing bytes of some encodings are ASCII letters
            if (back := restore(word, chain)) is not None:
                return back
        return RUN.sub(run_of, word)

    out = WORD.sub(word_of, text)
    return out, clean(out)


def restored_fields(df: DataFrame, id_col: str = "seg_id", text_cols: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """The garbled texts restored: (`id_col`, field_name, text, recovered boolean).

    Only tokens with one possible original are replaced; recovered is false if characters
    were lost or remain unexplained, and text then is restored as far as possible.
    """
    fields = _fields(df, id_col, text_cols)
    hits = table(_hits(fields, table(garbled_tokens(fields), "garbled")), "hits")
    proof = hits.groupBy("id", "field").agg(F.collect_set(F.struct("kind", "token", "word", "chain", "n_words")).alias("proof"))
    rows = fields.join(proof, ["id", "field"]).join(_evidence(hits), ["id", "field"], "left_semi")

    def run(batches):
        for batch in batches:
            texts, oks = [], []
            for text, proofs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                single = [p for p in proofs if p["n_words"] == 1 or LOST not in p["token"]]
                used = [c for c, _ in Counter(tuple(p["chain"].split(">")) for p in proofs).most_common() if c[1] != "utf_8"]
                out, ok = repair(text, {p["token"]: p["word"] for p in single if p["kind"] == "w"}, {p["token"]: p["word"] for p in single if p["kind"] == "r"}, used)
                texts.append(out)
                oks.append(ok and out != text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(oks)], ["id", "field_name", "text", "recovered"])

    kind = fields.schema["id"].dataType.simpleString()
    return rows.select("id", "field", "text", "proof").mapInArrow(run, f"id {kind}, field_name string, text string, recovered boolean").withColumnRenamed("id", id_col)
