"""Language of each text and of each stretch of a mixed one, by words first.

A known word scores by its log frequency in each language; an unseen one backs off to the
longest known character n-grams at each of its positions, down to single characters. Known
words decide where there are enough of them; where there aren't, n-grams decide by a larger
lead. The counts are taken over the whole table, with the labels that name a language; wrong
labels are a small part of them. Confidences are calibrated against the labels.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.langs import with_label_codes
from segloom.util import blank, table

#: A language needs this many labelled texts to get a model. A label with less than RARE of all
#: texts may be nothing but a wrong label of frequent languages' texts: it gets no model if half of
#: its words or more are frequent words of the frequent languages.
LEAST_TEXTS = 20
RARE = 1 / 500
#: A word or n-gram enters the model if it makes up this share of those of its language and
#: order, so there are at most 1 / share of them for each, however large the corpus is.
LEAST_WORD_SHARE = 1 / 20000
LEAST_GRAM_SHARE = 1 / 5000
LEAST_COUNT = 3
ORDER = 4
#: Nats by which the best language of a sentence must lead by its known words, the number of
#: known words it needs, and their share of all its words. Single letters don't count as known,
#: since garbled text and initials are full of them.
LEAST_LEAD = 6.0
LEAST_KNOWN = 2
LEAST_KNOWN_SHARE = 0.2
#: Nats by which words and n-grams together must lead in a text without enough known words, and
#: the number of words that it needs.
GRAM_LEAD = 12.0
GRAM_WORDS = 3
#: Labelled texts that confidences are calibrated on at most, and the divisors of scores tried.
CALIBRATION_TEXTS = 4000
DIVISORS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
#: Largest difference that an unseen word can make, and nats beyond which a lead is certain.
DEEPEST = math.log(10 / LEAST_GRAM_SHARE)
CERTAIN = 16.0

CJK = re.compile(r"[ぁ-ヿ一-鿿々]")
#: First and last character of the scripts whose runs are words, since texts in
#: them have no spaces.
RUNS = (("ぁ", "ゟ"), ("゠", "ヿ"), ("一", "鿿"), ("々", "々"))


def _begins() -> str:
    """Character class of what may begin a sentence: upper and title case letters, and letters of
    scripts without case."""
    ranges: list[list[int]] = []
    for c in range(0x20000):
        if unicodedata.category(chr(c)) in ("Lu", "Lt", "Lo"):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: Signs that end a sentence, in several scripts.
ENDS = ".!?؟۔।॥։።။៕"
#: Sentences end after closing punctuation; if it isn't East Asian, before white space and
#: something that may begin a sentence.
_CLOSERS, _NEXT = r"[」』”»“\"'’)\]]*", rf"(\s+(?=\W*[{_begins()}]))"
SENTENCE = re.compile(f"([{ENDS}]){_CLOSERS}{_NEXT}")
SENTENCE_CJK = re.compile(f"([{ENDS}…。！？]){_CLOSERS}{_NEXT}?")


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind of each code point: 0 no letter, 1 letter, others the scripts of RUNS, 9 an apostrophe;
    its lower case)."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalnum() and not ch.isdecimal():
            kind[c] = 1
        lower[c] = ord(ch.lower()[:1] or ch)
    kind[0x20000:0x32000] = 1
    for k, (first, last) in enumerate(RUNS, 2):
        kind[ord(first) : ord(last) + 1] = min(k, 4)  # 々 goes with Han
    kind[[ord("'"), ord("’")]] = 9
    return kind, lower


class Words:
    """The words of some texts: text and key of each word; a key is one word's, in any text.

    Words are runs of letters (an apostrophe between letters is one) without case; a run of a
    script of RUNS is a word. All texts are one array of code points.
    """

    def __init__(self, texts: list[str]):
        kinds, lower = _tables()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        kind = kinds[points]
        starts = np.zeros(len(points) + 1, bool)
        starts[np.cumsum(size) - size] = True
        marks = np.flatnonzero(kind == 9)
        if len(marks):
            inner = marks[(marks > 0) & (marks + 1 < len(points))]
            inner = inner[(kind[inner - 1] == 1) & (kind[inner + 1] == 1) & ~starts[inner] & ~starts[inner + 1]]
            kind = kind.copy()
            kind[marks] = 0
            kind[inner] = 1
        change = np.ones(len(points) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | starts[1:-1]
        edge = np.flatnonzero(change)
        word = kind[edge[:-1]] > 0 if len(points) else np.zeros(0, bool)
        self.begin, self.end = edge[:-1][word], edge[1:][word]
        self.text = np.repeat(np.arange(len(texts)), size)[self.begin] if len(points) else self.begin
        self.points = lower[points]
        with np.errstate(over="ignore"):
            # sums of characters by powers of an odd number, shifted to the word's own begin
            power = np.full(len(points) + 1, 0x9E3779B97F4A7C15, np.uint64)
            back = np.full(len(points) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
            power[0] = back[0] = 1
            power, back = np.cumprod(power), np.cumprod(back)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.points) * power[:-1])])
            self.key = _mixed((sums[self.end] - sums[self.begin]) * back[self.begin] + (self.end - self.begin).astype(np.uint64))

    def string(self, i: int) -> str:
        return self.points[self.begin[i] : self.end[i]].tobytes().decode("utf-32-le")

    def list(self) -> list[str]:
        return [self.string(i) for i in range(len(self.begin))]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(29)


def words(text: str) -> list[str]:
    return Words([text]).list()


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences; they cover the text."""
    edges = [0]
    for m in (SENTENCE_CJK if CJK.search(text) or "…" in text else SENTENCE).finditer(text):
        if (m.group(2) or m.group(1) in "。！？") and m.end() < len(text):
            edges.append(m.end())
    edges.append(len(text))
    return list(zip(edges, edges[1:]))


def _count_words(batches):
    for batch in batches:
        langs, lang = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        found = Words(batch.column(1).to_pylist())
        with np.errstate(over="ignore"):
            code, distinct = pd.factorize(found.key * np.uint64(2 * len(langs) + 1) + lang[found.text].astype(np.uint64))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        n = np.bincount(code, minlength=len(distinct)).tolist() + np.bincount(lang, minlength=len(langs)).tolist()
        whose = langs[np.concatenate([lang[found.text[first]], np.arange(len(langs))])]
        own = [found.string(i) for i in first.tolist()] + [""] * len(langs)
        yield pa.RecordBatch.from_arrays([pa.array(whose, pa.string()), pa.array(own, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def gram_counts(found: list[str]) -> list[tuple[int, str, int]]:
    """(order, n-gram, occurrences) in padded words, for orders 1 to ORDER.

    All words are one array of code points. An n-gram is numbered by its first n - 1 characters
    and its last one, so equal numbers are equal n-grams.
    """
    text = "".join(f" {w} \n" for w in found)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ends = points == 10
    number, inside, out = np.zeros(len(points), np.int64), np.ones(len(points), bool), []
    for order in range(1, ORDER + 1):
        size = max(0, len(points) - order + 1)
        inside = inside[:size] & ~ends[order - 1 :]
        begin = np.flatnonzero(inside)
        code, distinct = pd.factorize(number[begin] << 21 | points[begin + order - 1])
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = begin[::-1]
        out += [(order, text[i : i + order], n) for i, n in zip(first.tolist(), np.bincount(code, minlength=len(distinct)).tolist())]
        number = np.zeros(size, np.int64)
        number[begin] = code
    return out


def _count_grams(batches):
    for batch in batches:
        own: dict[str, list[str]] = {}
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own.setdefault(lang, []).append(word)
        rows = [(lang, *g) for lang, found in own.items() for g in gram_counts(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "ord", "gram", "n"])


class Model:
    """Scores of words, and of n-grams for words it doesn't know."""

    def __init__(self, langs: list[str], word_counts: dict[str, dict[str, int]], totals: dict[str, int], gram_counts: list[dict[str, dict[str, int]]], gram_totals: list[dict[str, int]], priors: dict[str, float]):
        self.langs = langs

        def matrix(counts: dict[str, dict[str, int]], total: dict[str, int], floor: float):
            out = np.full((len(counts) + 1, len(langs)), 0.0, np.float32)
            for k, own in enumerate(counts.values()):
                out[k] = [math.log(max(own.get(lang, 0) / max(total.get(lang, 0), 1), floor)) for lang in langs]
            return out

        # single letters of alphabets aren't known words
        index = [(w, i) for i, w in enumerate(word_counts) if len(w) > 1 or w > "\u3000"]
        keys = np.array([_word_key(w) for w, _ in index], np.uint64)
        order = np.argsort(keys)
        self.keys, self.place = keys[order], np.array([i for _, i in index], np.int64)[order]
        self.scores = matrix(word_counts, totals, LEAST_WORD_SHARE / 10)
        self.grams: dict[str, int] = {}
        parts = []
        for counts, total in zip(gram_counts, gram_totals):
            self.grams |= {g: len(self.grams) + i for i, g in enumerate(counts)}
            parts.append(matrix(counts, total, LEAST_GRAM_SHARE / 10)[:-1])
        self.gram_scores = np.vstack(parts)
        self.prior = np.array([priors[lang] for lang in langs], np.float32)
        self.seen: dict[str, list[int]] = {}
        self.divisor = 1.0

    def backoff(self, word: str) -> list[int]:
        """At each position of an unseen word the longest known n-gram that ends there."""
        known = self.seen.get(word)
        if known is not None:
            return known
        padded, get, out = f" {word} ", self.grams.get, []
        for end in range(1, len(padded) + 1):
            for begin in range(max(0, end - ORDER), end):
                if (i := get(padded[begin:end])) is not None:
                    out.append(i)
                    break
        if len(self.seen) > 200_000:  # a bound on memory; results don't depend on it
            self.seen.clear()
        self.seen[word] = out
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: scores of its known words, scores of the n-grams of the others (the
        mean over a word's positions; 0 where the known words decide whatever the others are),
        number of known words, number of words."""
        found = Words(texts)
        owner = found.text
        n_words = np.bincount(owner, minlength=len(texts))
        at = np.full(len(owner), -1, np.int64)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, found.key), len(self.keys) - 1)
            at = np.where(self.keys[near] == found.key, self.place[near], -1)
        seen = at >= 0
        known = _add_up(self.scores, at[seen], owner[seen], None, len(texts))
        # unseen words are backed off only where they could change anything: a word's score in
        # two languages differs by DEEPEST at most
        n_known = np.bincount(owner[seen], minlength=len(texts))
        top = np.sort(known, axis=1)
        lead = top[:, -1] - top[:, -2] if known.shape[1] > 1 else np.zeros(len(texts))
        open_ = lead < DEEPEST * (n_words - n_known + 1) + CERTAIN + (np.ptp(self.prior) if len(self.prior) else 0.0)
        unseen = np.flatnonzero(~seen & open_[owner])
        # each distinct word once
        code, distinct = pd.factorize(found.key[unseen])
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = unseen[::-1]
        own = [self.backoff(found.string(i)) for i in first.tolist()]
        each = np.array([len(x) for x in own], np.int64)
        pool = np.fromiter((i for x in own for i in x), np.int64, int(each.sum()))
        size = each[code]
        gram = pool[np.repeat((np.cumsum(each) - each)[code], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
        other = _add_up(self.gram_scores, gram, np.repeat(owner[unseen], size), np.repeat(1.0 / np.maximum(size, 1), size).astype(np.float32), len(texts))
        return known, other, n_known, n_words

    def decide(self, known: np.ndarray, other: np.ndarray, n: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, confidence) of each row of scores."""
        if not len(self.langs) or not len(known):
            return np.full(len(known), -1), np.zeros(len(known))
        total = known + other + self.prior
        row = np.arange(len(total))
        best = total.argmax(axis=1)
        rest = known.copy()
        rest[row, best] = -np.inf
        lead = known[row, best] - rest.max(axis=1)
        sure = (n >= LEAST_KNOWN) & (n >= LEAST_KNOWN_SHARE * every) & (lead >= LEAST_LEAD)
        rest = known + other
        both = rest[row, best].copy()
        rest[row, best] = -np.inf
        sure |= (every >= GRAM_WORDS) & (both - rest.max(axis=1) >= GRAM_LEAD)
        p = 1.0 / np.exp((np.minimum(0.0, total - total[row, best][:, None]) / self.divisor).astype(np.float64)).sum(axis=1)
        return np.where(sure, best, -1), np.where(sure, p, 0.0)

    def stretches(self, texts: list[str]) -> list[list[tuple[int, int, str | None, float]]]:
        """(begin, end, language, confidence) of the stretches of one language of each text.

        A sentence has a language if its words or their n-grams decide it; others (fragments, names,
        numbers) belong to the stretch before, or to the next one at the start. The whole text
        is tried as one where no sentence decides alone. Without any language, one stretch with
        null and 0.
        """
        spans = [sentences(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in spans])
        known, other, n, every = self.score([t[a:b] for t, x in zip(texts, spans) for a, b in x])
        lang, p = self.decide(known, other, n, every)
        add = lambda x: np.add.reduceat(x, np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0])), axis=0) if len(owner) else x
        whole, whole_p = self.decide(add(known), add(other), add(n), add(every))
        out, k = [], 0
        for t, own in enumerate(spans):
            here: list[list] = []
            for (a, b), i, q in zip(own, lang[k : k + len(own)].tolist(), p[k : k + len(own)].tolist()):
                if here and (i < 0 or here[-1][2] < 0 or i == here[-1][2]):
                    last = here[-1]
                    last[1], last[2], last[3] = b, max(last[2], i), max(last[3], q)
                else:
                    here.append([a, b, i, q])
            k += len(own)
            if len(here) == 1 and here[0][2] < 0:
                here[0][2:] = [int(whole[t]), float(whole_p[t])]
            out.append([(a, b, self.langs[i] if i >= 0 else None, q) for a, b, i, q in here])
        return out


    def calibrate(self, texts: list[tuple[str, str]]) -> None:
        """Sets the divisor of scores under which labels are likeliest: words of a text aren't
        independent, so plain sums are too sure. The share of wrong labels is that of the quarter
        of the texts with the largest leads."""
        texts = [t for t in texts if t[0] in self.langs]
        if len(self.langs) < 2 or not texts:
            return
        known, other, _, _ = self.score([t for _, t in texts])
        total = (known + other + self.prior).astype(np.float64)
        label = np.array([self.langs.index(c) for c, _ in texts])
        best = total.argmax(axis=1)
        top = np.sort(total, axis=1)
        far = np.argsort(top[:, -2] - top[:, -1], kind="stable")[: max(1, len(texts) // 4)]
        noise = min(0.5, max(1e-3, float((best[far] != label[far]).mean())))
        fit = []
        for d in DIVISORS:
            p = np.exp((total - total.max(axis=1, keepdims=True)) / d)
            p = p[np.arange(len(label)), label] / p.sum(axis=1)
            fit.append(float(np.log((1 - noise) * p + noise / len(self.langs)).sum()))
        self.divisor = DIVISORS[int(np.argmax(fit))]


def _word_key(word: str) -> np.uint64:
    """Key of a word of the model, as Words gives it."""
    found = Words([word])
    return found.key[0] if len(found.key) == 1 else np.uint64(0)


def _add_up(scores: np.ndarray, at: np.ndarray, owner: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """Sums of the rows `at` of the scores by owner (rising)."""
    out = np.zeros((n, scores.shape[1]), np.float32)
    if len(at):
        rows = scores[at] if weight is None else scores[at] * weight[:, None]
        first = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
        out[owner[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _texts(df: DataFrame, id_col: str, names: DataFrame | None = None) -> DataFrame:
    """(id, field, label code, text) of src and tgt that aren't blank."""
    rows = with_label_codes(df.select(F.col(id_col).alias("id"), "src_lang", "tgt_lang", "src", "tgt"), names, a="src_lang", b="tgt_lang")
    pairs = F.array(F.struct(F.lit("src").alias("field"), F.col("a").alias("code"), F.col("src").alias("text")), F.struct(F.lit("tgt").alias("field"), F.col("b").alias("code"), F.col("tgt").alias("text")))
    return rows.select("id", F.explode(pairs).alias("x")).select("id", "x.field", "x.code", "x.text").where(~blank(F.col("text")))


def train(texts: DataFrame) -> Model:
    """The model of all labelled texts (code, text); its size is bounded by the shares."""
    counts = texts.where("code is not null").select("code", "text").mapInArrow(_count_words, "lang string, word string, n bigint")
    counts = table(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    n_texts = {r.lang: r.n for r in counts.where("word = ''").collect()}  # one row for each language
    every = sum(n_texts.values())
    rare = sorted(lang for lang, n in n_texts.items() if LEAST_TEXTS <= n < every * RARE)
    langs = sorted(lang for lang, n in n_texts.items() if LEAST_TEXTS <= n and lang not in rare)
    if not langs:  # a small table, or very many languages
        langs, rare = rare or sorted(n_texts), []
    words, totals = _word_counts(counts, langs)
    if rare and (own := _of_their_own(counts, rare, langs, totals)):
        langs = sorted([*langs, *own])
        words, totals = _word_counts(counts, langs)
    if not langs:
        return Model([], {}, {}, [{}] * ORDER, [{}] * ORDER, {})
    # n-grams of distinct words, so frequent words don't drown the patterns of unseen ones
    own = counts.where(F.col("lang").isin(langs) & (F.col("word") != ""))
    grams_ = table(own.select("lang", "word").repartition(F.col("word")).mapInArrow(_count_grams, "lang string, ord int, gram string, n bigint").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    sums = {(r.lang, r.ord): r.n for r in grams_.groupBy("lang", "ord").agg(F.sum("n").alias("n")).collect()}
    limit = F.create_map(*[F.lit(x) for (lang, o), n in sums.items() for x in (f"{lang}{o}", max(float(LEAST_COUNT), n * LEAST_GRAM_SHARE))])
    gram_counts: list[dict[str, dict[str, int]]] = [{} for _ in range(ORDER)]
    if sums:
        frequent = grams_.where(F.col("n") >= limit[F.concat("lang", "ord")]).select("gram", "ord").distinct()
        for r in grams_.join(frequent, ["gram", "ord"], "left_semi").orderBy("ord", "gram", "lang").toLocalIterator():
            gram_counts[r.ord - 1].setdefault(r.gram, {})[r.lang] = r.n
    gram_totals = [{lang: sums.get((lang, o), 0) for lang in langs} for o in range(1, ORDER + 1)]
    model = Model(langs, words, totals, gram_counts, gram_totals, _priors(langs, n_texts))
    slot = F.pmod(F.xxhash64("id", "field"), F.lit(1 << 40))
    some = texts.where(F.col("code").isin(langs)).where(slot < int(min(1.0, 0.95 * CALIBRATION_TEXTS / max(1, every)) * (1 << 40)))
    model.calibrate(sorted((r.code, r.text) for r in some.select("code", "text").limit(CALIBRATION_TEXTS).collect()))
    return model


def _priors(langs: list[str], n_texts: dict[str, int]) -> dict[str, float]:
    every = max(1, sum(n_texts[lang] for lang in langs))
    return {lang: math.log(n_texts[lang] / every) for lang in langs}


def _frequent(own: DataFrame, langs: list[str], totals: dict[str, int]) -> DataFrame:
    """The words that are frequent in one of the languages: at most 1 / share for each."""
    limit = F.create_map(*[F.lit(x) for lang in langs for x in (lang, max(float(LEAST_COUNT), totals.get(lang, 0) * LEAST_WORD_SHARE))])
    return own.where(F.col("lang").isin(langs) & (F.col("n") >= limit[F.col("lang")])).select("word").distinct()


def _word_counts(counts: DataFrame, langs: list[str]) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Counts of the words that are frequent in one of the languages, and all words of each."""
    own = counts.where(F.col("lang").isin(langs) & (F.col("word") != ""))
    totals = {r.lang: r.n for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    word_counts: dict[str, dict[str, int]] = {}
    if langs:
        for r in own.join(_frequent(own, langs, totals), "word", "left_semi").orderBy("word", "lang").toLocalIterator():
            word_counts.setdefault(r.word, {})[r.lang] = r.n
    return word_counts, totals


def _of_their_own(counts: DataFrame, rare: list[str], langs: list[str], totals: dict[str, int]) -> list[str]:
    """Those of the rare labels whose words aren't mostly frequent words of the languages."""
    own = counts.where(F.col("lang").isin(rare) & (F.col("word") != ""))
    known = _frequent(counts.where("word != ''"), langs, totals).withColumn("known", F.lit(1))
    share = F.sum(F.when(F.col("known").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")
    return [r.lang for r in own.join(known, "word", "left").groupBy("lang").agg(share.alias("share")).collect() if r.share < 0.5]


def _label(texts: DataFrame, rows_of, schema: str) -> DataFrame:
    """Labels every text; rows_of makes the rows of a text from its label and stretches."""
    model = texts.sparkSession.sparkContext.broadcast(train(texts))
    names = ["id", "field", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (code, found) in enumerate(zip(batch.column(2).to_pylist(), model.value.stretches(batch.column(3).to_pylist()))):
                for row in rows_of(code, found):
                    at.append(i)
                    out.append(row)
            index = pa.array(at, pa.int64())
            kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "field", "code", "text").mapInArrow(run, f"id {kind}, field string, {schema}")


def _wrong(code: str | None, found) -> list[tuple[str]]:
    """The languages of a text, if its label doesn't hold."""
    langs = sorted({lang for _, _, lang, _ in found if lang})
    return [(lang,) for lang in langs] if len(langs) > 1 or (langs and code != langs[0]) else []


def text_languages(df: DataFrame, id_col: str = "seg_id", names: DataFrame | None = None) -> DataFrame:
    """Each stretch of one language in src and tgt, with a confidence.

    Columns `id_col`, field_name, part (0..), begin and length (in characters), lang,
    confidence. Texts whose words and n-grams decide no language (only names, numbers, fragments)
    are one stretch with a null language and confidence 0; null and blank texts have no row.
    """
    parts = lambda code, found: [(k, a, b - a, lang, p) for k, (a, b, lang, p) in enumerate(found)]
    out = _label(_texts(df, id_col, names), parts, "part int, begin int, length int, lang string, confidence double")
    return out.select(F.col("id").alias(id_col), F.col("field").alias("field_name"), "part", "begin", "length", "lang", "confidence")


def wrong_labels(df: DataFrame, id_col: str = "seg_id", names: DataFrame | None = None) -> DataFrame:
    """(`id_col`, field_name, lang): the languages of each text whose label doesn't hold.

    A text is given if its label is missing or names no language, names another one than the
    text's, or the text has sentences of two languages; one row for each of its languages.
    """
    out = _label(_texts(df, id_col, names), _wrong, "lang string")
    return out.select(F.col("id").alias(id_col), F.col("field").alias("field_name"), "lang")
