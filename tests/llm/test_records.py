import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions.langs import code_of
from segloom.llm import collapse, grouped_splits, overlap

SEG = "seg_id bigint, doc_key string, src_lang string, tgt_lang string, src string, text_domain string, doc string, root string"


def seg_rows(n=600, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        doc = None if rng.random() < 0.1 else ("d000" if rng.random() < 0.3 else f"d{rng.randint(1, 150):03}")
        src = rng.choice([None, "", " ", *[f"text {rng.randint(0, 400)}"] * 7])
        rows.append((i, doc, rng.choice(["en", "English", " EN", "de", "xx", None]), rng.choice(["de", "fr", None]), f" {src}" if src and rng.random() < 0.2 else src, rng.choice(["news", "law", None]), "clash", "clash"))
    return rows


def brute_groups(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    keys = {}
    for r in rows:
        own = [("d", r[1])] if r[1] is not None else []
        if r[4] and r[4].strip() and code_of(r[2]):
            own.append(("s", code_of(r[2]), r[4].strip()))
        own = own or [("r", r[0])]
        for k in own:
            up[find(k)] = find(own[0])
        keys[r[0]] = own[0]
    groups = {}
    for r in rows:
        groups.setdefault(find(keys[r[0]]), []).append(r)
    return list(groups.values())


def test_groups(spark):
    rows = seg_rows()
    df = spark.createDataFrame(rows, SEG)
    want = {}
    for g in brute_groups(rows):
        if len(g) > 1:
            doc = min((r[1] for r in g if r[1] is not None), default=None)
            want |= {r[0]: doc for r in g}
    assert {r.seg_id: r.group_doc for r in grouped_splits.related_rows(df).collect()} == want
    assert grouped_splits.related_rows(df.limit(0)).count() == 0


def test_long_chain(spark):
    """A path of many nodes is one component: it takes several rounds."""
    edges = spark.range(300).select(F.format_string("n%05d", (F.col("id") * 7919) % 301).alias("u"), F.format_string("n%05d", ((F.col("id") + 1) * 7919) % 301).alias("v"))
    got = grouped_splits.connected(edges).collect()
    assert {r.root for r in got} == {"n00000"} and len({r.node for r in got}) == 300
    assert grouped_splits.connected(edges.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [20000, 40])
def test_splits(spark, shard):
    rows = seg_rows(3000, 2)
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    got = {r.seg_id: r.split_name for r in grouped_splits.assign_splits(spark.createDataFrame(rows, SEG), shares, shard_components=shard).collect()}
    assert len(got) == len(rows)
    groups = brute_groups(rows)
    assert all(len({got[r[0]] for r in g}) == 1 for g in groups)
    rest = [g for g in groups if len(g) < 200]
    total = sum(map(len, rest))
    for name, share in shares[1:]:
        assert abs(sum(len(g) for g in groups if got[g[0][0]] == name) / len(rows) - share) < 0.05 or total < len(rows) / 2


def test_splits_of_nothing(spark):
    df = spark.createDataFrame([], SEG)
    assert grouped_splits.assign_splits(df, [("train", 1.0)]).count() == 0
    report = {r.split_name: r.n_rows for r in grouped_splits.split_report(df, [("train", 0.9), ("test", 0.1)]).collect()}
    assert report == {"train": 0, "test": 0}
    with pytest.raises(ValueError):
        grouped_splits.assign_splits(df, [])


def test_stratify_rare_first():
    components = [({0: 10, 1: 1}, 10)] + [({0: 10}, 10)] * 7 + [({0: 10, 1: 1}, 10)] * 2
    want = {0: [50.0, 50.0], 1: [1.5, 1.5]}
    split = grouped_splits.stratify(components, want, [50.0, 50.0])
    assert sorted(split.count(s) for s in (0, 1)) == [5, 5]
    assert {split[0], split[8], split[9]} == {0, 1}


LINES = [
    '{"src_lang":"en","tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80}',
    '{"src_lang":"en","tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80}',
    ' {"score": "80.0", "tgt": "die\\tkarte", "src": "THE MAP!", "tgt_lang": "DE", "src_lang": "en", "note": null} ',
    '{"src_lang":"en","tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":8e1,"src":"The  m\\u0061p"}',
    '{"src_lang":"en","tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80.5}',
    '{"src_lang":"English","tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80}',
    '{"src_lang":null,"tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80}',
    '{"tgt_lang":"de","src":"The map.","tgt":"Die Karte.","score":80}',
    '{"src":"a","tgt":null,"score":1}', '{"src":"a","tgt":"b"}', '{"src":"a","tgt":"b","score":NaN}', '{"src":"a","tgt":"b","score":"good"}',
    '{"src":"a","tgt":"b","score":true}', "null", "[1]", "", "  ", "{bad", None, '{"src":"","tgt":"","score":0}', '{"src":"\\ud800","tgt":"x","score":-0.0}',
]


def lines(spark, raws):
    return spark.createDataFrame([(i, r, "x", "y") for i, r in enumerate(raws)], "line_id bigint, raw string, canon string, line string")


def test_collapse(spark):
    df = lines(spark, LINES)
    assert {(r.first_id, r.copy_id) for r in collapse.copies(df).collect()} == {(0, 1), (0, 2), (0, 3), (6, 7)}
    got = {r.first_id: r.n_copies for r in collapse.distinct_records(df).collect()}
    assert got == {0: 4, 4: 1, 5: 1, 6: 2, 19: 1, 20: 1}
    assert collapse.copies(df.limit(0)).count() == 0 and collapse.distinct_records(df.limit(0)).count() == 0


def test_collapse_against_brute_force(spark):
    rng, raws = random.Random(4), []
    for _ in range(400):
        record = {"src": rng.choice(["a b", "A, b", "ab", "c"]), "tgt": rng.choice(["x", "X!"]), "score": rng.choice([1, 1.0, "1", 2])}
        items = list(record.items())
        rng.shuffle(items)
        raws.append(json.dumps(dict(items), separators=rng.choice([(",", ":"), (", ", ": ")])))
    first, want = {}, set()
    for i, raw in enumerate(raws):
        o = json.loads(raw)
        key = (collapse.fold(o["src"]), collapse.fold(o["tgt"]), float(o["score"]))
        if first.setdefault(key, i) != i:
            want.add((first[key], i))
    assert {(r.first_id, r.copy_id) for r in collapse.copies(lines(spark, raws)).collect()} == want


def test_signs_are_no_punctuation(spark):
    record = {"src_lang": "en", "tgt_lang": "de", "score": 1}
    raws = [json.dumps(record | {"src": s, "tgt": "t"}) for s in ("a<b", "a>b", "A < b.", "C++", "C", "c!", "5 $", "5")]
    assert {(r.first_id, r.copy_id) for r in collapse.copies(lines(spark, raws)).collect()} == {(0, 2), (4, 5)}


@pytest.mark.parametrize("value,want", [(1, 1.0), ("1e2", 100.0), (" 5 ", 5.0), ("1_0", None), ("inf", None), (math.nan, None), (True, None), (None, None), ([], None), (10**400, None)])
def test_number(value, want):
    assert collapse.number(value) == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_agreement():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(1, 40))) for _ in range(2))
        assert overlap.agreement(a, b) == pytest.approx(brute_lcs(a, b) / max(len(a), len(b)))


def test_merged():
    assert overlap.merged([(0, 5), (3, 8), (10, 12), (10, 11)]) == 10 and overlap.merged([]) == 0


WORDS = [a + b + c for a in ("ko", "za", "ve", "mi", "du") for b in ("fi", "lo", "ra", "te") for c in ("gol", "bri", "nu", "pe", "sa")]


def noisy(rng, text):
    words = text.split()
    for _ in range(rng.randint(0, 2)):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    out = " ".join(words)
    if rng.random() < 0.5:
        at = rng.randrange(len(out))
        out = out[:at] + rng.choice("xyz") + out[at + 1 :]
    return rng.choice([out, out.upper(), out.replace(" ", ",  "), out.replace("e", "é")])


def test_overlaps_against_brute_force(spark):
    rng, rows = random.Random(7), []
    base = [(" ".join(rng.choices(WORDS, k=25)), " ".join(rng.choices(WORDS, k=25))) for _ in range(60)]
    for i in range(400):
        s, t = rng.choice(base)
        if rng.random() < 0.15:
            t = rng.choice(base)[1]
        rows.append((i, rng.choice(["train", "train", "validation", "test"]), noisy(rng, s), noisy(rng, t), "o"))
    rows += [(900, "train", None, "a", "o"), (901, "test", None, "a", "o"), (902, "train", "...", "!!", None), (903, "test", "...", "!!", None), (904, "test", "???", "!!", None), (905, None, "a", "b", "o"), (906, "train", " ", " ", "o"), (907, "test", " ", " ", "o")]
    df = spark.createDataFrame(rows, "ex_id bigint, split_name string, src string, tgt string, origin string").withColumn("cls", F.lit(1)).withColumn("id", F.lit(1))
    plain = {r[0]: (overlap.normal(r[2]), overlap.normal(r[3])) for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("test", "validation") and None not in plain[a[0]] + plain[b[0]]:
                if all(overlap.agreement(x, y) >= 5 / 6 for x, y in zip(plain[a[0]], plain[b[0]])):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {(r.ex_id_a, r.ex_id_b) for r in overlap.split_overlaps(df).collect()}
    assert got <= want and len(got) >= 0.999 * len(want) and (902, 903) in got
    report = overlap.overlap_report(df).collect()
    assert sum(r.n_overlapping for r in report) == len({x for p in got for x in p if dict((r[0], r[1]) for r in rows)[x] != "train"})
    assert overlap.split_overlaps(df.limit(0)).count() == 0


def test_coverage_of_long_copies(spark):
    """A copy of a text longer than all rare passages together is covered to its last character."""
    rng = random.Random(11)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=500 + k)) for k in range(4)]
    rows = [(1, "train", long[0], long[1], "o"), (2, "test", long[0], long[1], "o"), (3, "train", long[2], long[3], "o"), (4, "test", "?" + long[2][:-3] + "...", long[3][:250].upper() + long[3][253:], "o")]
    df = spark.createDataFrame(rows, "ex_id bigint, split_name string, src string, tgt string, origin string")
    got = {r.ex_id: r for r in overlap.overlap_rows(df).collect()}
    assert got[2].exact and got[2].cover_src == got[2].cover_tgt == 1.0
    assert not got[4].exact and 0.9 < got[4].cover_src <= 1.0 and 0.9 < got[4].cover_tgt <= 1.0
    for text in ("a", "abcd", "abcdefg", "x" * 17, long[0]):
        assert overlap.merged([(b, b + len(p)) for p, b in overlap.passages(text)]) == len(text)


def edited(text, places):
    """The text with other characters at these places."""
    return "".join("#" if i in places else c for i, c in enumerate(text)).replace("#", "9")


def test_bounds_lose_no_pair():
    """All pairs of five sixths in both fields, wherever their differences are, pass the bounds."""
    rng = random.Random(5)
    text = lambda n, k=26: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[:k], k=n))
    records, trains = [], []
    for n, step in ((6, 6), (12, 6), (18, 6), (100, 10), (96, 6), (300, 6), (2000, 200), (2000, 6), (513, 6)):
        e = (text(n), text(n))
        records.append((b"e", *e))
        trains.append(tuple(edited(x, range(step // 2, n, step)) for x in e))
    for n in (1, 5, 7, 30, 64, 65, 128, 200):  # insertions here, deletions there; few letters, so many pairs
        for _ in range(12):
            e = (text(n, 3), text(n, 4))
            records.append((b"e", *e))
            cut = [[c for c in x if rng.random() > 0.08] for x in e]
            trains.append(tuple("".join(c + rng.choice("ab") * (rng.random() < 0.06) for c in x) or "a" for x in cut))
    trains += [("\U0010ffff日本", "é"), records[0][1:]]
    shard = overlap.Shard([(*r, [], []) for r in records], 5 / 6)
    want = {}
    for i, t in enumerate(trains):
        for j, (_, *e) in enumerate(records):
            same = [overlap.agreement(x, y) for x, y in zip(e, t)]
            if min(same) >= 5 / 6:
                want[i, j] = tuple(same)
    every = np.divmod(np.arange(len(trains) * len(records)), len(records))
    got = {(i, j): (a, b) for i, j, a, b in shard.partners(trains, every)}
    assert got == want and {i for i, _ in got} >= set(range(9)) | {len(trains) - 1}


def test_pairs_without_a_common_passage(spark):
    rng = random.Random(6)
    rows = []
    for k, (n, step) in enumerate(((6, 6), (12, 6), (18, 6), (100, 10))):
        e = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for _ in range(2)]
        rows += [(2 * k, "test", *e, "o"), (2 * k + 1, "train", *(edited(x, range(step // 2, n, step)) for x in e), "o")]
    df = spark.createDataFrame(rows, "ex_id bigint, split_name string, src string, tgt string, origin string")
    assert {(r.ex_id_a, r.ex_id_b) for r in overlap.split_overlaps(df).collect()} == {(2 * k, 2 * k + 1) for k in range(4)}


def test_regular_differences(spark):
    """A difference at every sixth character, or one there and one three characters on: no window
    of some length stays whole, and yet five sixths agree."""
    rng = random.Random(9)
    rows = []
    for n in (42, 60, 150, 300, 600, 900):
        e = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for _ in range(2)]
        exchanged = [edited(x, range(5, n, 6)) for x in e]
        moved = ["".join(("" if i % 6 == 2 else c) + "9" * (i % 6 == 5) for i, c in enumerate(x)) for x in e]
        for t in (exchanged, moved):
            assert all(overlap.agreement(x, y) >= 5 / 6 for x, y in zip(e, t))
            rows.append((len(rows), "train", *t, "o"))
        rows.append((len(rows), "validation", *e, "o"))
    df = spark.createDataFrame(rows, "ex_id bigint, split_name string, src string, tgt string, origin string")
    assert {(r.ex_id_a, r.ex_id_b) for r in overlap.split_overlaps(df).collect()} == {(k, k - k % 3 + 2) for k in range(len(rows)) if k % 3 < 2}


def test_boxes_and_tiles_lose_no_pair():
    """What bounds on boxes and tiles leave are the pairs that bounds on each pair leave."""
    rng = random.Random(12)
    some = lambda k, n: "".join(rng.choices("abcdefgh"[:k], k=n))
    records = [(b"e", some(rng.choice([2, 3, 8]), rng.randint(1, 30)), some(3, rng.randint(1, 600 if k % 40 == 0 else 20))) for k in range(400)]
    trains = [r[1:] if rng.random() < 0.4 else (some(3, rng.randint(1, 30)), some(3, rng.randint(1, 20))) for r in records]
    shard = overlap.Shard(records, 5 / 6)
    every = np.divmod(np.arange(len(trains) * len(records)), len(records))
    want = shard.partners(trains, every)
    assert sorted(shard.partners(trains)) == sorted(want) and len(want) > 100
    assert overlap.Shard([], 5 / 6).partners(trains) == shard.partners([]) == []


def test_recall_against_brute_force(spark):
    """Differences at random places, up to a full sixth, in both fields, at four lengths."""
    rng, rows, want = random.Random(8), [], set()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (50, 100, 300, 1000):
        for share in (0.06, 0.1, 0.13, 1 / 6):
            for _ in range(100):
                a = len(rows)
                e = ["".join(rng.choices(letters, k=n)) for _ in range(2)]
                t = [edited(x, set(rng.sample(range(n), int(n * share)))) for x in e]
                rows += [(a, "test", *e, "o"), (a + 1, "train", *t, "o")]
                want.add((a, a + 1))
    df = spark.createDataFrame(rows, "ex_id bigint, split_name string, src string, tgt string, origin string")
    got = {(r.ex_id_a, r.ex_id_b) for r in overlap.split_overlaps(df).collect()}
    assert got <= want
    for n, part in zip((50, 100, 300, 1000), range(0, len(rows), 800)):
        own = {p for p in want if part <= p[0] < part + 800}
        assert len(got & own) >= 0.99 * len(own), n
        full = {p for p in own if p[0] >= part + 600}
        assert len(got & full) >= 0.98 * len(full), n


def test_shards_and_blocks_do_not_change_the_links(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/split_examples.parquet")
    rows = overlap._normalised(df)
    links = lambda **k: {(bytes(r.train), bytes(r.eval)) for r in overlap.class_links(rows, cover=False, **k).select("train", "eval").collect()}
    one = links()
    assert one and links(shard_records=37, block_records=50) == one
    # brute force: the bounds over all pairs
    texts = [(bytes(r.cls), r.ns, r.nt, r.is_train) for r in rows.dropDuplicates(["cls", "is_train"]).collect()]
    trains, evals = [t for t in texts if t[3]], [(*t[:3], [], []) for t in texts if not t[3]]
    shard = overlap.Shard(evals, 5 / 6)
    every = np.divmod(np.arange(len(trains) * len(evals)), len(evals))
    assert one == {(trains[i][0], evals[j][0]) for i, j, _, _ in shard.partners([t[1:3] for t in trains], every)}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 12])
def test_window_keys(size):
    rng = random.Random(size)
    points = np.array([rng.choice([1, 2, 0x10FFFF]) for _ in range(3000)])
    keys = overlap._window_keys(points, size)[: len(points) - size + 1]
    windows = [tuple(points[i : i + size]) for i in range(len(keys))]
    assert len(set(zip(windows, keys.tolist()))) == len(set(windows)) == len(set(keys.tolist()))


def test_training_side_picks_what_the_evaluation_side_may_have():
    rng = random.Random(3)
    for n in (1, 2, 3, 6, 15, 16, 39, 40, 55, 250, 399, 400, 900):
        text = "".join(rng.choices("abcdef", k=n))
        own = {(b, k) for _, b, k in zip(*overlap.picks([text], 1))}
        for m in {n, max(1, -(-n * 5 // 6)), n * 6 // 5}:
            other = (text + "z" * m)[:m]
            keys = set(overlap.picks([other], 1, training=True)[2].tolist())
            size = min(int(overlap.picked_size(np.array(n))), n)
            assert {k for b, k in own if b + size <= min(n, m)} <= keys
            assert not n > 5 or own
