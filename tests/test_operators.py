import json

import pytest
from pyspark.sql import functions as F

from segloom import cli
from segloom.operators import pairs, sampling, truncate, validate
from segloom.operators.normalize import examples, normalize_languages
from segloom.scoring.architectures import architecture
from segloom.scoring.base import ScoreResult, ScorerConfig, retried
from segloom.scoring.offline import HashScorer, LengthRatio
from segloom.scoring.predict import map_rows, predict, score_pairs, score_segments
from segloom.sources.jsonl import load_examples, parse_lines, read_examples, read_lines
from segloom.sources.sinks import write_ordered, write_unordered
from segloom.streaming.predict import score_stream
from segloom.training import optimize
from segloom.training.program import Program

SEG = "seg_id bigint, src_lang string, tgt_lang string, src string, tgt string, score double, date string"


def segs(spark, rows):
    return spark.createDataFrame(rows, SEG)


@pytest.fixture
def two_sources(spark):
    return segs(spark, [(1, "en", "de", "a", "x", 1.0, ""), (2, "English", "German", "a", "y", 2.0, ""), (3, "EN", "ger", "a", "x", 1.0, ""), (4, "en", "de", "b", "x", 1.0, ""), (5, "en", "de", "b", "y", 1.0, ""), (6, "en", "de", "c", "z", 1.0, "")])


def test_pairs(spark, two_sources):
    rows = examples(two_sources, ["seg_id"])
    assert {(r.id1, r.id2) for r in pairs.all_pairs(rows).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}
    for make in (pairs.k_pairs, pairs.sequential_pairs):
        got = make(rows, 2).collect()
        assert len(got) == 3 and len({(r.id1, r.id2) for r in got}) == 3
        assert all(r.id1 < r.id2 for r in got)
    assert len(pairs.limit_pairs(pairs.k_pairs(rows, 8), 1).collect()) == 1
    with pytest.raises(ValueError):
        pairs.k_pairs(rows, 0)
    assert pairs.k_pairs(rows.limit(0), 2).count() == 0


def test_k_pairs_of_a_hot_source(spark):
    """Many candidates of one source: k different pairs, and no pair but those is made."""
    rows = spark.range(3000).select(F.col("id").alias("seg_id"), F.lit("English").alias("src_lang"), F.lit("German").alias("tgt_lang"), F.lit("s").alias("src"), F.col("id").cast("string").alias("tgt"), F.col("id").cast("double").alias("score"))
    got = pairs.k_pairs(rows, 50).collect()
    assert len({(r.id1, r.id2) for r in got}) == 50 and all(r.id1 < r.id2 for r in got)
    every = pairs.k_pairs(rows.where("seg_id < 20"), 1000).collect()
    assert len({(r.id1, r.id2) for r in every}) == 190


def test_draw_of_a_large_source(spark):
    """Two hashes of 60 bits: of a million candidates the late ones are drawn as well, and the
    numbers of the pairs stay different and in range."""
    groups = spark.range(200).select(F.lit("English").alias("src_lang"), F.lit("German").alias("tgt_lang"), F.col("id").cast("string").alias("src"), F.lit(1_000_000).cast("bigint").alias("n_candidates"))
    got = pairs._drawn(groups, 8, 42).collect()
    assert len({(r.src, r.i, r.j) for r in got}) == 1600 and all(0 <= r.i < r.j < 1_000_000 for r in got)
    late = sum(r.j >= 500_000 for r in got) / len(got)
    assert 0.65 < late < 0.85  # three quarters of all pairs


def test_gathered_and_numbered_sources_draw_alike(spark):
    rows = spark.range(300).select(F.col("id").alias("seg_id"), F.lit("English").alias("src_lang"), F.lit("German").alias("tgt_lang"), (F.col("id") % 7).cast("string").alias("src"), F.col("id").cast("string").alias("tgt"), F.col("id").cast("double").alias("score"))
    one, two = (sorted(tuple(r) for r in pairs.k_pairs(rows, 5, gathered=n).collect()) for n in (1000, 42))
    assert one == two and len(one) == 35


def test_sequential_draw_refuses_too_many(spark, monkeypatch, two_sources):
    monkeypatch.setattr(pairs, "MOST_SEQUENTIAL", 3)
    with pytest.raises(ValueError, match="too many"):
        pairs.sequential_pairs(examples(two_sources, ["seg_id"]), 2)


def test_tables_are_deleted(spark, two_sources):
    import os

    from segloom import util

    df = util.table(two_sources, "t")
    path = util.run_dir(spark).removeprefix("file://")
    assert df.count() == 6 and os.listdir(path)
    util.clear_tables()
    assert not os.path.exists(path)
    assert util.table(two_sources, "t").count() == 6


def test_numbered(spark):
    rows = spark.range(500).select(F.col("id").alias("seg_id"), F.lit("a").alias("src_lang"), F.lit("b").alias("tgt_lang"), (F.col("id") % 3).cast("string").alias("src"))
    got = pairs.numbered(rows).collect()
    for r in got:
        assert r.idx == r.seg_id // 3 and r.n_candidates == len(range(int(r.src), 500, 3))


def test_order_and_limit(spark):
    rows = spark.range(100).withColumnRenamed("id", "seg_id")
    some = [r.seg_id for r in sampling.shuffled(rows, "seg_id", limit=5).collect()]
    assert some == [r.seg_id for r in sampling.shuffled(rows.repartition(7), "seg_id").collect()][:5]
    with pytest.raises(ValueError):
        sampling.shuffled(rows, "seg_id", limit=-1)


def test_validation(spark, two_sources):
    with pytest.raises(ValueError, match="Missing required fields: score"):
        validate.require_fields(two_sources.drop("score"))
    bad = two_sources.withColumn("score", F.lit("good"))
    with pytest.raises(Exception, match="Invalid score value"):
        validate.require_scores(bad).collect()
    good, rest = validate.split_valid(bad.withColumn("score", F.when(F.col("seg_id") < 3, "7").otherwise("x")))
    assert good.count() == 2 and rest.count() == 4


def test_unknown_labels_stay(spark):
    got = normalize_languages(segs(spark, [(1, "xx", None, "a", "b", 1.0, "")])).first()
    assert (got.src_lang, got.tgt_lang) == ("xx", None)


def test_languages_of_a_table(spark):
    """A table of languages takes the place of the list; a language may lack a two-letter code."""
    names = spark.createDataFrame([("sv", "swe", "swe", "Swedish"), (None, "haw", "haw", "Hawaiian")], "lang_code string, alpha3 string, alpha3_b string, lang_name string")
    rows = segs(spark, [(1, "SV-se", " haw", "a", "b", 1.0, ""), (2, "swedish", "de", "a", "b", 1.0, "")])
    got = sorted((r.seg_id, r.src_lang, r.tgt_lang) for r in normalize_languages(rows, names=names).collect())
    assert got == [(1, "Swedish", "Hawaiian"), (2, "Swedish", "de")]
    many = spark.range(20_001).selectExpr("string(id) lang_code", "'x' alpha3", "'x' alpha3_b", "'x' lang_name")
    with pytest.raises(ValueError, match="at most"):
        normalize_languages(rows, names=many)


HOSTILE = ["", "   ", "null", "[1,2]", '"text"', "{bad", '{"src":"a","tgt":"b","src_lang":"en","tgt_lang":"de","score":1,"score":"80"}', '{"src":"007","tgt":null,"score":NaN}', "{'src':'a','score':1}", '{"src":"a","tgt":"b","src_lang":"en","tgt_lang":"de","score":true,"date":"2024-01-01"}']


def test_hostile_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(HOSTILE))
    got = parse_lines(read_lines(spark, str(path))).orderBy("ordinal").collect()
    assert [r.kind for r in got] == ["blank", "blank", "no object", "no object", "no object", "broken", "ok", "broken", "broken", "ok"]
    assert [r.score for r in got if r.kind == "ok"] == [80.0, 1.0]
    good, bad = read_examples(spark, str(path))
    assert good.count() == 2 and bad.count() == 6


def test_ordered_roundtrip(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit('q"“ \\'), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("gap"))
    for one in (False, True):
        out = str(tmp_path / f"o{one}")
        write_ordered(rows.select("id", F.col("id").alias("n"), "text", "gap"), out, ["id"], one_file=one)
        lines = [r.value for r in spark.read.text(out).withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()]
        assert sorted(json.loads(x)["n"] for x in lines) == list(range(200))
        if one:
            assert [json.loads(x)["n"] for x in lines] == list(range(200))
            assert json.loads(lines[3]) == {"n": 3, "text": 'q"“ \\3', "gap": None}
    write_unordered(rows, str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).count() == 200


class Worker:
    """A scorer behind the Python boundary; fails on some texts."""

    def score_batch(self, prompts, sample):
        if any(p["tgt"] == "y" for p in prompts) and len(prompts) > 1:
            raise RuntimeError("bad batch")
        if prompts[0]["tgt"] == "y":
            raise RuntimeError("bad row")
        return [ScoreResult(50 + sample) for _ in prompts]


def test_scoring(spark, two_sources):
    rows = examples(two_sources, ["seg_id", "date"])
    out = {r.seg_id: r for r in score_segments(rows, "DA", Worker()).collect()}
    assert out[1].score == 50 and out[2].score == 0 and "bad row" in out[2].error and out[1].error is None
    assert len(out) == 6 and out[1].date == ""
    ten = {r.seg_id: r.score for r in score_segments(rows, "MR7MEAN", Worker()).collect()}
    assert ten[1] == 54 and ten[2] == 0
    by_worker = {r.seg_id: r.score for r in score_segments(rows, "MR7RRWA", PlainHash()).collect()}
    by_column = {r.seg_id: r.score for r in score_segments(rows, "MR7RRWA", HashScorer()).collect()}
    assert by_worker == by_column
    with pytest.raises(ValueError, match="Unknown architecture"):
        architecture("X")


class PlainHash:
    def score_batch(self, prompts, sample):
        return HashScorer().score_batch(prompts, sample)


def test_pairwise_scores(spark, two_sources):
    some = pairs.all_pairs(examples(two_sources, ["seg_id"]))
    a = {(r.id1, r.id2): (r.tgt1_pred, r.tgt2_pred) for r in score_pairs(some, "DA", PlainHash()).collect()}
    b = {(r.id1, r.id2): (r.tgt1_pred, r.tgt2_pred) for r in score_pairs(some, "DA", HashScorer()).collect()}
    assert a == b and len(a) == 4


def test_offline_scorers_agree(spark, two_sources):
    inputs = {c: F.col(c) for c in ("src_lang", "tgt_lang", "src", "tgt")}
    for scorer in (HashScorer(), LengthRatio()):
        rows = two_sources.select("*", scorer.column(inputs).alias("p")).collect()
        assert [r.p for r in rows] == [x.score for x in scorer.score_batch([r.asDict() for r in rows], 0)]


def test_predict_overrides_score(spark, two_sources):
    out = predict(two_sources, "DA", LengthRatio(), 1)
    assert [r.score for r in out.collect()] == [100] * 6 and "date" in out.columns


def test_retry():
    calls, waits = [], []

    def slow():
        calls.append(1)
        raise TimeoutError

    assert retried(slow, sleep=waits.append).score == 0 and len(calls) == 5 and len(waits) == 4
    assert all(1 <= w <= 12 for w in waits)
    assert "ValueError" in retried(lambda: int("x")).error
    assert ScorerConfig(sampling={"max_tokens": 5}).request_options() == {"max_tokens": 5}


@pytest.fixture
def endpoint():
    """A chat endpoint that notes its requests and how many run at a time."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            super().setup()
            with lock:
                server.connections += 1

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                server.calls.append(body)
                server.now += 1
                server.most = max(server.most, server.now)
            time.sleep(server.wait)
            bad = "FAIL" in body["messages"][0]["content"]
            score = 71 + body.get("seed", 0)
            answer = json.dumps({"choices": [{"message": {"content": "no" if bad else f'Sure: {{"score": {score}, "accuracy": "8"}}'}}]}).encode()
            with lock:
                server.now -= 1
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    lock = threading.Lock()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.calls, server.now, server.most, server.connections, server.wait = [], 0, 0, 0, 0.0
    server.base = f"http://127.0.0.1:{server.server_port}/v1"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_http_scorer(endpoint):
    from segloom.scoring.http import HttpScorer

    scorer = HttpScorer(architecture("MR7").signature, ScorerConfig("m", endpoint.base))
    a, b = scorer.score_batch([{"src": "a", "tgt": "b"}, {"src": "FAIL", "tgt": "b"}], 0)
    assert a.score == 71 and a.subscores == {"accuracy": 8} and b.score == 0 and b.error
    for _ in range(10):
        scorer.score_batch([{"src": "a", "tgt": "b"}], 0)
    assert len(endpoint.calls) == 12 and endpoint.connections <= 3  # connections are kept
    assert scorer.score_batch([], 0) == []


def test_samples_at_the_endpoint(spark, two_sources, endpoint):
    """One plain request for each prompt, the others with reasoning, at the sampling
    temperature, each with its seed; a program's config replaces their number."""
    from segloom.scoring.http import HttpScorer

    rows = examples(two_sources, ["seg_id"])
    prompts = 5  # two rows are the same prompt
    scorer = HttpScorer(architecture("MR7RRWA").signature, ScorerConfig("m", endpoint.base, sampling={"temperature": 0.0, "top_p": 0.9}))
    out = score_segments(rows, "MR7RRWA", scorer).collect()
    assert len(out) == 6 and len(endpoint.calls) == 10 * prompts
    plain = [c for c in endpoint.calls if "seed" not in c]
    assert len(plain) == prompts and all(c["temperature"] == 0.0 and "reasoning" not in c["messages"][0]["content"] for c in plain)
    rest = [c for c in endpoint.calls if "seed" in c]
    assert sorted({c["seed"] for c in rest}) == list(range(1, 10))
    assert all(c["temperature"] == 0.5 and c["top_p"] == 0.9 and "reasoning" in c["messages"][0]["content"] for c in rest)
    endpoint.calls.clear()
    program = Program.new("MR7RRWA")
    program.config |= {"num_samples": 3, "sampling_temperature": 0.9, "method": "mean"}
    scorer = HttpScorer(architecture("MR7RRWA").signature, ScorerConfig("m", endpoint.base), program.state())
    out = score_segments(rows, "MR7RRWA", scorer, config=program.config).collect()
    assert {r.score for r in out} == {72} and len(endpoint.calls) == 3 * prompts
    assert {c["temperature"] for c in endpoint.calls if "seed" in c} == {0.9}
    with pytest.raises(ValueError, match="num_samples"):
        architecture("MR7MEAN").configured({"num_samples": 0})
    with pytest.raises(ValueError, match="Unknown aggregation"):
        architecture("MR7MEAN").configured({"method": "median"})
    assert architecture("DA").configured({"num_samples": 3}).num_samples == 1


@pytest.mark.parametrize("cap", [2, 8])
def test_requests_of_a_job_are_limited(spark, endpoint, cap):
    """Four workers together stay under the limit."""
    from segloom.scoring.http import HttpScorer

    endpoint.wait = 0.02
    rows = segs(spark, [(i, "en", "de", f"s{i}", "t", 1.0, "") for i in range(60)]).repartition(8)
    score_segments(rows, "DA", HttpScorer(architecture("DA").signature, ScorerConfig("m", endpoint.base, max_concurrent=cap))).collect()
    assert len(endpoint.calls) == 60 and 1 < endpoint.most <= cap


def test_answers_are_kept_between_runs(spark, two_sources, endpoint, tmp_path):
    from segloom.scoring.http import HttpScorer

    rows, cache = examples(two_sources, ["seg_id"]), str(tmp_path / "answers")
    make = lambda model: HttpScorer(architecture("MR7").signature, ScorerConfig(model, endpoint.base))
    bad = segs(spark, [(9, "en", "de", "FAIL", "t", 1.0, "")])
    for _ in range(2):
        out = score_segments(rows, "MR7", make("m"), keep_subscores=True, cache=cache).collect()
        assert len(out) == 6 and {r.score for r in out} == {71} and {r.accuracy_score for r in out} == {8}
        score_segments(bad, "MR7", make("m"), cache=cache).collect()
    assert len(endpoint.calls) == 5 + 2  # failures aren't kept
    score_segments(rows, "MR7", make("other"), cache=cache).collect()
    assert len(endpoint.calls) == 12


def test_map_rows(spark):
    out = map_rows(spark.range(5), lambda r: [{"id": r["id"]}] * (r["id"] % 2), "id bigint")
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_truncation(spark):
    import os

    rows = spark.createDataFrame([(1, "one two three four", None)], "id int, src string, tgt string")
    assert truncate.truncate_words(rows, 2).first().src == "one two"
    assert truncate.truncate_words(rows.drop("tgt"), 2, ("src", "tgt")).first().src == "one two"
    path = "/opt/tokenizers/word_bpe_49k.json"
    if os.path.exists(path):
        got = truncate.truncate_tokens(rows, 3, path).first()
        assert got.src.startswith("one two") and "four" not in got.src and got.tgt is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"src":"abc","tgt":"abcd","src_lang":"en","tgt_lang":"de","x":1}\nnull\n\n')
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), "DA", LengthRatio())
    score_stream(spark, *args, rejects=str(tmp_path / "bad")).awaitTermination()
    (tmp_path / "in" / "b.jsonl").write_text('{"src":"a","tgt":"a","src_lang":"en","tgt_lang":"de"}\n')
    score_stream(spark, *args).awaitTermination()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(g["score"] for g in got) == [75, 100]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["null"]


def test_program_roundtrip(tmp_path):
    program = Program.new("MR7RRWA")
    program.config["num_samples"] = 3
    program.save(str(tmp_path / "p.json"))
    assert Program.load(str(tmp_path / "p.json")).state() == program.state()
    assert Program.load(str(tmp_path / "p.json"), "DA").config["num_samples"] == 3


@pytest.mark.parametrize("objective,name", [("tRMSE", "MIPROv2"), ("PA", "SIMBA")])
def test_search(spark, two_sources, objective, name):
    config = optimize.TrainingConfig(objective)
    train, none = optimize.load_sets(examples(two_sources, ["seg_id"]), None, config)
    programs = optimize.propose(Program.new("DA"), optimize.demonstrations(train, objective, 2), 4)
    best, scores = optimize.OPTIMIZERS[name](programs, train, none, lambda p, i: HashScorer(f"{p}").column(i), config)
    top = max(scores.collect(), key=lambda r: (r.objective, -r.program))
    assert best in {r.program for r in scores.collect()} and (name == "SIMBA" or best == top.program)
    with pytest.raises(ValueError, match="Unknown objective"):
        optimize.load_sets(train, None, optimize.TrainingConfig("x"))


def test_trials_learn_about_parts(spark):
    """Trials on minibatches find the best of a space by its parts, without trying all of it."""
    import random

    rows = spark.range(300).select(F.lit("en").alias("src_lang"), F.lit("de").alias("tgt_lang"), F.col("id").cast("string").alias("src"), F.lit("t").alias("tgt"), F.lit(50.0).alias("score"))
    base = Program.new("DA")
    demos = [{"src": str(i)} for i in range(20)]
    programs = optimize.propose(base, demos, 36, instructions=["better"])
    assert len(programs) == 36 and programs[0] is base and len({p.choice for p in programs}) == 36
    tried = []

    def predict(p, i):
        tried.append(p)
        return F.lit(90 - 30 * (programs[p].choice[0] == 5) - 5 * programs[p].choice[1])

    best, scores = optimize.search_joint(programs, rows, None, predict, optimize.TrainingConfig("tRMSE"), minibatch=20, trials=16)
    assert programs[best].choice[0] == 5 and scores.count() == 3 and len(set(tried)) == 16
    seen = {p: float(programs[p].choice[0] == 2) for p in range(0, 36, 2)}
    assert programs[optimize.next_trials(programs, seen, 3, random.Random(1))[0]].choice[0] == 2


def test_ascent_makes_programs(spark, two_sources):
    """The worst example becomes a demonstration; scores that are too high become a rule."""
    programs = [Program.new("DA")]
    train = examples(two_sources, ["seg_id"])
    off = lambda p, i: F.lit(60) - F.lit(50 * bool(programs[p].demos)) if p < len(programs) else F.lit(60)
    programs.append(Program.new("DA"))
    best, scores = optimize.search_ascent(programs, train, None, off, optimize.TrainingConfig("tRMSE"), steps=2)
    assert len(programs) > 2 and programs[best].demos and {r.program for r in scores.collect()} == {0, best}
    assert any(optimize.RULES[0] in (p.instruction or "") for p in programs)


def test_instructions_from_an_endpoint(endpoint, capsys):
    from segloom.scoring.http import HttpScorer

    scorer = HttpScorer(architecture("DA").signature, ScorerConfig("m", endpoint.base))
    assert len(optimize.ask_for_instructions(scorer.complete, Program.new("DA"), [{"src": "a"}], 2)) == 2
    broken = lambda text, sample: 1 / 0
    assert optimize.ask_for_instructions(broken, Program.new("DA"), [], 2) == [] and "no instruction" in capsys.readouterr().err


def test_labelled_files_must_be_right(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    good = {"src_lang": "en", "tgt_lang": "de", "src": "x", "tgt": "y", "score": 5}
    for row, message in (({k: v for k, v in good.items() if k != "score"}, "Missing required fields: score"), ({"src": "x"}, "Missing required fields: score, src_lang, tgt, tgt_lang"), (good | {"score": "not-a-number"}, "Invalid score value: 'not-a-number'")):
        path.write_text(json.dumps(row) + "\n")
        with pytest.raises(ValueError, match=message):
            load_examples(spark, str(path))
        with pytest.raises(SystemExit, match=message):
            cli.main(["--scorer", "hash", "train-da", "--training-data", str(path), "--objective", "PA", "--output", str(tmp_path / "p.json")])
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"tgt": None}) + "\n")
    with pytest.raises(ValueError, match="Missing required fields: tgt"):
        load_examples(spark, str(path))
    path.write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"score": "7"}) + "\n")
    assert sorted(r.score for r in load_examples(spark, str(path)).collect()) == [5.0, 7.0]


def test_command_line_session(spark, tmp_path, capsys, endpoint, monkeypatch):
    """No master of its own, data alone on standard output, rejects with reasons, a program's
    config, kept answers, and training that asks for all samples."""
    import os

    monkeypatch.setenv("SEGLOOM_API_KEY", "")
    monkeypatch.setattr("segloom.util.local_session", None)
    path = tmp_path / "in.jsonl"
    path.write_text('{"src_lang":"en","tgt_lang":"de","src":"abc","tgt":"abd"}\nnull\n{"src_lang":"en","src":"x"}\n{bad\n\n')
    program = Program.new("MR7MEAN")
    program.config["num_samples"] = 3
    program.save(str(tmp_path / "p.json"))
    http = ["--model", "m", "--api-base", endpoint.base, "--api-key", "k", "--response-cache", str(tmp_path / "cache")]
    for _ in range(2):
        cli.main([*http, "predict-da", "--architecture", "MR7MEAN", "--trained-model", str(tmp_path / "p.json"), "--rejects", str(tmp_path / "rejects"), str(path)])
        out = capsys.readouterr()
        assert [json.loads(x)["score"] for x in out.out.splitlines()] == [72]
        assert "1 lines rejected: broken" in out.err and "1 lines rejected: no object" in out.err and "1 lines rejected: no tgt" in out.err
        assert "1 lines scored, 0 of them with an error" in out.err
    assert len(endpoint.calls) == 3
    assert sorted(json.loads(r.value)["reason"] for r in spark.read.text(str(tmp_path / "rejects")).collect()) == ["broken", "no object", "no tgt"]
    endpoint.calls.clear()
    data = tmp_path / "train.jsonl"
    data.write_text("".join(json.dumps({"src_lang": "en", "tgt_lang": "de", "src": f"s{i}", "tgt": f"t{i}", "score": i}) + "\n" for i in range(4)))
    cli.main([*http[:4], "train-da", "--training-data", str(data), "--architecture", "MR7MEAN", "--initial-program", str(tmp_path / "p.json"), "--optimizer-params", '{"num_candidates": 2}', "--optimizer-compile-params", '{"seed": 5, "x": 1}', "--output", str(tmp_path / "q.json")])
    assert len(endpoint.calls) == 4 * 2 * 3 and "no parameter x" in capsys.readouterr().err
    assert Program.load(str(tmp_path / "q.json")).config["num_samples"] == 3
    os.environ.pop("SEGLOOM_API_KEY", None)


def test_offline_training_honours_scorer_and_architecture(spark, tmp_path, capsys):
    data = tmp_path / "train.jsonl"
    data.write_text("".join(json.dumps({"src_lang": "en", "tgt_lang": "de", "src": "abcd"[: i + 1], "tgt": "abcd", "score": 25 * (i + 1)}) + "\n" for i in range(4)))
    cli.main(["--scorer", "length", "train-da", "--training-data", str(data), "--optimizer-params", '{"num_candidates": 2}', "--output", str(tmp_path / "p.json")])
    assert "program 0: 1.0 over 4" in capsys.readouterr().err  # lengths are exactly right here
    err = {}
    for arch in ("MR7", "MR7MEAN"):
        cli.main(["--scorer", "hash", "train-da", "--training-data", str(data), "--architecture", arch, "--output", str(tmp_path / "p.json")])
        err[arch] = capsys.readouterr().err
    assert err["MR7"] != err["MR7MEAN"]
    with pytest.raises(ValueError, match="negative"):
        optimize.search_options("SIMBA", {"max_steps": -1}, {})


@pytest.mark.parametrize("method", ["mean", "RRWA"])
def test_combine_is_the_column(spark, method):
    from segloom.functions.aggregates import aggregate_scores, combine

    cases = [[], [None], [50], [100, 0], [-5, 130, None], [3, 7, 7, 90, 12]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<int>")
    got = {r.i: r.x for r in df.select("i", aggregate_scores(method, F.col("s")).alias("x")).collect()}
    assert [combine(method, c) for c in cases] == [got[i] for i in range(len(cases))]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("segloom.util.local_session", lambda *a, **k: spark)
    path = tmp_path / "in.jsonl"
    path.write_text('{"z":1,"src_lang":"en","tgt_lang":"de","src":"abc","tgt":"abé","score":"5"}\nnull\n{"src_lang":"en","tgt_lang":"de","src":"a","tgt":"bb"}\n')
    cli.main(["--scorer", "length", "predict-da", str(path)])
    lines = capsys.readouterr().out.splitlines()
    assert lines == ['{"z":1,"src_lang":"en","tgt_lang":"de","src":"abc","tgt":"abé","score":100}', '{"src_lang":"en","tgt_lang":"de","src":"a","tgt":"bb","score":50}']
    data = tmp_path / "train.jsonl"
    data.write_text("".join(json.dumps({"src_lang": "en", "tgt_lang": "de", "src": f"s{i // 3}", "tgt": f"t{i}", "score": i}) + "\n" for i in range(12)))
    for objective in ("tRMSE", "PA"):
        cli.main(["--scorer", "hash", "train-da", "--training-data", str(data), "--objective", objective, "--output", str(tmp_path / "p.json")])
        assert Program.load(str(tmp_path / "p.json")).architecture == "DA"
    args = cli.parser().parse_args(["train-da", "--training-data", "x", "--output", "y"])
    assert (args.max_tokens, args.max_concurrent, args.pairwise_k_per_source, args.pairwise_epsilon) == (2048, 100, 8, 0.0)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train-da", "--training-data", "x", "--output", "y", "--pairwise-k-per-source", "0"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--sampling-params", "{bad", "predict-da"])


def test_joint_search_scores_every_candidate(spark):
    """Three of six candidates look better on a sample, one of the others is best on all data."""
    rows = spark.range(1000).select(F.lit("en").alias("src_lang"), F.lit("de").alias("tgt_lang"), F.col("id").cast("string").alias("src"), F.lit("t").alias("tgt"), F.lit(50.0).alias("score"))
    sample = {r.src for r in rows.orderBy(sampling.order_key(42, *rows.columns)).limit(200).collect()}
    off = lambda p, i: F.when(i["src"].isin(*sample), F.lit(50 + p)).otherwise(F.lit(80 - p))
    best, scores = optimize.search_joint([Program.new("DA")] * 6, rows, None, off, optimize.TrainingConfig("tRMSE"))
    assert best == 5 and sorted(r.program for r in scores.collect()) == list(range(6))
