"""Search for a better scoring program; candidates are evaluated on the cluster."""

from __future__ import annotations

import json
import math
import random
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.metrics import metric_for
from segloom.operators.pairs import k_pairs, limit_pairs
from segloom.operators.sampling import order_key, shuffled
from segloom.schema import INPUT_COLS, PAIR_INPUT_COLS
from segloom.training.program import Program
from segloom.util import parallelism, table


@dataclass
class TrainingConfig:
    objective: str = "tRMSE"
    train_max_examples: int | None = None
    validation_max_examples: int | None = None
    pairs_per_source: int = 8
    epsilon: float = 0.0
    optimizer: dict[str, Any] = field(default_factory=dict)


#: Makes the predicted score of a candidate program: (program number, inputs) -> column.
CandidateColumn = Callable[[int, dict[str, Column]], Column]

#: Rules that a program gets if its scores are too high or too low.
RULES = ("Scores tend to be too high: look for what is wrong before you decide.", "Scores tend to be too low: don't take away points for matters of taste.")
#: Rewordings of an instruction that the search proposes.
HINTS = ["", "Look at the numbers and names first.", "Judge meaning before style.", "Be strict about omissions.", "A fluent text with a wrong meaning is bad."]


def load_sets(train: DataFrame, validation: DataFrame | None, config: TrainingConfig) -> tuple[DataFrame, DataFrame | None]:
    """Examples or pairs by objective, shuffled by seed and limited."""
    if config.objective not in ("tRMSE", "PA"):
        raise ValueError(f"Unknown objective: {config.objective}")

    def one(df, limit):
        if df is None:
            return None
        if config.objective == "tRMSE":
            return shuffled(df, "seg_id", limit=limit) if limit is not None else df
        pairs = k_pairs(df, config.pairs_per_source)
        return limit_pairs(pairs, limit) if limit is not None else pairs

    return one(train, config.train_max_examples), one(validation, config.validation_max_examples)


def evaluate(data: DataFrame, programs: list[int], predict: CandidateColumn, objective: str, epsilon: float = 0.0) -> DataFrame:
    """(program, n, objective) of each candidate over the data, in one pass over it.

    The candidates are columns of one projection, not copies of the rows: the data is read
    once and each task sends one row of sums for all of them.
    """
    metric = metric_for(objective, epsilon)
    terms = []
    for p in programs:
        if objective == "tRMSE":
            value = metric(F.col("score"), predict(p, {c: F.col(c) for c in INPUT_COLS}).cast("double"))
        else:
            sides = [predict(p, {"src_lang": F.col("src_lang"), "tgt_lang": F.col("tgt_lang"), "src": F.col("src"), "tgt": F.col(t)}).cast("double") for t in ("tgt1", "tgt2")]
            value = metric(F.col("tgt1_score"), F.col("tgt2_score"), *sides)
        terms.append(F.struct(F.lit(p).alias("program"), F.count(value).alias("n"), F.round(F.avg(value), 6).alias("objective")))
    return data.agg(F.array(*terms).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def propose(base: Program, demos: list[dict[str, Any]], count: int, seed: int = 42, per_program: int = 4, instructions: list[str] | None = None) -> list[Program]:
    """Programs with other instructions and demonstrations; the first is the base itself.

    The space is every instruction (the base's, its rewordings, and those given) with every set
    of demonstrations; a search knows a program's place in it by `choice`.
    """
    rng, out = random.Random(seed), [base]
    texts = [f"{base.instruction} {hint}".strip() for hint in HINTS] + list(instructions or ())
    sets = [list(base.demos)] + [rng.sample(demos, min(len(demos), rng.randint(1, max(1, per_program)))) if per_program else [] for _ in texts]
    space = [(i, d) for i in range(len(texts)) for d in range(len(sets)) if i or d]
    rng.shuffle(space)
    # new instructions come first
    space.sort(key=lambda c: c[0] < len(HINTS))
    for i, d in space[: max(0, count - 1)]:
        out.append(replace(base, instruction=texts[i], demos=list(sets[d]), config=dict(base.config), choice=(i, d)))
    return out


def ask_for_instructions(ask: Callable[[str, int], str], base: Program, demos: list[dict[str, Any]], count: int) -> list[str]:
    """Instructions that an endpoint proposes from the base's and some labelled examples; a
    failed or empty answer proposes nothing."""
    shown = "\n".join(json.dumps(d, ensure_ascii=False) for d in demos[:8])
    text = f"This instruction asks a model for a task:\n{base.instruction}\n\nExamples with the right scores:\n{shown}\n\nWrite one better instruction for the same task. Answer with the instruction alone."
    out: list[str] = []
    for i in range(count):
        try:
            answer = ask(text, i + 1).strip()
        except Exception as e:  # noqa: BLE001
            print(f"no instruction proposed: {e}", file=sys.stderr)
            continue
        if answer and answer not in out:
            out.append(answer)
    return out


def demonstrations(data: DataFrame, objective: str, count: int, seed: int = 42) -> list[dict[str, Any]]:
    """A few labelled examples in seeded order (count is a parameter of the search)."""
    cols = [*INPUT_COLS, "score"] if objective == "tRMSE" else [*PAIR_INPUT_COLS, "tgt1_score", "tgt2_score"]
    return [r.asDict() for r in data.select(*cols).orderBy(order_key(seed, *cols)).limit(count).collect()]


def next_trials(programs: list[Program], seen: dict[int, float], count: int, rng: random.Random) -> list[int]:
    """Untried programs whose instruction and demonstrations are frequent among the better
    quarter of those tried and rare among the rest (a categorical tree-structured Parzen
    estimator); one of them by chance, so that no part of the space is given up."""
    left = [p for p in range(len(programs)) if p not in seen]
    if len(left) <= count or not seen:
        return left[:count]
    ranked = sorted(seen, key=lambda p: (-seen[p], p))
    good = ranked[: max(1, len(ranked) // 4)]

    def promise(p: int) -> float:
        total = 0.0
        for part in (0, 1):
            value = programs[p].choice[part]
            share = lambda among: (1 + sum(programs[q].choice[part] == value for q in among)) / (len(among) + 2)
            total += math.log(share(good) / share(ranked[len(good) :]))
        return total

    best = sorted(left, key=lambda p: (-promise(p), p))[: count - 1]
    return best + [rng.choice([p for p in left if p not in best])]


def search_joint(programs: list[Program], train: DataFrame, validation: DataFrame | None, predict: CandidateColumn, config: TrainingConfig, minibatch: int = 200, keep: int | None = None, trials: int | None = None, seed: int = 42) -> tuple[int, DataFrame]:
    """Scores all candidates on all data in one pass; returns the best one's number and the
    table of final scores. Only if `keep` or `trials` is given, cheap trials come first, as in
    MIPROv2 (arXiv 2406.11695): so many candidates, picked four at a time by what the trials
    before say about their parts, each four on a seeded minibatch of their own, and the best few
    (3, unless `keep` says otherwise) on all data."""
    best = list(range(len(programs)))
    if keep is not None or trials is not None:
        rng, seen = random.Random(seed), {}
        todo = len(programs) if trials is None else min(max(1, trials), len(programs))
        step = len(programs) if trials is None else 4
        while len(seen) < todo:
            some = next_trials(programs, seen, min(step, todo - len(seen)), rng)
            small = table(train.orderBy(order_key(seed + len(seen), *train.columns)).limit(minibatch), "minibatch")
            for r in evaluate(small, some, predict, config.objective, config.epsilon).collect():
                seen[r.program] = r.objective or 0.0
        best = sorted(seen, key=lambda p: (-seen[p], p))[: max(1, 3 if keep is None else keep)]
    final = table(evaluate(validation if validation is not None else train, best, predict, config.objective, config.epsilon), "final")
    top = final.orderBy(F.desc("objective"), "program").first()
    return top.program, final


def search_ascent(programs: list[Program], train: DataFrame, validation: DataFrame | None, predict: CandidateColumn, config: TrainingConfig, steps: int = 4, batch: int = 100, seed: int = 42) -> tuple[int, DataFrame]:
    """Hill climbing that looks at its own mistakes, after the idea of stochastic introspective
    minibatch ascent. Each step takes the examples on which the current program and its rivals
    spread most, over all data, makes two new programs from the current one (with the example
    it is worst on as a demonstration; with a rule against the side it errs to), and goes on
    with the best of all on those examples. New programs are added to `programs`. Reports the
    metric of the first and the last one on all validation data."""
    current, rivals = 0, list(range(1, min(3, len(programs))))
    ins = {c: F.col(c) for c in INPUT_COLS} if config.objective == "tRMSE" else {"src_lang": F.col("src_lang"), "tgt_lang": F.col("tgt_lang"), "src": F.col("src"), "tgt": F.col("tgt1")}
    gold = F.col("score" if config.objective == "tRMSE" else "tgt1_score")
    cols = [*INPUT_COLS, "score"] if config.objective == "tRMSE" else [*PAIR_INPUT_COLS, "tgt1_score", "tgt2_score"]
    untried = list(range(3, len(programs)))
    for step in range(steps):
        if not rivals and not untried:
            break
        predictions = [predict(p, ins).cast("double") for p in (current, *rivals)]
        spread = F.greatest(*predictions) - F.least(*predictions) if rivals else F.abs(predictions[0] - gold)
        hard = train.withColumn("spread", spread).withColumn("off", predictions[0] - gold)
        hard = table(hard.orderBy(F.desc("spread"), order_key(seed + step, *train.columns)).limit(batch), "hard")
        rows = evaluate(hard.drop("spread", "off"), [current, *rivals], predict, config.objective, config.epsilon).collect()
        current = min(rows, key=lambda r: (-(r.objective or 0.0), r.program)).program
        worst = hard.where("off is not null").orderBy(F.desc(F.abs("off")), order_key(seed, *train.columns)).select(*cols).first()
        mean = hard.agg(F.avg("off")).first()[0]
        rivals, untried = untried[:1], untried[1:]
        if worst is not None:
            base = programs[current]
            rule = RULES[0] if (mean or 0.0) > 0 else RULES[1]
            for new in (replace(base, demos=[*base.demos, worst.asDict()]), replace(base, instruction=f"{base.instruction} {rule}")):
                if new not in programs:
                    programs.append(new)
                    rivals.append(len(programs) - 1)
    if rivals:
        rows = evaluate(train, [current, *rivals], predict, config.objective, config.epsilon).collect()
        current = min(rows, key=lambda r: (-(r.objective or 0.0), r.program)).program
    final = table(evaluate(validation if validation is not None else train, sorted({0, current}), predict, config.objective, config.epsilon), "final")
    return current, final


OPTIMIZERS = {"MIPROv2": search_joint, "SIMBA": search_ascent}
#: Options of each search, and the names under which the command line takes them.
SEARCH = {"MIPROv2": ("minibatch", "keep", "trials", "seed"), "SIMBA": ("steps", "batch", "seed")}
NAMES = {"minibatch_size": "minibatch", "num_trials": "trials", "num_instruct_candidates": "instructions", "full_evals": "keep", "max_steps": "steps", "bsize": "batch", "max_labeled_demos": "per_program", "max_demos": "per_program"}


def search_options(optimizer: str, params: dict[str, Any], compile_params: dict[str, Any]) -> dict[str, Any]:
    """Options of a search from its two free-form dictionaries, the second one winning; names
    that the search doesn't have are in `unknown`."""
    out: dict[str, Any] = {"num_candidates": 8, "seed": 42, "per_program": 4, "instructions": 0}
    unknown = []
    for name, value in {**params, **compile_params}.items():
        own = NAMES.get(name, name)
        if own not in out and own not in SEARCH[optimizer]:
            unknown.append(name)
        elif value is not None:
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise ValueError(f"{name} must be a number that isn't negative")
            out[own] = value
    return {**out, "unknown": sorted(unknown)}


def request_tasks(args, spark) -> int:
    return max(1, min(parallelism(spark), args.max_concurrent))


def asked(programs: list[Program], args, train: DataFrame) -> CandidateColumn:
    """Predictions of an endpoint as a column: a Pandas UDF that sends each batch of rows.

    A program is asked as it would be in a prediction: all samples of its architecture, the
    first one directly and the others with reasoning, combined by its method. The limit on
    requests is divided among the tasks that may run at a time.
    """
    from segloom.cli import scorer_of
    from segloom.functions.aggregates import combine
    from segloom.scoring.architectures import architecture

    tasks = request_tasks(args, train.sparkSession)

    def predict(number: int, inputs: dict[str, Column]) -> Column:
        program = programs[number]
        arch = architecture(program.architecture).configured(program.config)
        scorer = scorer_of(args, arch.signature, program.state(), arch.sampling_temperature)
        if hasattr(scorer, "shared_by"):
            scorer = scorer.shared_by(tasks)

        @F.pandas_udf("int")
        def ask(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            rows = [dict(zip(INPUT_COLS, values)) for values in zip(a, b, c, d)]
            samples = [[r.score for r in scorer.score_batch(rows, i)] for i in range(arch.num_samples)]
            if arch.method:
                return pd.Series([combine(arch.method, list(x)) for x in zip(*samples)], dtype="int32")
            return pd.Series([s if s is not None else 0 for s in samples[0]], dtype="int32")

        return ask(*[inputs[c] for c in INPUT_COLS])

    return predict
