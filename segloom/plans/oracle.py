"""DuckDB SQL of the queries in `queries.py`, written from their definitions."""

from __future__ import annotations

from segloom.operators.pairs import STEPS
from segloom.schema import CRITERIA

_LUT = "lut as (select distinct lower(k) as k, lang_name as name from (select unnest([lang_code, alpha3, alpha3_b, lang_name]) as k, lang_name from lang_names))"


def _key(c: str) -> str:
    label = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    return f"case when regexp_full_match({label}, '[a-z]{{2,3}}[-_][a-z0-9]{{2,8}}') then regexp_extract({label}, '^([a-z]{{2,3}})', 1) else {label} end"


def _named(table: str, columns: str = "*") -> str:
    return f"""(select t.* replace (coalesce(a.name, t.src_lang) as src_lang, coalesce(b.name, t.tgt_lang) as tgt_lang)
      from (select {columns} from {table}) t left join lut a on a.k = {_key("t.src_lang")} left join lut b on b.k = {_key("t.tgt_lang")})"""


_SEG = f"seg as (select * from {_named('segments')} where src is not null and tgt is not null and score is not null and isfinite(score))"
_HEAD = f"with {_LUT}, {_SEG}"


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::bigint"


def _score(salt: str, sample: str = "'0'", tgt: str = "tgt") -> str:
    return f"({_hash(f"'{salt}'", sample, "coalesce(src_lang, '')", "coalesce(tgt_lang, '')", "coalesce(src, '')", f"coalesce({tgt}, '')")} % 101)::int"


def _hash_60(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::bigint"


def _k_pairs(k: int) -> str:
    count = "(n_candidates * (n_candidates - 1) // 2)"
    steps = "[" + ", ".join(f"{s}::bigint" for s in STEPS) + "]"
    return f"""numbered as (
      select *, row_number() over (partition by src_lang, tgt_lang, src order by seg_id) - 1 as idx,
        count(*) over (partition by src_lang, tgt_lang, src) as n_candidates
      from seg where src_lang is not null and tgt_lang is not null),
    sources as (select src_lang, tgt_lang, src, {count} as cnt, {_hash_60("'42'", "src_lang", "tgt_lang", "src")} as draw, {_hash_60("'42step'", "src_lang", "tgt_lang", "src")} as other from numbered where idx = 0 and n_candidates >= 2),
    drawn as (
      select src_lang, tgt_lang, src, (draw % cnt + t * ({steps}[(other % {len(STEPS)} + 1)::int] % cnt) % cnt) % cnt as number
      from sources, range({k}) r(t) where t < cnt),
    pairs as (
      select a.src_lang, a.tgt_lang, a.src, a.seg_id as id1, b.seg_id as id2, a.tgt as tgt1, b.tgt as tgt2, a.score as tgt1_score, b.score as tgt2_score
      from drawn d
      join numbered a on (a.src_lang, a.tgt_lang, a.src) = (d.src_lang, d.tgt_lang, d.src)
      join numbered b on (b.src_lang, b.tgt_lang, b.src) = (d.src_lang, d.tgt_lang, d.src)
      where a.idx < b.idx and b.idx * (b.idx - 1) // 2 + a.idx = d.number)"""


_PREDS = f"preds as (select *, {_score('s', tgt='tgt1')} as tgt1_pred, {_score('s', tgt='tgt2')} as tgt2_pred from pairs)"
_PAIRED = f"{_HEAD}, {_k_pairs(4)}, {_PREDS}"


def _pa(eps: float) -> str:
    return f"case when abs(tgt1_score - tgt2_score) <= {eps} then 1.0::double when (tgt1_score - tgt2_score > 0) = (tgt1_pred - tgt2_pred > 0) then 1.0::double else 0.0::double end"


_CLAMPED = "greatest(0.0::double, least(100.0::double, score::double))"
_RRWA = f"""rrwa as (
  select seg_id, coalesce(round_even(sum(s / rn) / sum(1.0::double / rn), 0), 0)::int as score from (
    select seg_id, s, row_number() over (partition by seg_id order by s desc) as rn
    from (select seg_id, {_CLAMPED} as s from score_samples where score is not null)) group by seg_id
  union all select seg_id, 0 from score_samples group by seg_id having count(score) = 0)"""
_LENGTH = "case when greatest(length(src), length(tgt)) = 0 then 0 else floor(100.0::double * least(length(src), length(tgt)) / greatest(length(src), length(tgt)))::int end"
_OBJECT = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
# of repeated keys the last one counts; NaN and Infinity are no JSON
_LAST = ", ".join(
    f"(select json_extract_string(arg_max(value, id), '$') from json_each(case when kind = 'ok' then line else '{{}}' end) where key = '{c}') as {'score_text' if c == 'score' else c}"
    for c in ("src_lang", "tgt_lang", "src", "tgt", "score")
)
_LINES = f"""lines as (select *, {_OBJECT} as line from da_lines),
kinds as (select *, case when line is null or line = '' then 'blank' when not starts_with(line, '{{') then 'no object' when json_valid(line) and not regexp_matches(line, ':\\s*-?(NaN|Infinity|inf)\\s*[,}}]') then 'ok' else 'broken' end as kind from lines),
typed as (select *, {_LAST} from kinds),
parsed as (
  select *, case when score_text = 'true' then 1.0::double when score_text = 'false' then 0.0::double
    when regexp_full_match(trim(score_text), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(score_text) as double) end as score from typed)"""


def _candidates(count: int) -> str:
    """Every candidate program over all examples."""
    off = "((score - {0}) / 100.0::double)"
    each = [f"select {p}::int as program, count(*) as n, round(avg(1.0::double - {off.format(_score(f'program{p}'))} * {off.format(_score(f'program{p}'))}), 6) as objective from seg" for p in range(count)]
    return f"{_HEAD} " + " union all ".join(each)


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


def _edges() -> dict[str, str]:
    """What surrounds scoring."""
    inputs = ["src_lang", "src", "tgt", "tgt_lang"]
    states = []
    for name, method in (("DA", None), ("MR7", None), ("MR7MEAN", "mean"), ("MR7RRWA", "RRWA")):
        config = f'{{"method": "{method}", "num_samples": 4, "sampling_temperature": 0.5}}' if method else "{}"
        states += [(name, "architecture", f'"{name}"'), (name, "config", config), (name, "demos", '[{"src": "ä"}]'), (name, "input_fields", "[" + ", ".join(f'"{c}"' for c in sorted(inputs)) + "]")]
    messages = [
        ("k of pairs", "k_per_source must be >= 1"),
        ("limit", "max_examples must not be negative"),
        ("aggregation", "Unknown aggregation method: median"),
        ("architecture", "Unknown architecture: ESA. Available architectures: DA, DATERM, MR7, MR7MEAN, MR7RRWA, MR8"),
        ("objective", "Unknown objective: RMSE"),
        ("training objective", "Unknown objective: RMSE"),
        ("required fields", "Missing required fields: score, src"),
        ("file without scores", "Missing required fields: score"),
        ("file with a wrong score", "Invalid score value: 'not-a-number'"),
        ("samples", "num_samples must be >= 1"),
        ("option", "not valid JSON"),
    ]
    roles = [("example input", i, c) for i, c in enumerate(("src_lang", "tgt_lang", "src", "tgt"))] + [("example label", 0, "score")]
    roles += [("pair input", i, c) for i, c in enumerate(("src_lang", "tgt_lang", "src", "tgt1", "tgt2"))] + [("pair label", 0, "tgt1_score"), ("pair label", 1, "tgt2_score")]
    settings = [("MIPROv2", *x) for x in (("num_candidates", "6"), ("per_program", "2"), ("trials", "9"), ("seed", "7"), ("instructions", "0"), ("unknown", "x"))]
    settings += [("SIMBA", *x) for x in (("num_candidates", "8"), ("per_program", "4"), ("batch", "32"), ("steps", "3"), ("seed", "5"), ("instructions", "0"))]
    number = _hash("'fail'", "src", "tgt") + " % 10"
    mean = " + ".join(_score("s", f"'{i}'") for i in range(10) if i % 3)
    three = " + ".join(_score("s", f"'{i}'") for i in range(3))
    ends = f"{_HEAD}, {_k_pairs(3)}"
    return {
        "scan_compressed": "select codec, seg_id, src_lang, tgt_lang, src, tgt from segments, (values ('gzip'), ('bzip2')) c(codec)",
        "sink_order": "select count(*) as n_lines, 0::bigint as n_late, 0::bigint as n_overlaps from segments",
        "scan_stdin": "select 'ok' as kind, lang_code as src_lang, alpha3 as tgt_lang, lang_name as src, null::varchar as tgt from lang_names",
        "rejected_lines": f"with {_LINES} select case when kind <> 'ok' then kind when score is null then 'invalid score' else 'missing field' end as reason, count(*) as n from parsed where raw is not null and kind <> 'blank' and not coalesce(kind = 'ok' and score is not null and src_lang is not null and tgt_lang is not null and src is not null and tgt is not null, false) group by 1",
        "program_state": _values(states, "program, setting, value"),
        "score_configured": f"{_HEAD} select seg_id, (({three}) // 3)::int as score from seg",
        "score_failures": f"{_HEAD} select seg_id, case when {number} in (0, 2) then 0 else {_score('s')} end as score, case when {number} = 0 then 'ValueError' when {number} = 2 then 'timeout' end as error from seg",
        "score_failed_samples": f"{_HEAD} select seg_id, (({mean}) // 10)::int as score from seg",
        "score_cached": f"{_HEAD} select seg_id, {_score('s')} as score, null::varchar as error from seg",
        "score_endpoint": f"{_HEAD} select seg_id, {_score('s')} as score, null::varchar as error, true as within_limit from seg",
        "guards": _values(messages, "guard, message"),
        "input_roles": _values(roles, "role, place, name"),
        "search_settings": _values(settings, "search, setting, value"),
        "training_sets": f"{ends} (select 'example' as kind, seg_id as id1, seg_id as id2 from seg order by md5('42|' || seg_id), seg_id limit 100) union all (select 'pair', id1, id2 from pairs order by md5('42|' || id1 || '|' || id2), id1, id2 limit 60)",
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "eval_by_lang": f"{_HEAD} select tgt_lang, count(*) as n, round(avg(1.0::double - ((score - {_LENGTH}) / 100.0::double) * ((score - {_LENGTH}) / 100.0::double)), 6) as objective from seg group by tgt_lang",
        "sink_roundtrip": "select seg_id, src_lang, tgt_lang, src, tgt, case when isfinite(score) then score end as score from segments",
        "fan_out": "select seg_id, p::int as part from segments, range(2) r(p) where p < seg_id % 3",
        "stream_scores": f"select src_lang, tgt_lang, src, tgt, {_score('s')} as score from split_examples where src is not null and tgt is not null",
        "normalize_lang": f"with {_LUT} select src_lang, tgt_lang, count(*) as n from {_named('segments', 'src_lang, tgt_lang')} group by all",
        "validate_schema": "select * from (values ('segments', ''), ('split_examples', ''), ('score_samples', 'src, src_lang, tgt, tgt_lang'), ('documents', 'score, src, src_lang, tgt, tgt_lang')) t(table_name, missing)",
        "validate_score": "select origin, coalesce(isfinite(score), false) as valid, count(*) as n, round(sum(case when isfinite(score) then score end), 4) as total from segments group by all",
        "shuffle_limit": "select doc_id, source from documents order by md5('42|' || doc_id), doc_id limit 100",
        "truncate": "select doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') as text from documents",
        "clip_scores": "select seg_id, case when score is not null then greatest(20.0::double, least(score, 80.0::double)) end as clipped from segments where not coalesce(isnan(score), false) and score is not null union all select seg_id, null from segments where score is null",
        "group_sources": f"{_HEAD} select src_lang, tgt_lang, src, count(*) as n_candidates from seg group by all",
        "group_filter": f"{_HEAD} select src_lang, tgt_lang, src, count(*) as n_candidates from seg group by all having count(*) >= 2",
        "pairs_all": f"{_HEAD} select a.seg_id as id1, b.seg_id as id2, a.score as tgt1_score, b.score as tgt2_score from seg a join seg b using (src_lang, tgt_lang, src) where a.seg_id < b.seg_id",
        "pairs_topk": f"{_HEAD}, {_k_pairs(2)} select id1, id2, tgt1_score, tgt2_score from pairs",
        "pairs_limit": f"{_HEAD}, {_k_pairs(8)} select id1, id2 from pairs order by md5('42|' || id1 || '|' || id2), id1, id2 limit 50",
        "score_da": f"{_HEAD} select seg_id, {_score('s')} as score from seg",
        "score_worker": f"{_HEAD} select seg_id, {_score('s')} as score from seg",
        "score_length": f"{_HEAD} select seg_id, {_LENGTH} as score from seg",
        "score_mr7": f"{_HEAD} select seg_id, {_score('s')} as score, " + ", ".join(f"({_hash("'s'", f"'{c}'", 'coalesce(src_lang, \'\')', 'coalesce(tgt_lang, \'\')', 'src', 'tgt')} % 11)::int as {c}_score" for c in CRITERIA) + " from seg",
        "sample_fanout": f"{_HEAD} select seg_id, i::int as sample_id, {_score('s', 'i::varchar')} as sample_score from seg, range(10) r(i)",
        "score_override": f"{_HEAD}, short as (select * replace (array_to_string(list_slice(string_split(src, ' '), 1, 20), ' ') as src, array_to_string(list_slice(string_split(tgt, ' '), 1, 20), ' ') as tgt) from seg) select seg_id, system_name, origin, src, tgt, {_score('s')} as score from short",
        "agg_mean": f"select seg_id, coalesce(floor(avg(case when score is not null then {_CLAMPED} end)), 0)::int as score from score_samples group by seg_id",
        "agg_rrwa": f"with {_RRWA} select * from rrwa",
        "agg_arrays": f"with {_RRWA} select m.seg_id, m.mean_score, r.score as rrwa_score from (select seg_id, coalesce(floor(avg(case when score is not null then {_CLAMPED} end)), 0)::int as mean_score from score_samples group by seg_id) m join rrwa r using (seg_id)",
        "terminology": f"{_HEAD}, terms as (select n_regionkey, string_agg(n_name, ',' order by n_name) as names, count(*) as n from nation group by 1) select seg_id, coalesce(n, 0)::int as n_terms, {_score('term', tgt="tgt || '|' || coalesce(names, '')")} as score from seg left join terms on n_regionkey = seg_id % 6",
        "pairwise_score": f"{_PAIRED} select id1, id2, tgt1_pred, tgt2_pred from preds",
        "metric_trmse": f"{_HEAD} select seg_id, round(1.0::double - ((score - {_score('s')}) / 100.0::double) * ((score - {_score('s')}) / 100.0::double), 9) as metric from seg",
        "metric_pa": f"{_PAIRED} select id1, id2, {_pa(0.0)} as metric from preds",
        "metric_pa_eps": f"{_PAIRED} select id1, id2, {_pa(5.0)} as metric from preds",
        "metric_pa_strict": f"{_PAIRED} select id1, id2, case when sign(tgt1_score - tgt2_score) = sign(tgt1_pred - tgt2_pred) then 1.0::double else 0.0::double end as metric from preds",
        "eval_pairs_by_lang": f"{_PAIRED} select tgt_lang, count(*) as n, round(avg({_pa(0.0)}), 6) as objective from preds group by tgt_lang",
        "eval_samples": f"with {_RRWA} select system_name, count(*) as n, round(avg(1.0::double - ((g.score - r.score) / 100.0::double) * ((g.score - r.score) / 100.0::double)), 6) as objective from segments g join rrwa r using (seg_id) where g.score is not null and not isnan(g.score) group by system_name",
        "eval_by_candidate": _candidates(4),
        "search_mipro": _candidates(6),
    }
    out |= _edges()
    samples = f"samples as (select seg_id, i, {_score('s', 'i::varchar')}::double as s from seg, range(10) r(i))"
    out["score_mr7mean"] = f"{_HEAD}, {samples} select seg_id, floor(avg(s))::int as score from samples group by seg_id"
    out["score_mr7rrwa"] = f"{_HEAD}, {samples} select seg_id, round_even(sum(s / rn) / sum(1.0::double / rn), 0)::int as score from (select *, row_number() over (partition by seg_id order by s desc) as rn from samples) group by seg_id"
    out["scan_jsonl"] = f"with {_LINES} select file_name, kind, count(*) as n_lines, count(score) as n_scores from parsed group by all"
    out["scan_da"] = f"with {_LUT}, {_LINES}, recs as (select line_id, src_lang, tgt_lang, src, tgt, score from parsed where kind = 'ok' and score is not null) select * from {_named('recs')} where src is not null and tgt is not null"
    return out
