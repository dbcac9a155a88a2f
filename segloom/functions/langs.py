"""Language labels: any spelling of a language to its code or its English name.

A label may be a two-letter code, a three-letter code (either variant), an English name, in
any letter case, with surrounding white space, and codes may carry a region (`en-GB`,
`pt_BR`). Anything else names no language and gives null. The languages come from a table
(lang_code, alpha3, alpha3_b, lang_name; all of ISO 639 has about 8,000 rows); without one,
a short list stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, for use without a table: code, three-letter code, its bibliographic variant,
#: English name.
LANGUAGES = [
    ("en", "eng", "eng", "English"),
    ("de", "deu", "ger", "German"),
    ("fr", "fra", "fre", "French"),
    ("es", "spa", "spa", "Spanish"),
    ("cs", "ces", "cze", "Czech"),
    ("pl", "pol", "pol", "Polish"),
    ("ru", "rus", "rus", "Russian"),
    ("uk", "ukr", "ukr", "Ukrainian"),
    ("ja", "jpn", "jpn", "Japanese"),
    ("sk", "slk", "slo", "Slovak"),
    ("pt", "por", "por", "Portuguese"),
    ("it", "ita", "ita", "Italian"),
    ("nl", "nld", "dut", "Dutch"),
    ("be", "bel", "bel", "Belarusian"),
    ("zh", "zho", "chi", "Chinese"),
]
#: Labels that say that the language isn't known or isn't one.
PLACEHOLDERS = ("", "?", "-", "xx", "n/a", "na", "none", "null", "unknown", "und", "undetermined", "mis", "mul", "zxx", "other")
#: Rows that a table of languages may have, since it is broadcast.
MOST_LANGUAGES = 20_000


def spellings(names: DataFrame | None = None) -> dict[str, tuple[str, str]]:
    """Lower-case spelling -> (code, name). A spelling of two languages is the code of one
    before it is the name of the other; a table of more than MOST_LANGUAGES rows is an error."""
    rows = LANGUAGES
    if names is not None:
        rows = [tuple(r) for r in names.select("lang_code", "alpha3", "alpha3_b", "lang_name").limit(MOST_LANGUAGES + 1).collect()]
        if len(rows) > MOST_LANGUAGES:
            raise ValueError(f"a table of languages has at most {MOST_LANGUAGES} rows")
    out: dict[str, tuple[str, str]] = {}
    for which in (3, 2, 1, 0):
        for row in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
            # a language without a two-letter code goes by its three-letter one
            code = row[0] or row[1] or row[2]
            if row[which] and code:
                out[row[which].strip().lower()] = (code, row[3] or code)
    return out


def label_key(c: Column | str) -> Column:
    """A label in lower case without surrounding white space and region: what is looked up."""
    label = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", ""))
    return F.when(label.rlike(r"^[a-z]{2,3}[-_][a-z0-9]{2,8}$"), F.regexp_extract(label, r"^([a-z]{2,3})", 1)).otherwise(label)


def _lookup(c: Column, which: int) -> Column:
    pairs = [F.lit(x) for s, v in spellings().items() for x in (s, v[which])]
    return F.try_element_at(F.create_map(*pairs), label_key(c))


def lang_code(c: Column | str) -> Column:
    """Two-letter code of a label in any spelling; null if it names no language of the list."""
    return _lookup(F.col(c) if isinstance(c, str) else c, 0)


def lang_name(c: Column | str) -> Column:
    """English name of a label in any spelling; the label itself if it names no language."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_lookup(c, 1), c)


def code_of(label: str | None) -> str | None:
    """`lang_code` for one Python string (driver side and tests)."""
    if label is None:
        return None
    table, label = spellings(), label.strip().lower()
    if label in table:
        return table[label][0]
    head, sep, tail = label.replace("_", "-").partition("-")
    return table[head][0] if sep and tail and len(head) <= 3 and head in table else None


def looked_up(df: DataFrame, new: str, old: str, which: int, names: DataFrame | None = None) -> DataFrame:
    """Adds code (which 0) or name (1) of a label column by one broadcast hash join; the table
    has four rows for each language."""
    rows = [(s, v[which]) for s, v in spellings(names).items()]
    lut = df.sparkSession.createDataFrame(rows, f"`__k_{new}` string, `{new}` string")
    return df.withColumn(f"__k_{new}", label_key(old)).join(F.broadcast(lut), f"__k_{new}", "left").drop(f"__k_{new}")


def with_label_codes(df: DataFrame, names: DataFrame | None = None, **columns: str) -> DataFrame:
    """Adds code columns; `columns` maps the new name to the label column.

    For hot paths: one hash lookup per row instead of a scan of a map literal.
    """
    for new, old in columns.items():
        df = looked_up(df, new, old, 0, names)
    return df


def entity_of(code: Column, label: Column | str) -> Column:
    """What a label means for equality: its code, or for a label that isn't in the table, but
    isn't a placeholder either, its own key with a mark; null if it names no language."""
    key = label_key(label)
    own = F.when(key.isNotNull() & ~key.isin(*PLACEHOLDERS) & key.rlike(r"\p{L}"), F.concat(F.lit("?"), key))
    return F.coalesce(code, own)
