"""Quality rules: a threshold table compiled into one Spark projection.

All statistics and rules are built-in expressions over the row: no shuffle and
no user functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import kept_columns, unpacked

SYMBOLS = "#*$%&|<>"
_BLANK = "' \\t\\n\\u000B\\u000C\\r'"

#: Stop words by language (fixed values).
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for"),
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "que"),
    "es": ("el", "la", "los", "de", "que", "y", "en", "un", "se", "con"),
}
#: (rule, statistic, comparison that holds for text to keep, threshold). Ratios in
#: hundredths of the words, lines or letters, so that all arithmetic is of integers.
RULES = (
    ("mean word length, low", "100 * word_chars", ">=", "200 * n_words"),
    ("mean word length, high", "100 * word_chars", "<=", "1500 * n_words"),
    ("symbols to words", "100 * n_symbols", "<=", "40 * n_words"),
    ("repeated lines", "100 * n_dup_lines", "<=", "40 * n_lines"),
    ("stop words", "100 * n_stop", ">=", "5 * n_words"),
    ("capital letters", "100 * n_upper", "<=", "40 * word_chars"),
)
MIN_WORDS, MAX_REPEATED = 50, 50
_OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_upper", "base_failed", "kept")


def with_rules(docs: DataFrame, rules=RULES, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the statistics, base_failed and kept for each row of docs(text, ...).

    Words are runs without ASCII white space. n_dup_lines counts lines with a word
    that equal an earlier line; n_repeat_words counts words inside a window of three
    words that the text holds twice or more (found by sorting the windows' 64-bit
    hashes inside the row). Null and empty texts have no words and fail the base
    rule. Rows are judged one by one, so repeated rows and ties change nothing; an empty
    table gives no rows. A kept column named like an output gives way to it; other
    columns, whatever their names, have no part.
    """
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    df = docs.select(kept_columns(keep, _OUTPUTS), F.expr("coalesce(text, '')").alias("_t"))
    df = df.withColumn("_w", F.expr("filter(split(_t, '[ \\\\t-\\\\r]+'), w -> w != '')"))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), l -> trim(BOTH {_BLANK} FROM l) != '')"))
    # No lambda below refers to a column: a filter pushed into this projection then repeats an
    # expression a few times, never once an element.
    df = df.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    df = df.withColumn("_h", F.expr("zip_with(zip_with(_h, slice(_h, 2, size(_h)), (a, b) -> xxhash64(a, b)), slice(_h, 3, size(_h)), (p, c) -> xxhash64(p, c))"))
    df = df.withColumn("_g", F.expr("sort_array(transform(slice(_h, 1, greatest(0, size(_h) - 2)), (h, i) -> struct(h, i)))"))
    df = df.withColumn("_r", F.expr("sort_array(array_distinct(flatten(filter(zip_with(_g, slice(_g, 2, size(_g)), (x, y) -> IF(x.h = y.h, array(x.i, y.i), null)), p -> p IS NOT NULL))))"))
    df = df.select(
        *unpacked(keep, _OUTPUTS),
        # the id's zero keeps Catalyst from pushing a filter on the verdict into the projections
        # below, where it would evaluate all of them again for each statistic that it names
        (F.expr("cast(size(_w) as bigint)") + 0 * F.monotonically_increasing_id()).alias("n_words"),
        F.expr("cast(length(array_join(_w, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(regexp_count(_t, '[{SYMBOLS}]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(_r, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + cast(least(3, i - a.last) as bigint) AS n, i AS last), a -> a.n)").alias("n_repeat_words"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr(f"cast(size(filter(_w, w -> lower(w) IN ({stop}))) as bigint)").alias("n_stop"),
        F.expr("cast(regexp_count(_t, '[A-Z]') as bigint)").alias("n_upper"),
    )
    df = df.withColumn("base_failed", F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeated} * n_words"))
    return df.withColumn("kept", F.expr("NOT base_failed AND " + " AND ".join(f"({a} {op} {b})" for _, a, op, b in rules)))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_BLANK_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANK_SQL}, '')) > 0) AS l FROM d),
u AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS s FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g WHERE s IS NOT NULL) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANK_SQL}, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop,
      CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper
      FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND {" AND ".join(f"({a} {op} {b})" for _, a, op, b in RULES)} AS kept FROM b
"""
