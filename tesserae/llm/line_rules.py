"""Line-first cleaning rules as DataFrame expressions.

Each line is judged by itself: navigation (links in a row), boilerplate (set phrases),
shouting and symbol runs behind words, and lines that end without a mark. Failing lines go;
a document that loses half of its characters in words, or that fails the base rules, goes too.

Defined results: a null text has no words and fails the base rules; an empty line is neither
kept nor lost; texts of any length are read whole; repeated rows get equal results; an empty
table gives no rows. clean_lines() keeps all other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
PLACE_BITS = 32  # of a number that holds a window's place and the upper bits of its hash
#: Patterns that Java and RE2 read alike.
NAVIGATION = r"(\|[^|]*){3}|(>[^>]*){3}|( [-–·•] [^-–·•]*){3}"
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept cookies|enable javascript"
    r"|click here|sign up|log ?in|subscribe|read more|share this|licensed under|copyright \(c\)"
)
MARKED_WORD = r"[!?]{2,}|[#*$%&<>]{3}"
SENTENCE_END = r"[.!?…:;\"'”»)][ \t\r]*$"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _neighbours(ranked: str, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the next one; null behind the last."""
    return F.zip_with(ranked, F.slice(ranked, 2, F.size(ranked)), f)


def _places(ranked: str, same: str, place: Callable[[Column], Column]) -> Column:
    """Sorted places of the elements that are the same as the next or the last one."""
    some = F.filter(ranked, lambda x, k: F.get(same, k) | F.get(same, k - 1))
    return F.sort_array(F.transform(some, place))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_repeat_words, from the windows' hashes (_windows).

    Equal hashes meet in sorted numbers of a hash's upper bits and its place. Where different
    hashes have the same upper bits, whole hashes are sorted instead. Each sorted array is a
    column, since an expression used twice would be sorted twice.
    """
    first = lambda some: F.slice("_windows", 1, F.when(some, F.size("_windows")).otherwise(0))
    low = (1 << PLACE_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    packed = lambda h, i: F.coalesce(h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))
    upper = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0
    whole = lambda x, y: F.get("_windows", place(x)) == F.get("_windows", place(y))
    ranked = docs.withColumn(
        "_packed", F.sort_array(F.transform(first(F.size(F.array_distinct("_windows")) < F.size("_windows")), packed))
    ).withColumns(
        {
            "_same": _neighbours("_packed", lambda x, y: upper(x, y) & whole(x, y)),
            "_mixed": F.exists(_neighbours("_packed", lambda x, y: upper(x, y) & ~whole(x, y)), lambda x: F.coalesce(x, F.lit(False))),
        }
    )
    hashed = ranked.withColumn(
        "_hashed", F.sort_array(F.transform(first(F.col("_mixed")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).withColumn("_equal", _neighbours("_hashed", lambda x, y: x["h"] == y["h"]))
    places = F.when(F.col("_mixed"), _places("_hashed", "_equal", lambda x: x["i"])).otherwise(_places("_packed", "_same", place))
    return (
        hashed.withColumn("_places", places).withColumn("n_repeat_words", _covered(F.col("_places")))
        .drop("_packed", "_same", "_mixed", "_hashed", "_equal", "_places")
    )


def _covered(places: Column) -> Column:
    """Words in the union of the windows at these sorted places."""
    steps = F.zip_with(
        places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _without(text: Column, pattern: str) -> Column:
    """Characters of a text that a pattern leaves."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with the base counts, each document's kept lines (kept_text) and the verdict."""
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumns(
        {
            "_words": _words(text),
            "_lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
            "n_symbols": F.char_length(text) - _without(text, f"[{SYMBOLS}]"),
        }
    )
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
    )
    marked = lambda x: F.regexp_count(x, F.lit(MARKED_WORD))
    spaces = lambda x: F.regexp_count(x, F.lit("[ \\t-\\r]+"))
    bad = lambda x: (
        ~F.rlike(x, F.lit(SENTENCE_END))
        | ((marked(x) > 0) & (marked(x) * 5 > spaces(x) + 1))
        | F.rlike(x, F.lit(NAVIGATION))
        | F.rlike(x, F.lit(BOILERPLATE))
    )
    wide = base.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "_windows": F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_kept": F.filter("_lines", lambda x: ~bad(x)),
        }
    )
    counted = _with_repeats(wide).withColumn("kept_text", F.array_join("_kept", "\n"))
    judged = counted.withColumns(
        {
            "kept_chars": _without(F.col("kept_text"), "[ \\t-\\r]+"),
            "n_lines": F.size("_lines").cast("long"),
            "n_lines_kept": F.size("_kept").cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    enough = 100 * (F.col("word_chars") - F.col("kept_chars")) <= MAX_LOST_PERCENT * F.col("word_chars")
    return judged.withColumn("kept", ~F.col("base_failed") & enough).drop("_words", "_lines", "_windows", "_kept")


def verdicts(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "kept_chars", "n_lines", "n_lines_kept",
    )


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS w0, unnest(range(1, len(words) + 1)) AS i FROM d
), v AS (
  SELECT doc_id, i, w0, {", ".join(f"lead(w0, {k}) OVER p AS w{k}" for k in range(1, WINDOW))}
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, {", ".join(f"w{k}" for k in range(WINDOW))}) AS n FROM v WHERE w{WINDOW - 1} IS NOT NULL
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM g WHERE n > 1) GROUP BY doc_id
), k AS (
  SELECT d.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
         list_filter(lines, lambda x: NOT (regexp_matches(x, '{_sql(NAVIGATION)}') OR regexp_matches(x, '{_sql(BOILERPLATE)}')
           OR NOT regexp_matches(x, '{_sql(SENTENCE_END)}')
           OR len(regexp_extract_all(x, '{_sql(MARKED_WORD)}')) * 5 > len(regexp_extract_all(x, '[\x20\x09-\x0D]+')) + 1)) AS kept_lines
  FROM d LEFT JOIN r USING (doc_id)
), m AS (
  SELECT *, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(array_to_string(kept_lines, ''), '[\x20\x09-\x0D]', '', 'g')) AS kept_chars,
         (len(words) < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * len(words)) AS base_failed
  FROM k
)
SELECT doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND 100 * (word_chars - kept_chars) <= {MAX_LOST_PERCENT} * word_chars) AS kept,
       kept_chars::BIGINT AS kept_chars, len(lines)::BIGINT AS n_lines, len(kept_lines)::BIGINT AS n_lines_kept
FROM m
"""
