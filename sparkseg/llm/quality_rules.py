"""Quality rules: one projection of length, symbol, stop-word, line and repetition figures, compared with a table of thresholds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "with", "de", "la", "que", "el", "en", "las", "por", "para", "le", "les", "et", "des", "pour", "der", "die", "und", "den", "von", "mit", "ist")
#: Taken off both ends of a word before it is compared with the stop words.
PUNCTUATION = ".,;:!?()[]\""
LETTER = r"\p{L}"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails a text of at least `words` words unless low <= 100 * part / whole <= high; a bound of None holds always."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    words: int = 1


#: Ratios are per hundred, of whole numbers, so that every engine agrees on them.  Word length, words with a
#: letter and repeated lines have the bounds of published filters; symbols and stop words were set so that labelled good texts pass.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols", "n_symbols", "word_chars", None, 5),
    Rule("letter_words", "n_letter_words", "n_words", 80, None),
    Rule("stop_words", "n_stop_words", "n_words", 5, 60, 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30, 40),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a lambda's variable can't be copied into the places of its use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in windows that are found twice or more in the text."""
    n = F.size(words)

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.when(j + 1 < F.size(places), F.least(F.lit(WINDOW), F.get(places, j + 1) - p)).otherwise(WINDOW))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))
    return F.when(n >= WINDOW, some).otherwise(F.lit(0).cast("long"))


def _figures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.btrim(F.lower(x), F.lit(PUNCTUATION)).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(LETTER))).cast("long").alias("n_letter_words"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return F.struct(of_words.alias("w"), symbols.alias("n_symbols"), counted.alias("l"))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the struct `quality`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_letter_words, base_failed, failed, kept.

    base_failed is n_words < 20 or 100 * n_repeat_words > 30 * n_words.  failed names the rules of the table
    that a text breaks; kept is that neither holds.  A null or empty text has no words and fails.  A ratio of
    an empty whole breaks no rule.  Repeated rows are judged alike, a column `quality` is replaced, and
    all other columns stay.  Everything is a column expression of the row: no shuffle, no user function.
    """
    q = docs.withColumn("quality", _figures(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    value = {x: F.col(f"quality.w.{x}") for x in ("n_words", "word_chars", "n_stop_words", "n_letter_words", "n_repeat_words")} | {"n_symbols": F.col("quality.n_symbols")} | {x: F.col(f"quality.l.{x}") for x in ("n_lines", "n_dup_lines")}
    broken = []
    for rule in rules:
        part, whole = value[rule.part] * 100, value[rule.whole]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (part < whole * rule.low)
        if rule.high is not None:
            bad = bad | (part > whole * rule.high)
        broken.append(F.when((whole > 0) & (value["n_words"] >= rule.words) & bad, F.lit(rule.name)))
    base = (value["n_words"] < 20) | (value["n_repeat_words"] * 100 > value["n_words"] * 30)
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    order = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words")
    return q.withColumn("quality", F.struct(*(value[x].alias(x) for x in order), base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *(f"quality.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BROKEN = " OR ".join(
    f"n_words >= {r.words} AND ({' OR '.join([f'100 * {r.part} < {r.low} * {r.whole}'] * (r.low is not None) + [f'100 * {r.part} > {r.high} * {r.whole}'] * (r.high is not None))})" for r in RULES
)
ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT *, row_number() OVER () AS r, CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i+7], ' ')) ELSE [] END AS grams FROM w),
p AS (SELECT r, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM p) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM t, range(8) k(o) GROUP BY r),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(len(list_filter(words, lambda x: trim(lower(x), '{PUNCTUATION}') IN ({_STOP}))) AS BIGINT) AS n_stop_words,
      CAST(len(list_filter(words, lambda x: regexp_matches(x, '{LETTER}'))) AS BIGINT) AS n_letter_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM g LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BROKEN}) AS kept FROM b
"""
