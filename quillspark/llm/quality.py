"""Quality rules: one threshold table, compiled into a Spark projection of built-in functions only.

Defined cases: null and empty texts have no words, every count is 0 and base_failed is true; rows that repeat are
judged one by one; ratios over zero words or lines are 0; columns other than doc_id and text are ignored by
``quality_metrics`` and passed through by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import clean_docs, docs_table

#: The commonest function words of the corpus languages (en, fr, de, es).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "on",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "dans", "que", "est", "pour",
    "der", "die", "das", "und", "ein", "den", "von", "zu", "mit", "für", "auf", "ist",
    "el", "los", "las", "y", "en", "por", "con", "una", "del",
)


@dataclass(frozen=True)
class Rule:
    """A document fails when the metric lies outside [low, high]."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are named in ``metrics_of``.
RULES = (
    Rule("mean_word_chars", "mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.2),
    Rule("stop_word_ratio", "stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", "dup_line_ratio", None, 0.6),
)


def word_list(text: Column) -> Column:
    """Words are maximal runs of anything but ASCII white space; a one-character split takes the fast path."""
    return F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first window included.

    Windows are compared by 64-bit hash. Sorted (hash, place) pairs put equal windows side by side; the sorted places of
    those then cover 3 words each, less what the next one covers too. O(n log n) for any number of repeats.
    """
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def twins(sorted_pairs: Column) -> Column:
        same = lambda p, q: F.coalesce(p["g"] == q["g"], F.lit(False))
        return F.filter(sorted_pairs, lambda p, j: same(p, F.get(sorted_pairs, j + 1)) | same(p, F.when(j > 0, F.get(sorted_pairs, j - 1))))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    # let: a one-element array names an expression, so that it is worked out once
    let = lambda value, then: F.transform(F.array(value), then)[0]
    in_order = lambda found: F.array_sort(F.transform(found, lambda p: p["i"]))
    placed = lambda g: F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    repeats = lambda g: let(placed(g), lambda s: let(in_order(twins(s)), covered))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(repeats(g)))


def quality_metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs: the base counts and the ratios that the threshold table names, in one projection."""
    base = clean_docs(docs, *keep).withColumns({"_parts": word_list(F.col("text")), "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    base = base.withColumn("_words", F.filter("_parts", lambda w: w != ""))
    stop = F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS)))
    counts = base.select(
        "doc_id", "text", *keep,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("text") - (F.size("_parts") - 1)).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        stop.cast("long").alias("n_stop_words"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns(
        {
            "mean_word_chars": over("word_chars", "n_words"),
            "symbols_per_word": over("n_symbols", "n_words"),
            "stop_word_ratio": over("n_stop_words", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def fails(rule: Rule) -> Column:
    out = F.lit(False)
    if rule.low is not None:
        out = out | (F.col(rule.metric) < rule.low)
    if rule.high is not None:
        out = out | (F.col(rule.metric) > rule.high)
    return out


def judge(metrics: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds failed_rules (names, in table order) and kept."""
    named = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return metrics.withColumn("failed_rules", named).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns as they were: no shuffle.

    The verdict is a generator's input, not a filter's: a filter would be pushed below the projections that build it, and
    each mention of the word list would be worked out anew.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")  # a text that passes is not null
    whole = docs.select("doc_id", "text", others)
    row = F.struct(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
    return judge(quality_metrics(whole, "_row"), rules).select(F.inline(F.when(F.col("kept"), F.array(row))))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(quality_metrics(docs_table(spark, sf_dir))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda x: x IN ({_STOP_SQL}))) AS n_stop
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 2.0 AND 15.0 AND n_symbols::DOUBLE / n_words <= 0.2
    AND n_stop::DOUBLE / n_words >= 0.01 AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.6) AS kept
FROM b
"""
