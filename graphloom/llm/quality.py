"""Quality rules: one table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were which will with "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "con del el ella es las los no para por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= ratio <= high; a bound of None is open."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: The production table; ratios are those of `ratios`.
RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.3),
    Rule("words_per_line", 2.0, None),
)
#: The table of the pipeline: repeated lines weigh by their words, as one short line in three is no fault of a long text.
CORPUS_RULES = tuple(Rule("dup_word_share", None, 0.3) if r.ratio == "dup_line_share" else r for r in RULES)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the counts that the rules are made from, one row per input row.

    Words are runs of anything but ASCII white space. A null text counts as an empty one: all counts 0. Texts are
    read whole; equal rows give equal results; other columns of `docs` are not looked at. Repeated three-word windows
    are told apart by their 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    words = start.select(
        "id",
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    counted = words.select(
        "id",
        "n_symbols",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("lines") > F.size(F.array_distinct("lines")), n - _n_words(F.array_distinct("lines"))).otherwise(0).cast("long").alias("n_dup_words"),
        F.size(F.filter("w", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.when(n >= 3, F.sort_array(_windows(F.col("w"), n))).alias("g"),
    )
    # a row number is never computed anew, so a filter on what follows stays above and doesn't copy all this into itself
    starts = counted.select("*", F.sort_array(_repeated(F.col("g"))).alias("starts"), F.monotonically_increasing_id().alias("at"))
    return starts.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.when(F.col("at") >= 0, _covered(F.col("starts"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
        "n_dup_words",
        "n_stop",
    )


def _n_words(lines: Column) -> Column:
    return F.size(F.filter(F.split(F.array_join(lines, "\n"), SPACE), lambda w: w != ""))


def _windows(w: Column, n: Column) -> Column:
    """(hash, place) of every three words in a row."""
    at = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    return F.slice(at, F.lit(1), n - 2)


def _repeated(g: Column) -> Column:
    """Places of the windows whose hash has an equal neighbour in the sorted array."""
    same = F.filter(g, lambda x, i: (x["h"] == F.get(g, i - 1)["h"]) | (x["h"] == F.get(g, i + 1)["h"]))
    return F.transform(same, lambda x: x["p"])


def _covered(starts: Column) -> Column:
    """How many words lie in a window of three from one of the sorted places."""
    gaps = F.zip_with(
        F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))),
        F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))),
        lambda b, a: F.least(b - a, F.lit(3)),
    )
    total = F.aggregate(gaps, F.lit(3), lambda x, y: x + y)
    return F.when(F.size(starts) > 0, total).otherwise(0)


def ratios() -> dict[str, Column]:
    """The ratios that a rule may name, over the columns of `measures`; 0 where there is nothing to divide by."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    n = F.col("n_words")
    return {
        "mean_word_chars": share(F.col("word_chars"), n),
        "symbols_per_word": share(F.col("n_symbols"), n),
        "stop_word_share": share(F.col("n_stop"), n),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "dup_word_share": share(F.col("n_dup_words"), n),
        "words_per_line": share(n, F.col("n_lines")),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression."""
    known, passed = ratios(), F.lit(True)
    for r in rules:
        if r.low is not None:
            passed = passed & (known[r.ratio] >= r.low)
        if r.high is not None:
            passed = passed & (known[r.ratio] <= r.high)
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`measures` with base_failed (too short or too repetitive) and kept (base and every rule passed).

    Null and empty texts fail the base rule. One row per input row; no shuffle.
    """
    m = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with all their columns."""
    return quality_rules(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), rules, "row").where("kept").select("row.*")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(docs).select(*cols)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda s: s IN ({_STOPS}))) AS n_stop
      FROM x LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.3 AND n_words / n_lines >= 2 AS kept
FROM b
"""
