"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for what they leave open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import mix
from .url_seed import seed_table

#: Most labelled rows that the driver takes to fit the classifier.
MAX_LABELLED = 100_000
BUCKETS = 1 << 14
NGRAMS = (3, 4, 5)
BLOCK_FROM = 0.5
#: Urls that are scored at once.
ROWS_AT_ONCE = 4096

# The rules of the production query, as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed n-grams of hosts and paths, in order; the two are told apart."""
    found = [np.empty(0, np.int64)]
    for mark, texts in ((1, hosts), (2, paths)):
        raw = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        size = np.array([len(x) for x in raw], np.int64)
        room = np.repeat(np.cumsum(size), size) - np.arange(len(data))
        row = np.repeat(np.arange(len(raw)), size)
        for n in NGRAMS:
            at = np.flatnonzero(room >= n)
            key = np.full(len(at), mark << 60 | n << 56, np.uint64)
            for k in range(n):
                key |= data[at + k] << np.uint64(8 * k)
            found.append(row[at] * BUCKETS + (mix(key) % np.uint64(BUCKETS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both // BUCKETS, both % BUCKETS


def fit(labelled: list[tuple[str, str, int]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by gradient descent; the last one is the intercept. Label 1: unwanted.

    An empty table gives all-zero weights but for an intercept that allows everything.
    """
    weights = np.zeros(BUCKETS + 1)
    if not labelled:
        weights[-1] = -1.0
        return weights
    rows = labelled
    at, col = _features([h for h, _, _ in rows], [p for _, p, _ in rows])
    size = 1.0 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(rows))))[at]
    y = np.array([x for _, _, x in labelled], float)
    for _ in range(rounds):
        z = np.bincount(at, weights[col] * size, len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(col, error[at] * size, BUCKETS) / len(rows) * 20
        weights[:-1] -= rate * (grad + l2 * weights[:-1])
        weights[-1] -= rate * error.mean()
    return weights


def scores(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    """Probabilities of unwanted."""
    at, col = _features(hosts, paths)
    n = np.bincount(at, minlength=len(hosts))
    return 1 / (1 + np.exp(-(np.bincount(at, weights[col], len(hosts)) / np.sqrt(np.maximum(1, n)) + weights[-1])))


def url_filter(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """Per input row: id_col, host, path, rule, verdict and score (the classifier's probability of unwanted).

    The longest fitting rule decides, else the classifier; a row that a rule decides has no score. `labelled` has url and
    label (1 unwanted); the classifier is fitted on at most MAX_LABELLED of its rows, the first by url; rows with a null
    are left out. A null url, or one without ://, has an empty host and path; as these tell nothing, it is allowed, and
    has no score. Repeated rows each give a row; other columns of `pages` are not looked at.
    """
    host, path = parts(F.col("url"))
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(host, path, F.col("label").cast("int"), "url")
    weights = fit([tuple(r)[:3] for r in known.orderBy("url", "label").limit(MAX_LABELLED).collect()])
    host, path = parts(F.col(url_col))
    start = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = start.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "fit.rule", "fit.verdict")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = pc.or_(pc.greater(pc.binary_length(b.column("host")), 0), pc.greater(pc.binary_length(b.column("path")), 0))
            open_rows = np.flatnonzero(np.array(pc.and_(b.column("rule").is_null(), said)))
            score, known = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            known[open_rows] = False
            some = b.select(["host", "path"]).take(pa.array(open_rows))
            for a in range(0, len(open_rows), ROWS_AT_ONCE):
                part = some.slice(a, ROWS_AT_ONCE)
                score[open_rows[a : a + ROWS_AT_ONCE]] = scores(part.column("host").to_pylist(), part.column("path").to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, mask=known)], [*b.schema.names, "score"])

    kind = start.schema["id"].dataType.simpleString()
    judged = ruled.mapInArrow(scored, f"id {kind}, host string, path string, rule string, verdict string, score double")
    own = F.when(F.col("score") >= block_from, "block").otherwise("allow")  # of no score, too
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), seed_table(spark))
