"""Benchmark decontamination: an FM-index of each shard is searched backwards for the windows of test items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from .fm_index import FMIndex

WINDOW = 13
#: Items are searched for in blocks of so many words; each block is one more pass over the documents.
BLOCK_WORDS = 2_000_000
#: Words that one shard's index holds at most, but for a single longer text.
SHARD_WORDS = 1_000_000

#: Words are runs of letters, digits and anything beyond ASCII; A-Z become a-z, other ASCII becomes a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Phrases:
    """The distinct windows of a block of items, as numbered words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.patterns = np.zeros((len(owners), window), np.int32)
        for k, x in enumerate(owners):
            self.patterns[k, window - len(x) :] = x
        self.owners = [tuple(x) for x in owners.values()]


class _Lookup(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def search_shard(texts: list[list[bytes]], phrases: Phrases) -> list[tuple[list[int], list[int], set[str]]]:
    """For each text's words: starts and ends of the merged spans that windows cover, and the items found.

    Only runs of at least the shortest window's length, of words that items have, go into the index: nothing else
    can hold a window.
    """
    get = _Lookup(phrases.vocabulary).__getitem__
    least = int(phrases.lengths.min()) if len(phrases.lengths) else 1
    kept, where, doc_of = [], [], []
    for d, words in enumerate(texts):
        ids = np.fromiter(map(get, words), np.int32, len(words))
        edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= least:
                kept += [ids[a:b], [0]]
                where += [np.arange(a, b + 1)]
                doc_of.append((d, b - a + 1))
    out: list[tuple[list[int], list[int], set[str]]] = [([], [], set()) for _ in texts]
    if not kept or not len(phrases.lengths):
        return out
    seq, place = np.concatenate(kept).astype(np.int32), np.concatenate(where)
    doc = np.repeat([d for d, _ in doc_of], [n for _, n in doc_of])
    index = FMIndex(seq, len(phrases.vocabulary))
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(lo < hi)
    counts = (hi - lo)[found]
    which = np.repeat(found, counts)
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    at = index.locate(rows)
    order = np.lexsort((place[at], doc[at]))
    which, d, a = which[order], doc[at][order], place[at][order]
    for k in np.unique(d * len(phrases.owners) + which):
        out[k // len(phrases.owners)][2].update(phrases.owners[k % len(phrases.owners)])
    for i, start, end in zip(d.tolist(), a.tolist(), (a + phrases.lengths[which]).tolist(), strict=True):
        starts, ends, _ = out[i]
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size, first = [], 0, True
    rows = benchmark.select(F.col(item_col).cast("string"), text_col).where(F.col(item_col).isNotNull())
    for item, text in rows.toLocalIterator():
        if words := fold_words(text):
            block.append((item, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size, first = [], 0, False
    if block or first:
        yield block


def contamination_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per input row: id_col, n_words, starts and ends (word places of removal spans, merged), items (sorted strings).

    A document word is inside a span when it lies in an occurrence of `window` consecutive words of an item (of the
    whole item if that has fewer). Null and empty texts have no words and no spans; items without words or without an
    id are never found; items that share an id count once; repeated rows each give a row. Items are read in blocks of
    `block_words`, and each block's spans are written before the next but one is read, so driver and tasks hold two
    blocks at most; more than one block costs a pass each and one shuffle to merge.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    many = second is not None
    if many:
        source = source.withColumn("row", F.xxhash64("id", "text"))

    def scan(phrases: Phrases):
        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, size, first = [], 0, 0
                for i, text in enumerate(batch.column("text")):
                    texts.append(fold_words(text.as_py()))
                    size += len(texts[-1])
                    if size >= SHARD_WORDS or i == batch.num_rows - 1:
                        found = search_shard(texts, phrases)
                        part = batch.slice(first, len(texts))
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(part.column(c) for c in part.schema.names if c != "text"),
                                pa.array([len(t) for t in texts], pa.int64()),
                                pa.array([x[0] for x in found], pa.list_(pa.int64())),
                                pa.array([x[1] for x in found], pa.list_(pa.int64())),
                                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                            ],
                            [*(c for c in part.schema.names if c != "text"), "n_words", "starts", "ends", "items"],
                        )
                        texts, size, first = [], 0, i + 1

        return shards

    schema = f"id {kind.simpleString()}, " + "row bigint, " * many + "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"
    every, n_blocks = source.mapInArrow(scan(Phrases(first, window)), schema), 1
    if not many:
        return every.withColumnRenamed("id", id_col)
    del first
    every = written(every, "spans")
    for block in chain([second], blocks):
        every, n_blocks = every.unionAll(written(source.mapInArrow(scan(Phrases(block, window)), schema), "spans")), n_blocks + 1
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    start = F.struct(F.array().cast("array<struct<starts:bigint,ends:bigint>>").alias("done"), F.lit(None).cast("struct<starts:bigint,ends:bigint>").alias("open"))
    merged = F.aggregate(
        spans,
        start,
        lambda acc, x: F.when(
            acc["open"].isNotNull() & (x["starts"] <= acc["open"]["ends"]),
            F.struct(acc["done"].alias("done"), F.struct(acc["open"]["starts"].alias("starts"), F.greatest(acc["open"]["ends"], x["ends"]).alias("ends")).alias("open")),
        ).otherwise(
            F.struct(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), x.alias("open"))
        ),
        lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
    )
    # equal rows come back once for each block and copy; each copy keeps its row
    back = every.groupBy("id", "row").agg(
        F.max("n_words").alias("n_words"),
        merged.alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"),
    )
    back = back.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return back.select(F.col("id").alias(id_col), "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items")



def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """Digests of `contamination_spans`: n_words, n_hit, n_items, items_sha256 and contaminated, one row per input row."""
    spans = contamination_spans(docs, benchmark, **columns)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return spans.select(
        columns.get("id_col", "doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, list_aggregate(w[i:i + least(len(w), 13) - 1], 'string_agg', ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT DISTINCT r, i, k, item FROM dw JOIN bw USING (k, g)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, k)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
