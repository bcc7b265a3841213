"""Substring dedup by fixed-block anchors.

Non-overlapping blocks of half a window are the index; every rolling window of a block's width probes it. Any window
that repeats holds a whole block of its own text and a probe that meets a block of the other, so only windows with a
hit can repeat. Runs of hits are extended to exact repeats by an 80-bit fingerprint of each whole window in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .exchange import CHUNK_BYTES, bits, bucket_ends, chunked, contains, distinct_sorted, in_order, pack5, rolling, unbits, unpack5

WINDOW = 35
_BLOBS = "bucket int, chunk bigint, n int, values binary, flags binary"
_MASKS = "kind int, bucket int, chunk bigint, n int, hits binary"


class _Words:
    """A chunk's words as hashes, text after text."""

    def __init__(self, table: pa.Table, keep_words: bool = False):
        self.words, sizes, hashes = [], [], []
        for text in table.column("text"):
            raw = text.as_py()
            words = raw.encode("utf-8").split() if raw else []
            sizes.append(len(words))
            hashes.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
            if keep_words:
                self.words.append(words)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = np.concatenate([*hashes, np.empty(0, np.uint64)])
        #: How far each word is from its text's start, and from its end.
        self.place = np.arange(len(self.hashes)) - np.repeat(self.ends - self.sizes, self.sizes)
        self.room = np.repeat(self.sizes, self.sizes) - self.place

    def windows(self, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that lie within one text."""
        h = rolling(self.hashes, width, base)
        starts = np.flatnonzero(self.room[: len(h)] >= width)
        return starts, h[starts]


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _blob_table(chunk: int, values: np.ndarray, n_buckets: int, pack, flags: list[np.ndarray]) -> pa.Table:
    ends = bucket_ends(values, n_buckets)
    spans = [(b, a, z) for b, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
            "chunk": pa.array([chunk] * len(spans), pa.int64()),
            "n": pa.array([z - a for _, a, z in spans], pa.int32()),
            "values": pa.array([pack(a, z) for _, a, z in spans], pa.binary()),
            "flags": pa.array([b"".join(bits(f[a:z]) for f in flags) for _, a, z in spans], pa.binary()),
        }
    )


def _probes(words: _Words, block: int):
    """(starts and hashes of the block-wide windows, their sorted distinct hashes, which of these repeat or are blocks)."""
    starts, h = words.windows(block, _BASES[0])
    values, first = distinct_sorted(h)
    many = np.diff(np.append(first, len(h))) > 1
    return starts, h, values, many


def _whole(words: _Words, window: int, block: int, hits: np.ndarray):
    """(starts, first and second hashes) of whole windows with a hit in them."""
    starts, h = words.windows(window, _BASES[1])
    seen = np.concatenate([[0], np.cumsum(np.bincount(hits, minlength=len(words.hashes)))])
    with_hit = seen[starts + window - block + 1] > seen[starts]
    starts, h = starts[with_hit], h[with_hit]
    return starts, h


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per input row: id_col, n_words, n_removed and kept, its words but those that a repeated window covers.

    Words are runs of anything but ASCII white space; a window is `window` consecutive words of one text, and repeats
    if its words also start anywhere else, in the same text too; all are judged on the input. `kept` is the words that
    stay, joined by one space. A null text has no words, and texts shorter than a window lose none. Repeated rows and
    ids are rows of their own, so copies of a long enough text all go. Other columns of
    `docs` are not looked at; those named in `carry` come back in a struct of that name.
    """
    block = max(1, (window + 1) // 2)
    start, n_buckets = chunked(docs, id_col, text_col, chunk_bytes, carry)
    by_chunk = start.groupBy("chunk")

    def probe(key, table):
        words = _Words(in_order(table))
        starts, h, values, many = _probes(words, block)
        is_block = contains(distinct_sorted(h[words.place[starts] % block == 0])[0], values)
        return _blob_table(key[0].as_py(), values, n_buckets, lambda a, z: pack5(values[a:z]), [many, is_block])

    def meet(kind: int, unpack, blocks: bool):
        def reduce(key, table):
            n = table.column("n").to_numpy()
            values = np.concatenate([unpack(v.as_py()) for v in table.column("values")])
            flags = [v.as_py() for v in table.column("flags")]
            width = [(k + 7) // 8 for k in n.tolist()]
            many = np.concatenate([unbits(f[:w], k) for f, w, k in zip(flags, width, n, strict=True)])
            order = np.argsort(values, kind="stable")
            v = values[order]
            new = np.concatenate([[True], v[1:] != v[:-1]])
            group = np.cumsum(new) - 1
            times = np.bincount(group, 1 + many[order])
            hit = times > 1
            if blocks:
                is_block = np.concatenate([unbits(f[w:], k) for f, w, k in zip(flags, width, n, strict=True)])
                hit &= np.bincount(group, is_block[order]) > 0
            out = np.empty(len(v), bool)
            out[order] = hit[group]
            ends = np.cumsum(n)
            some = np.array([out[e - k : e].any() for e, k in zip(ends, n, strict=True)])
            at = np.flatnonzero(some)
            return pa.table(
                {
                    "kind": pa.array([kind] * len(at), pa.int32()),
                    "bucket": table.column("bucket").take(at),
                    "chunk": table.column("chunk").take(at),
                    "n": table.column("n").take(at),
                    "hits": pa.array([bits(out[ends[i] - n[i] : ends[i]]) for i in at], pa.binary()),
                }
            )

        return reduce

    def hit_values(values: np.ndarray, masks: pa.Table, kind: int) -> np.ndarray:
        """The chunk's values that the buckets found again."""
        ends, keep = bucket_ends(values, n_buckets), np.zeros(len(values), bool)
        for row in masks.select(["kind", "bucket", "n", "hits"]).to_pylist():
            if row["kind"] == kind:
                a = ends[row["bucket"]]
                keep[a : a + row["n"]] = unbits(row["hits"], row["n"])
        return values[keep]

    def candidates(words: _Words, masks: pa.Table):
        starts, h, values, _ = _probes(words, block)
        hits = starts[contains(hit_values(values, masks, 0), h)]
        return _whole(words, window, block, hits)

    def extend(key, left, masks):
        if not left.num_rows or not masks.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _arrow(_BLOBS)})
        words = _Words(in_order(left))
        starts, h = candidates(words, masks)
        order = np.argsort(h, kind="stable")
        h, starts = h[order], starts[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        many = np.diff(np.append(first, len(h))) > 1
        values = h[first]
        second = rolling(words.hashes, window, _BASES[2])[starts[first]]
        low = values.astype("<u8")
        extra = (second >> np.uint64(48)).astype("<u2")
        return _blob_table(key[0].as_py(), values, n_buckets, lambda a, z: low[a:z].tobytes() + extra[a:z].tobytes(), [many])

    def unpack10(data: bytes) -> np.ndarray:
        n = len(data) // 10
        out = np.empty(n, [("a", "<u8"), ("b", "<u2")])
        out["a"], out["b"] = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u2", n, 8 * n)
        return out

    def finish(key, left, masks):
        left = in_order(left)
        words = _Words(left, keep_words=True)
        gone = np.zeros(len(words.hashes) + 1, np.int64)
        if masks.num_rows:
            starts, h = candidates(words, masks)
            again = starts[contains(hit_values(distinct_sorted(h)[0], masks, 1), h)]
            np.add.at(gone, again, 1)
            np.add.at(gone, again + window, -1)
        stays = np.cumsum(gone[:-1]) == 0
        kept, removed = [], []
        for w, end in zip(words.words, words.ends, strict=True):
            mine = stays[end - len(w) : end]
            removed.append(len(w) - int(mine.sum()))
            kept.append(b" ".join(w if not removed[-1] else [w[i] for i in np.flatnonzero(mine)]))
        out = pa.table(
            {"id": left.column("id"), "n_words": pa.array(words.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        )
        return out.append_column("carry", left.column("carry")) if carry else out

    blocks = by_chunk.applyInArrow(probe, _BLOBS)
    near = blocks.groupBy("bucket").applyInArrow(meet(0, unpack5, True), _MASKS)
    whole = by_chunk.cogroup(near.groupBy("chunk")).applyInArrow(extend, _BLOBS)
    again = whole.groupBy("bucket").applyInArrow(meet(1, unpack10, False), _MASKS)
    kind = start.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept string" + (f", carry {start.schema['carry'].dataType.simpleString()}" if carry else "")
    done = by_chunk.cogroup(near.unionAll(again).groupBy("chunk")).applyInArrow(finish, schema)
    return done.withColumnRenamed("id", id_col)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
x AS (SELECT DISTINCT r, i + j AS i FROM h, (SELECT unnest(range(0, 35)) AS j)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
      FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN x USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
