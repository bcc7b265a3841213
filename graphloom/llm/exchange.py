"""Documents in chunks of a stated number of bytes, and packed fingerprints dealt to buckets by value.

A fingerprint table has, for each chunk and bucket, one row with the chunk's sorted distinct values in that range. A
value that a third of all documents share is thus one value for each chunk, and answers go back as one bit or one count
for each value, in the same order.

Chunks and buckets are as large as a task's memory allows, so their numbers grow with the corpus and a packed row's size
shrinks with it; on executors with more memory both sizes should be larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk on average; one task holds it at once with some arrays of as many words.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose fingerprints a bucket holds on average, and the least number of buckets.
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 8
#: What a row counts for besides its text.
ROW_BYTES = 64


def chunked(
    docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, int]:
    """(chunk, id, text) of every row, with a struct of the columns to carry if any, and the number of buckets.

    The chunk depends on id and text alone. A text longer than a chunk stands with few others.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + ROW_BYTES)).first()[0] or 0
    n, n_buckets = max(1, math.ceil(size / chunk_bytes)), max(MIN_BUCKETS, math.ceil(size / bucket_bytes))
    start = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("carry")] if carry else []))
    return start.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("bigint").alias("chunk"), "*"), n_buckets


def in_order(table):
    """A chunk's rows, in the same order whenever it is read."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def bucket_ends(values: np.ndarray, n: int) -> list[int]:
    """n + 1 places that cut sorted uint64 values into n ranges of equal width."""
    edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return [0, *np.searchsorted(values, edges).tolist(), len(values)]


def distinct_sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and where each one's run starts in the sorted values."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], first


def contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pack5(values: np.ndarray) -> bytes:
    """Bits 16 to 55 of the values; with the bucket's range these tell about 48 bits and more apart."""
    low = (values >> np.uint64(16)).astype("<u4")
    return low.tobytes() + (values >> np.uint64(48)).astype(np.uint8).tobytes()


def unpack5(data: bytes) -> np.ndarray:
    n = len(data) // 5
    low = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return low | np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Mixed hash of every `width` consecutive values, modulo 2**64; shorter input gives none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        total, span, at = h, 1, 0  # total: hashes of `span` values; the width is summed from its binary digits
        rest, power = width, np.uint64(base)
        while rest:
            if rest & 1:
                out = out * power + total[at : at + n]
                at += span
            rest >>= 1
            if rest:
                total = total[:-span] * power + total[span:]
                power = power * power
                span *= 2
        return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte for each count below 255, nine for larger ones."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return np.uint32(len(counts)).tobytes() + low.tobytes() + counts[low == 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The counts that start at a place of the data, and the place behind them."""
    n = int(np.frombuffer(data, "<u4", 1, at)[0])
    low = np.frombuffer(data, np.uint8, n, at + 4)
    out, large = low.astype(np.int64), low == 255
    m, at = int(large.sum()), at + 4 + n
    out[large] = np.frombuffer(data, "<u8", m, at)
    return out, at + 8 * m


def pack_keys(values: np.ndarray) -> bytes:
    """The top 56 bits of sorted distinct values: 24 as steps, mostly a byte each, and four bytes of the rest."""
    step = np.diff((values >> np.uint64(40)).astype(np.int64), prepend=0)
    low = np.minimum(step, 255).astype(np.uint8)
    rest = (values >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    return np.uint32(len(values)).tobytes() + low.tobytes() + step[low == 255].astype("<u4").tobytes() + rest


def unpack_keys(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    low = np.frombuffer(data, np.uint8, n, 4)
    step, large = low.astype(np.int64), low == 255
    m, at = int(large.sum()), 4 + n
    step[large] = np.frombuffer(data, "<u4", m, at)
    return np.cumsum(step).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", n, at + 4 * m).astype(np.uint64)


def bundled(rows: DataFrame) -> DataFrame:
    """(chunk, data): rows that have a column `chunk`, those of one chunk together and compressed; see `unbundled`."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            first = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            out = []
            for a, z in zip(first, np.append(first[1:], len(order)), strict=True):
                sink = pa.BufferOutputStream()
                part = b.take(pa.array(order[a:z]))
                with pa.ipc.new_stream(sink, part.schema, options=codec) as w:
                    w.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order[first]]), pa.array(out, pa.binary())], ["chunk", "data"])

    return rows.mapInArrow(bundle, "chunk bigint, data binary")


def unbundled(table: pa.Table) -> pa.Table:
    """The rows of a chunk, in the same order whenever they are read."""
    return in_order(pa.concat_tables(pa.ipc.open_stream(x.as_py()).read_all() for x in table.column("data")))
