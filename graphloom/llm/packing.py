"""Best-fit packing of token pieces into sequences, in bulk-synchronous steps: sort, sweep, match by rank, update gaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .tokens import give_back, slices, word_encoder

MAX_TOKENS = 4096
END_ID = 1
#: Pieces of at most so many tokens are one class.
SMALL = 128
#: Pieces and slots of a range, and the least number of ranges.
ROWS_PER_RANGE, MIN_RANGES = 500_000, 8
#: A class's last pieces, of so many one, join the next class.
REST = 4
#: Text that is encoded at once.
BYTES_AT_ONCE = 4 << 20


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """id_col, piece, start, length and ids_crc32 of every piece of every document.

    A document is its text's ids and end_id; only longer ones than max_tokens are cut. A null text counts as empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for part in (p for b in batches for p in slices(b, "text", BYTES_AT_ONCE)):
            rows, cols = [], ([], [], [], [])
            sizes, every = encoder.encode_all(part.column("text"))
            ends = np.cumsum(sizes)
            for i, (a, z) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                ids = np.append(every[a:z], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), max_tokens)):
                    piece = ids[start : start + max_tokens]
                    rows.append(i)
                    for col, x in zip(cols, (k, start, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
        give_back()

    start = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = start.schema["id"].dataType.simpleString()
    return start.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of slots and pieces, from the largest down: each piece takes the last slot that stands free.

    That is the smallest slot that holds it and that no larger piece has taken. What stays free or finds none here comes
    out with its rank, pieces from the first on and slots from the last.
    """
    slots: list[int] = []
    left: tuple[list[int], list[int]] = ([], [])
    part = 0

    def out(role: int, uid: list[int], length: list[int], seq: list[int], rank: list[int]) -> pa.RecordBatch:
        n = len(rank)
        kinds = [pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([*kinds, *(pa.array(x, pa.int64()) for x in (uid, length, seq, rank))], ["part", "role", "uid", "length", "seq", "rank"])

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column("part")[0].as_py()
        placed: tuple[list[int], list[int], list[int]] = ([], [], [])
        for key, is_piece, name in zip(b.column("key").to_pylist(), b.column("is_piece").to_pylist(), b.column("name").to_pylist(), strict=True):
            if not is_piece:
                slots.append(name)
            elif slots:
                for col, x in zip(placed, (name, key, slots.pop()), strict=True):
                    col.append(x)
            else:
                left[0].append(name)
                left[1].append(key)
        yield out(0, *placed, [0] * len(placed[0]))
    yield out(1, *left, [0] * len(left[0]), list(range(len(left[0]))))
    slots.reverse()
    yield out(2, [0] * len(slots), [0] * len(slots), slots, list(range(len(slots))))


def between_ranges(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """How pieces left in a range take slots left in ranges above it, by rank.

    `left` has (pieces, slots) of each range. Rows are (piece's range, first piece, how many, slot's range, first slot).
    """
    free: list[list[int]] = []  # range, slots left, of these taken
    out = []
    for part in sorted(left):
        pieces, slots = left[part]
        first = 0
        while first < pieces and free:
            above, n, taken = free[-1]
            some = min(pieces - first, n - taken)
            out.append((part, first, some, above, taken))
            first, free[-1][2] = first + some, taken + some
            if free[-1][2] == n:
                free.pop()
        if slots:
            free.append([part, slots, 0])
    return out


class _State:
    """Open sequences with their gaps, the steps that have filled them, and a sequence's name still to be given."""

    def __init__(self, gaps: DataFrame, capacity: int):
        self.spark, self.gaps, self.capacity, self.opened = gaps.sparkSession, written(gaps, "gaps"), capacity, 0
        self.steps: list[DataFrame] = []

    def open(self, n: int) -> None:
        """n empty sequences; those that pieces have opened alone are named by the piece, these below zero."""
        new = self.spark.range(-self.opened - n, -self.opened).select(F.col("id").alias("seq"), F.lit(self.capacity).cast("bigint").alias("gap"))
        self.gaps, self.opened = self.gaps.unionAll(new), self.opened + n

    def match(self, todo: DataFrame, n_todo: int, most: int, least: int, n_gaps: int) -> DataFrame:
        """One step: pieces of `least` to `most` tokens take slots, gaps are updated, and what is left comes back.

        A gap that surely holds several of these pieces offers as many slots, though no more than may be of use.
        """
        useful = -(-2 * n_todo // max(n_gaps, 1))
        several = F.greatest(F.least(F.floor(F.col("gap") / most), F.lit(useful)), F.lit(1)).cast("int")
        offered = self.gaps.where(F.col("gap") >= least).withColumn("n", several)
        slots = offered.select(F.floor(F.col("gap") / F.col("n")).alias("key"), F.lit(False).alias("is_piece"), F.explode(F.array_repeat("seq", F.col("n"))).alias("name"))
        items = slots.unionAll(todo.select(F.col("length").alias("key"), F.lit(True).alias("is_piece"), F.col("uid").alias("name")))
        rows = n_todo + min(2 * n_todo + n_gaps, n_gaps * useful)
        n_parts = max(MIN_RANGES, -(-rows // ROWS_PER_RANGE))
        order = (F.desc("key"), F.asc("is_piece"), F.asc("name"))
        ranges = items.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        swept = written(ranges.mapInArrow(_sweep, "part int, role int, uid bigint, length bigint, seq bigint, rank bigint"), "swept")
        left: dict[int, list[int]] = {}
        for r in swept.where("role > 0").groupBy("part", "role").count().collect():  # two rows a range
            left.setdefault(r["part"], [0, 0])[r["role"] - 1] = r["count"]
        joins = between_ranges({k: (p, s) for k, (p, s) in left.items()})
        found, rest = swept.where("role = 0").select("uid", "length", "seq"), swept.where("role = 1")
        if joins:
            plan = np.array(joins, np.int64)
            keys = plan[:, 0] << 40 | plan[:, 1]

            def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    part, rank = b.column("part").to_numpy().astype(np.int64), b.column("rank").to_numpy()
                    row = np.maximum(np.searchsorted(keys, part << 40 | rank, "right") - 1, 0)
                    p = plan[row]
                    has = (p[:, 0] == part) & (rank >= p[:, 1]) & (rank < p[:, 1] + p[:, 2])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("uid"), b.column("length"), pa.array(p[:, 3], mask=~has), pa.array(p[:, 4] + rank - p[:, 1], mask=~has)], ["uid", "length", "above", "at"]
                    )

            asked = rest.mapInArrow(taken, "uid bigint, length bigint, above bigint, at bigint")
            given = swept.where("role = 2").select(F.col("part").cast("bigint").alias("above"), F.col("rank").alias("at"), F.col("seq").alias("given"))
            asked = written(asked.join(given, ["above", "at"], "left"), "taken")
            found = found.unionAll(asked.where("given IS NOT NULL").select("uid", "length", F.col("given").alias("seq")))
            rest = asked.where("given IS NULL")
        used = found.groupBy("seq").agg(F.sum("length").alias("used"))
        gaps = self.gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        self.gaps = written(gaps.where("gap > 0"), "gaps")
        self.steps.append(found.select("uid", "seq"))
        return rest.select("uid", "length")


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """`pieces` (with length from 1 to max_tokens) and their sequence_id and offset.

    Pieces of more than half a sequence open one each. The others are taken in classes of halving length, the longest
    first. A step range-sorts a class's pieces and the gaps that hold some of them, each piece takes the smallest gap
    that no larger piece takes, by a sweep over each range and by rank between ranges; then gaps are updated, and what
    is left takes the next step. Sequences are opened only where the gaps that are left hold too little for the rest of
    a class. What comes to the driver is a count for each class and range. An empty table gives none; equal rows are
    pieces of their own.
    """
    names = [f"`{c}`" for c in pieces.columns]
    kept = written(pieces.select(F.struct(*names).alias("row"), "length", F.monotonically_increasing_id().alias("uid")), "pieces")
    half = max_tokens // 2
    state = _State(kept.where(F.col("length") > half).select(F.col("uid").alias("seq"), (max_tokens - F.col("length")).alias("gap")), max_tokens)
    state.steps.append(kept.where(F.col("length") > half).select("uid", F.col("uid").alias("seq")))
    tops = [half]
    while tops[-1] > SMALL:
        tops.append(tops[-1] // 2)
    stats = (F.count(F.lit(1)), F.sum("length"), F.min("length"), F.max("length"))
    todo = kept.where("1 = 0").select("uid", "length")
    for top, low in zip(tops, [*tops[1:], 0], strict=True):
        todo = todo.unionAll(kept.where((F.col("length") <= top) & (F.col("length") > low)).select("uid", "length"))
        n, tokens, least, most = todo.agg(*stats).first()
        rest = n // REST if low else 0
        while n > rest:
            n_gaps, room = state.gaps.where(F.col("gap") >= least).agg(F.count(F.lit(1)), F.coalesce(F.sum("gap"), F.lit(0))).first()
            more = -(-max(0, tokens - room) // max_tokens)
            if more:
                state.open(more)
            todo = state.match(todo, n, most, least, n_gaps + more)
            n, tokens, least, most = todo.agg(*stats).first()
    places = state.steps[0]
    for s in state.steps[1:]:
        places = places.unionAll(s)
    before = Window.partitionBy("seq").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces, at most max_tokens
    placed = kept.join(places, "uid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("row.*", F.col("seq").alias("sequence_id"), "offset")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
