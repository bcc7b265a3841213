"""LM scoring by a probabilistic suffix tree over words.

The root is the smoothed unigram distribution. A context of one to `max_depth` words is a node if it occurs often enough
in the training texts and its next words, each judged without itself, are likelier under the node than under its parent,
the context without its first word (the divergence test). A word's probability comes from the longest node that ends its
history; each context's distribution is smoothed towards its parent's by its number of distinct next words.

All counts are taken over all training texts: chunks send their distinct events to buckets of event hashes, and get
the totals back in the same order. An event whose shorter one, without the first word, or whose context stands in one
chunk alone can stand nowhere else, so that chunk counts it for itself; one whose shorter one is in no training text is
in none. Words and sequences of words are told apart by hashes, in buckets by 56 bits of them.
A bucket numbers its events that can be contexts, and chunks send what they know about contexts under these numbers, as
steps from one to the next; a context of one chunk alone is judged there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import bits, bucket_ends, bundled, chunked, mix, pack_counts, pack_keys, unbits, unbundled, unpack_counts, unpack_keys
from .words import word_hashes

#: Words of a context at most.
MAX_DEPTH = 3
#: A context needs so many training occurrences, at any size of corpus, and so much gain an occurrence in natural
#: logarithm.
MIN_CONTEXT = 16
MIN_GAIN = 0.01

#: More than elsewhere: the fewer the chunks, the fewer the events that several of them send.
CHUNK_BYTES = 8 << 20

_END = np.uint64(0x1D8AF066F2D1C3A5)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOBS = "level int, bucket int, chunk bigint, keys binary, data binary"
_ANSWERS = "chunk bigint, level int, bucket int, data binary, tokens bigint, known bigint"


def counts_level(depth: int) -> int:
    """The number of the exchange that counts words after contexts of `depth` words."""
    return 2 * depth


def context_level(depth: int) -> int:
    """The number of the exchange that judges contexts of `depth` words."""
    return 2 * depth + 1


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct uint64 values, and where each value is among them, as `np.unique` has them.

    Places take the low bits of what is sorted. Where the high bits do not tell two values apart, `np.unique` does it.
    """
    shift = np.uint64(len(values).bit_length())
    keys = values >> shift << shift | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    at = (keys & (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64)
    ordered = values[at]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(values, return_inverse=True)
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    where = np.empty(len(values), np.int64)
    where[at] = np.cumsum(first) - 1
    return ordered[first], where


def squeeze(packed: bytes) -> bytes:
    """What `pack_counts` or `pack_keys` made, or a number of bytes and these, with those bytes compressed where that is shorter."""
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    low = packed[4 : 4 + n]
    short = pa.compress(low, codec="zstd", asbytes=True) if n else low
    short = short if len(short) < n else low
    return np.array([n, len(short), len(packed) - 4 - n], "<u4").tobytes() + short + packed[4 + n :]


def stretch(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """What `squeeze` got, and the place behind it."""
    n, short, rest = (int(x) for x in np.frombuffer(data, "<u4", 3, at))
    low, at = data[at + 12 : at + 12 + short], at + 12 + short
    low = low if short == n else pa.decompress(low, n, codec="zstd", asbytes=True)
    return np.uint32(n).tobytes() + low + data[at : at + rest], at + rest


def pack(counts: np.ndarray) -> bytes:
    return squeeze(pack_counts(counts))


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    raw, at = stretch(data, at)
    return unpack_counts(raw)[0], at


def pack_bytes(raw: bytes) -> bytes:
    return squeeze(np.uint32(len(raw)).tobytes() + raw)


def unpack_bytes(data: bytes, at: int = 0) -> tuple[bytes, int]:
    raw, at = stretch(data, at)
    return raw[4:], at


class _Places:
    """The places of a chunk that follow a context of some depth, and the sequences of context and word there."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None, sequence: np.ndarray, known: np.ndarray | None = None):
        #: Token numbers, and for each the place, one level up, of the last word of its context.
        self.at, self.before = at, before
        self.events, self.event = distinct(sequence)
        #: Events that other chunks may have in training too.
        self.shared = np.ones(len(self.events), bool)
        if known is not None:
            self.shared[self.event] = ~known
        self.n = self.first_here = self.alone = self.several = np.empty(0)


class _Chunk:
    """A chunk's words and ends as hashes, and the totals that have come back for them."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, least: int):
        sizes, hashes = word_hashes([(t.as_py() or "").encode("utf-8") for t in table.column("text")])
        self.sizes, self.least = sizes + 1, least
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.h = np.full(int(self.sizes.sum()), _END)
        is_word = np.ones(len(self.h), bool)
        is_word[self.starts + sizes] = False
        self.h[is_word] = hashes
        self.train = np.repeat(~table.column("held").to_numpy(), self.sizes)
        self.answers: dict[int, dict[int, bytes]] = {}
        if answers is not None:
            for level, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "data")), strict=True):
                self.answers.setdefault(level, {})[bucket] = data
            # every chunk has an end, so it always has an answer about words
            words = answers.slice(answers.column("level").to_pylist().index(0), 1)
            self.tokens, self.z = words.column("tokens")[0].as_py(), words.column("tokens")[0].as_py() + 0.5 * (words.column("known")[0].as_py() + 1)

    def _back(self, level: int, n_flags: int) -> tuple[np.ndarray, ...]:
        """Counts and flags that have come back for a level's values, in their order."""
        columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)], *([np.empty(0, bool)] for _ in range(n_flags))]
        for _, data in sorted(self.answers.get(level, {}).items()):
            n, at = unpack(data)
            columns[0].append(n)
            for k in range(n_flags):
                flags, at = unpack_bytes(data, at)
                columns[1 + k].append(unbits(flags, len(n)))
        return tuple(np.concatenate(c) for c in columns)

    def _numbers(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the events that occur often enough and stand in several chunks, and their numbers there, in their order."""
        buckets, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for bucket, data in sorted(self.answers.get(level, {}).items()):
            at = 0
            for _ in range(3):
                at = stretch(data, at)[1]
            steps, _ = unpack(data, at)
            numbers.append(np.cumsum(steps))
            buckets.append(np.full(len(steps), bucket))
        return np.concatenate(buckets), np.concatenate(numbers)

    def own(self, places: _Places) -> np.ndarray:
        """How often each event stands in this chunk's training texts."""
        return np.bincount(places.event, self.train[places.at], len(places.events)).astype(np.int64)

    def words(self) -> _Places:
        return _Places(np.arange(len(self.h)), None, self.h)

    def counted(self, places: _Places, depth: int) -> _Places:
        n = self.own(places)
        places.first_here, places.alone = n > 0, np.ones(len(n), bool)
        n[places.shared], places.first_here[places.shared], places.alone[places.shared] = self._back(counts_level(depth), 2)
        places.several = (n >= self.least) & ~places.alone
        places.n = n[places.event].astype(float)
        return places

    def longer(self, places: _Places) -> _Places:
        """Places whose context is a sequence of `places` that occurs often enough."""
        where = np.full(len(self.h), -1)
        where[places.at] = np.arange(len(places.at))
        before = np.concatenate([[-1], where[:-1]])
        before[self.starts] = -1
        at = np.flatnonzero(before >= 0)
        at = at[places.n[before[at]] >= self.least]
        before, shorter = before[at], where[at]
        context = places.event[before]
        # in this chunk alone, or never in training, as is all that holds it
        known = places.alone[places.event[shorter]] | places.alone[context] | (places.n[shorter] == 0)
        with np.errstate(over="ignore"):
            return _Places(at, before, mix(places.events[context] * _STEP + self.h[at]), known)

    def blobs(self, chunk: int, level: int, ends: list[int], keys: Callable[[int, int], bytes], data: Callable[[int, int], bytes]) -> pa.Table:
        spans = [(b, a, z) for b, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]
        return pa.table(
            {
                "level": pa.array([level] * len(spans), pa.int32()),
                "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
                "chunk": pa.array([chunk] * len(spans), pa.int64()),
                "keys": pa.array([keys(a, z) for _, a, z in spans], pa.binary()),
                "data": pa.array([data(a, z) for _, a, z in spans], pa.binary()),
            }
        )

    def ask_counts(self, chunk: int, depth: int, places: _Places, n_buckets: int) -> pa.Table:
        n, events = self.own(places)[places.shared], places.events[places.shared]
        ends = bucket_ends(events, n_buckets)
        return self.blobs(chunk, counts_level(depth), ends, lambda a, z: squeeze(pack_keys(events[a:z])), lambda a, z: pack(n[a:z]))

    def contexts(self, places: _Places, parents: _Places) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts, as places among the parents' events, and the context of each place."""
        of_place = parents.event[places.before]
        used = np.zeros(len(parents.events), bool)
        used[of_place] = True
        return np.flatnonzero(used), (np.cumsum(used) - 1)[of_place]

    def sums(self, places: _Places, p: np.ndarray, context: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums over this chunk's training occurrences by context, for `_judge`: occurrences, gain, single and types of some contexts."""
        some = np.flatnonzero(of[context] & self.train[places.at])
        context, event, size = (np.cumsum(of) - 1)[context[some]], places.event[some], int(of.sum())
        n = places.n[some]
        gain = np.bincount(context, np.log(np.maximum(n - 1, 1) / p[places.at[some]]) * (n > 1), size).astype("<f4")
        of_event = np.full(len(places.events), -1)
        of_event[event] = context
        types = np.bincount(of_event[places.first_here & (of_event >= 0)], minlength=size)
        return np.bincount(context, minlength=size), gain, np.bincount(context[n <= 1], minlength=size), types

    def ask_contexts(self, chunk: int, depth: int, places: _Places, parents: _Places, p: np.ndarray, n_buckets: int) -> pa.Table:
        used, context = self.contexts(places, parents)
        several = parents.several[used]
        n, gain, single, types = self.sums(places, p, context, several)
        of_event = np.cumsum(parents.several) - 1
        bucket, number = (x[of_event[used[several]]] for x in self._numbers(counts_level(depth - 1)))
        ends = np.searchsorted(bucket, np.arange(n_buckets + 1)).tolist()

        def data(a, z):
            # without an occurrence that is not single there is no gain
            planes = gain[a:z][n[a:z] > single[a:z]].view(np.uint8).reshape(-1, 4).T
            return b"".join([*(pack(x[a:z]) for x in (n, single, types)), *(pack_bytes(x.tobytes()) for x in planes)])

        return self.blobs(chunk, context_level(depth), ends, lambda a, z: pack(np.diff(number[a:z], prepend=0)), data)

    def judged(self, depth: int, places: _Places, parents: _Places, p: np.ndarray, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities under the contexts, smoothed towards `p`, and which contexts are nodes, by place."""
        used, context = self.contexts(places, parents)
        alone = parents.alone[used]
        types, kept = np.zeros(len(used), np.int64), np.zeros(len(used), bool)
        types[~alone], kept[~alone] = self._back(context_level(depth), 1)
        if alone.any():
            n, gain, single, here = self.sums(places, p, context, alone)
            types[alone], kept[alone] = here, _judge(n, gain.astype(float), single, here, least_gain)
        share = types[context]
        return (places.n + share * p[places.at]) / np.maximum(parents.n[places.before] + share, 1e-9), kept[context]


def _judge(n: np.ndarray, gain: np.ndarray, single: np.ndarray, types: np.ndarray, least_gain: float) -> np.ndarray:
    """Whether contexts are nodes, from their summed statistics.

    Each occurrence is judged without itself: of a next word seen more than once by its other occurrences, of one seen
    once by the share that smoothing gives to the parent.
    """
    total = gain + single * np.log(np.maximum(types, 1)) - n * np.log(np.maximum(n + types, 1))
    return (types > 0) & (total >= least_gain * n)


def lm_score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_context: int = MIN_CONTEXT,
    min_gain: float = MIN_GAIN,
    max_depth: int = MAX_DEPTH,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10), n_context.

    `held_out` is a condition over `docs`; rows where it is null are held out too. The model learns from the other
    rows. Tokens are words with A-Z lower-cased, and one end for each text; a null text has its end alone. n_context
    says how many tokens were scored by a node below the root. Without training rows every token has the same
    probability. Repeated rows count, and are scored, once each; other columns of `docs` are not looked at.
    """
    base = docs.withColumn(id_col, F.struct(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held")))
    start, n_buckets = chunked(base, id_col, text_col, chunk_bytes)
    kind = docs.schema[id_col].dataType
    start = start.select("chunk", F.col("id.id").alias("id"), "text", F.col("id.held").alias("held"))
    by_chunk = bundled(start).groupBy("chunk")

    numbered = {counts_level(d) for d in range(max_depth)}

    def total(key, table):
        table = table.sort_by("chunk")  # sums are taken in one order
        level, rows = key[0].as_py(), table.num_rows
        tokens = known = 0
        if level % 2:
            parts = [np.cumsum(unpack(k.as_py())[0]) for k in table.column("keys")]
            columns = [[], [], [], []]
            for data in table.column("data"):
                raw, at, planes = data.as_py(), 0, []
                for c in columns[1:]:
                    one, at = unpack(raw, at)
                    c.append(one)
                for _ in range(4):
                    plane, at = unpack_bytes(raw, at)
                    planes.append(np.frombuffer(plane, np.uint8))
                gain = np.zeros(len(one), "<f4")
                gain[columns[1][-1] > columns[2][-1]] = np.stack(planes, 1).view("<f4")[:, 0]
                columns[0].append(gain)
            group = np.concatenate(parts)
            gain, every, single, types = (np.bincount(group, np.concatenate(c)) for c in columns)
            numbers, flags = types.astype(np.int64)[group], [_judge(every, gain, single, types, min_gain)[group]]
        else:
            parts = [unpack_keys(stretch(k.as_py())[0]) for k in table.column("keys")]
            keys = np.concatenate(parts)
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            group = np.empty(len(k), np.int64)
            group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            n = np.concatenate([unpack(d.as_py())[0] for d in table.column("data")])
            sums = np.add.reduceat(n[order], first)
            numbers = sums[group]
            # of the chunks with an event in training the first counts it as a distinct one
            at = np.minimum.reduceat(np.where(n[order] > 0, np.arange(len(n)), len(n)), first)
            leads = np.zeros(len(n), bool)
            leads[order[at[at < len(n)]]] = True
            alone = np.diff(np.append(first, len(k))) == 1
            flags = [leads, alone[group]]
            tokens, known = int(sums.sum()), int((sums > 0).sum())
            several = (sums >= min_context) & ~alone
            number, several = (np.cumsum(several) - 1)[group], several[group]
        back, e = [], 0
        for x in parts:
            a, e = e, e + len(x)
            one = pack(numbers[a:e]) + b"".join(pack_bytes(bits(f[a:e])) for f in flags)
            back.append(one + pack(np.diff(number[a:e][several[a:e]], prepend=0)) if level in numbered else one)
        out = {"chunk": table.column("chunk").to_pylist(), "level": [level] * rows, "bucket": table.column("bucket").to_pylist(), "data": back}
        out["tokens"] = out["known"] = [0] * rows
        if not level:  # and a row of its own for the bucket's training tokens and distinct ones
            out = {c: [*out[c], x] for c, x in (("chunk", -1), ("level", 0), ("bucket", 0), ("data", b""), ("tokens", tokens), ("known", known))}
        kinds = {"level": pa.int32(), "bucket": pa.int32(), "data": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    def send_words(key, table):
        t = _Chunk(unbundled(table), None, min_context)
        return t.ask_counts(key[0].as_py(), 0, t.words(), n_buckets)

    def walk(t: _Chunk, depth: int):
        """(depth, places, places one level up, their probabilities, which are nodes, p): whatever has come back, and p before it."""
        up = t.counted(t.words(), 0)
        p = (up.n + 0.5) / t.z
        yield 0, up, None, p[:0], None, p
        for d in range(1, depth + 1):
            places = t.counted(t.longer(up), d)
            mine, kept = t.judged(d, places, up, p, min_gain)
            yield d, places, up, mine, kept, p
            p[places.at] = mine
            up = places

    def send(depth: int):
        """What a chunk sends once words after contexts of depth - 1 words are counted: those contexts, and longer ones' next words."""

        def f(key, table, answers):
            if not table.num_rows:
                kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
                return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split(" ") for x in _BLOBS.split(", "))})
            t, chunk, out = _Chunk(unbundled(table), answers, min_context), key[0].as_py(), []
            up = t.counted(t.words(), 0)
            if depth > 1:
                p = (up.n + 0.5) / t.z
                for d in range(1, depth):
                    places = t.counted(t.longer(up), d)
                    if d < depth - 1:
                        p[places.at] = t.judged(d, places, up, p, min_gain)[0]
                        up = places
                out.append(t.ask_contexts(chunk, depth - 1, places, up, p, n_buckets))
                up = places
            if depth <= max_depth:
                out.append(t.ask_counts(chunk, depth, t.longer(up), n_buckets))
            return pa.concat_tables(out)

        return f

    def score(key, table, answers):
        table = unbundled(table)
        t = _Chunk(table, answers, min_context)
        for d, places, _, mine, kept, p in walk(t, max_depth):
            if not d:
                base, best, deep, c = p.copy(), p.copy(), np.zeros(len(p), np.int64), places.n
            else:
                best[places.at[kept]], deep[places.at[kept]] = mine[kept], 1
        add = lambda x: np.add.reduceat(x, t.starts)
        return pa.table(
            {
                "id": table.column("id"),
                "held_out": table.column("held"),
                "n_tokens": pa.array(t.sizes),
                "n_known": pa.array(add((c > 0).astype(np.int64))),
                "train_tokens": pa.array([t.tokens] * len(t.starts), pa.int64()),
                "base_score": pa.array(add(np.log10(base))),
                "score": pa.array(add(np.log10(best))),
                "n_context": pa.array(add(deep)),
            }
        )

    def totalled(sent: DataFrame) -> DataFrame:
        return sent.groupBy("level", "bucket").applyInArrow(total, _ANSWERS)

    words = totalled(by_chunk.applyInArrow(send_words, _BLOBS))
    sums = words.where("chunk = -1").agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known"))
    # answers are dealt by chunk once, and their union stays so
    known = words.where("chunk >= 0").drop("tokens", "known").crossJoin(F.broadcast(sums)).repartition("chunk")
    for depth in range(1, max_depth + 2 if max_depth else 1):
        found = totalled(by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(send(depth), _BLOBS))
        known = known.unionAll(found.repartition("chunk"))
    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_context bigint"
    return by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
