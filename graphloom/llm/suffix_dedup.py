"""Exact dedup of byte strings by suffix arrays, sharded by content.

Every window of bytes has an anchor, the 16 bytes in it whose hash is smallest, with as many bytes before or behind it as
the window has on its longer side at least; so equal windows share their anchor's content wherever they stand. Consecutive
windows with one anchor make a segment. Segments whose anchor occurs in one document only cannot repeat; the others go to
the shard of their anchor, where a two-stage suffix sort and adjacent common prefixes find equal windows and their smallest
document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import bits, bucket_ends, chunked, contains, distinct_sorted, in_order, mix, pack5, pack_counts, unbits, unpack5, unpack_counts
from .suffix_sort import common_prefix_reaches, sort_keys, two_stage_order

WINDOW = 50
#: Less than elsewhere, as arrays here have an entry for each byte.
CHUNK_BYTES = 2 << 20
#: Bytes of segments that are sorted at once, if not more of them share a part of a shard; parts that a shard has.
SORT_BYTES, PARTS = 2 << 20, 256
#: Segments around one anchor that go to one shard; of an anchor with more, each window goes by its own hash.
HOT_SEGMENTS = 1 << 14
ANCHOR = 16
_NO_ID = np.iinfo(np.int64).max
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 28) - 1)


class _Chunk:
    """A chunk's texts as bytes, one after the other, and the segments of their windows."""

    def __init__(self, table: pa.Table, copies: pa.Table, window: int):
        ids = table.column("id").fill_null(_NO_ID).to_numpy()
        self.texts = [(t.as_py() or "").encode("utf-8") for t in table.column("text")]
        again = set(zip(copies.column("id").to_pylist(), copies.column("th").to_pylist(), strict=True))
        hashes = table.column("th").to_pylist()
        self.copy = [bool(again) and x in again for x in zip(table.column("id").to_pylist(), hashes, strict=True)]
        self.ids = ids
        own = [b"" if c else t for t, c in zip(self.texts, self.copy, strict=True)]
        size = np.array([len(t) for t in own], np.int64)
        self.start = np.cumsum(size) - size
        self.data = b"".join(own)
        span = window - ANCHOR + 1
        n = len(self.data) - window + 1
        if n <= 0:
            self.first = self.last = self.doc = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.uint64)
            return
        grams = _grams(self.data)
        place = _first_least(grams, span)
        room = np.repeat(self.start + size, size)[:n] - np.arange(n)
        inside = room >= window
        # 16 bytes often repeat by chance in much text, so the half of the window's rest that lies on one side goes with them
        before = (window - ANCHOR + 1) // 2
        left = place - np.arange(n) >= before
        # a segment goes on while the anchor stays; windows of one anchor lie in one text
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (left[1:] != left[:-1]) | ~inside[:-1] | ~inside[1:]])
        at = np.flatnonzero(new)
        end = np.append(at[1:], n) - 1
        good = inside[at]
        self.first, self.last = at[good], end[good]
        left, place = left[self.first], place[self.first]
        self.anchor = np.empty(len(place), np.uint64)
        self.anchor[left] = _joined(grams, place[left] - before, before + ANCHOR)
        self.anchor[~left] = ~_joined(grams, place[~left], window - before + 1)
        self.doc = np.searchsorted(self.start, self.first, "right") - 1


def _grams(data: bytes) -> np.ndarray:
    """A hash of every 16 consecutive bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        h ^= h >> np.uint64(32)
        h += eight[8:]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(29)
    return h


def _joined(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of `width` bytes, 16 or more, from each place on, made of the hashes of 16."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in (*range(0, width - ANCHOR, ANCHOR), width - ANCHOR):
            out = mix(out * _BASE + grams[at + k])
    return out


def _prefix_hash(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bytes' values times powers of a base, up to each place, and the base's inverse powers."""
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(n + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * power[:-1], dtype=np.uint64)])
    return sums, back


class _Segments:
    """A chunk's segments with a repeated anchor, in order of anchor, content and document; equal ones are one group.

    Segments with a hot anchor are cut into their windows, which are segments with their own hash for an anchor.
    """

    def __init__(self, c: _Chunk, hits: np.ndarray, hot: np.ndarray, window: int):
        is_hot = contains(hot, c.anchor)
        at, cut = np.flatnonzero(contains(hits, c.anchor) & ~is_hot), np.flatnonzero(is_hot)
        sums, back = _prefix_hash(c.data)
        many = c.last[cut] - c.first[cut] + 1
        a = np.concatenate([c.first[at], _spread(c.first[cut], many)])
        z = np.concatenate([c.last[at], a[len(at) :]]) + window
        doc = np.concatenate([c.doc[at], np.repeat(c.doc[cut], many)])
        with np.errstate(over="ignore"):
            content = mix((sums[z] - sums[a]) * back[a]) + (z - a).astype(np.uint64)
        anchor = np.concatenate([c.anchor[at], mix(content[len(at) :])])
        self.id = c.ids[doc]
        order = np.lexsort((self.id, content, anchor))
        self.id, self.first, self.size = self.id[order], a[order], (z - a)[order]
        anchor, content = anchor[order], content[order]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])[: len(order)]
        self.head = np.flatnonzero(new)  # of each group, the one with the smallest id
        self.group = np.cumsum(new) - 1
        self.anchor = anchor[self.head]


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for `size` places each, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _first_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of `width` hashes, by the bits above the mask, from each place on; of equal ones the first."""
    out, step = [], int(_PLACE) + 2 - width  # so many at once that their places fit the mask
    for a in range(0, len(hashes) - width + 1, step):
        some = hashes[a : a + step + width - 1]
        marked = (some & ~_PLACE) | np.arange(len(some), dtype=np.uint64)
        out.append((_sliding_min(marked, width) & _PLACE).astype(np.int64) + a)
    return np.concatenate(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per input row: id_col, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary, the bytes that stay).

    A byte goes if it is in a `window`-byte string of its text that also starts in a row with a smaller id; all is
    judged on the input, and matches never cross texts. A null text has no bytes. Rows with equal ids don't remove one
    another; a null id counts as larger than any other. Ids are integers. Texts that equal one with a smaller id go
    whole if they have a window at all. Other columns of `docs` are not looked at.
    """
    if window < ANCHOR:
        raise ValueError(f"window must be {ANCHOR} bytes or more")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    start, n_buckets = chunked(docs, "id", "text", chunk_bytes)
    start = start.withColumn("th", F.xxhash64("text"))
    digests = start.where(F.octet_length("text") >= window).select("chunk", "id", "th", F.md5("text").alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    copies = digests.join(firsts, "digest").where(later).selectExpr("chunk + 0 AS chunk", "id + 0 AS id", "th + 0 AS th").distinct()
    by_chunk = start.groupBy("chunk")

    def anchors(key, left, copies):
        c = _Chunk(in_order(left), copies, window)
        order = np.lexsort((c.ids[c.doc], c.anchor))
        a, d = c.anchor[order], c.ids[c.doc][order]
        new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        first = np.flatnonzero(new)
        many = d[first] != d[np.append(first[1:], len(a))[: len(first)] - 1]
        n = np.diff(np.append(first, len(a)))
        return _blobs(key[0].as_py(), a[first], n_buckets, lambda x, z: (pack5(a[first[x:z]]), bits(many[x:z]) + pack_counts(n[x:z])))

    def repeated(key, table):
        n = table.column("n").to_numpy()
        values = np.concatenate([unpack5(v.as_py()) for v in table.column("a")])
        flags = [f.as_py() for f in table.column("b")]
        edge = (n + 7) // 8
        many = np.concatenate([unbits(f[:e], k) for f, e, k in zip(flags, edge.tolist(), n.tolist(), strict=True)])
        times = np.concatenate([unpack_counts(f, e)[0] for f, e in zip(flags, edge.tolist(), strict=True)])
        order = np.argsort(values, kind="stable")
        v = values[order]
        group = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
        hit = np.empty(len(v), bool)
        hit[order] = (np.bincount(group, 1 + many[order]) > 1)[group]
        hot = np.empty(len(v), bool)
        hot[order] = (np.bincount(group, times[order]) > hot_segments)[group]
        return pa.concat_tables([_answers(table, 0, n, hit), _answers(table, 2, n, hit & hot)])

    def segments(c: _Chunk, masks) -> _Segments:
        values = distinct_sorted(c.anchor)[0]
        ends = bucket_ends(values, n_buckets)
        return _Segments(c, _hits(values, ends, masks, 0), _hits(values, ends, masks, 2), window)

    def ship(key, left, right):
        copies, masks = _split(right)
        if not left.num_rows or not masks.num_rows:
            return _blobs(0, np.empty(0, np.uint64), 1, None)
        c = _Chunk(in_order(left), copies, window)
        found = segments(c, masks)
        least, size = found.id[found.head], found.size[found.head]
        raw = np.frombuffer(c.data, np.uint8)[_spread(found.first[found.head], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])

        part = _parts(found.anchor, n_buckets)

        def pack(a, z):
            return least[a:z].tobytes() + size[a:z].astype("<u4").tobytes() + part[a:z].tobytes(), raw[ends[a] : ends[z]]

        return _blobs(key[0].as_py(), found.anchor, n_buckets, pack)

    def sort_shard(key, table):
        n = table.column("n").to_numpy()
        heads = [x.as_py() for x in table.column("a")]
        least = np.concatenate([np.frombuffer(h, np.int64, k) for h, k in zip(heads, n, strict=True)])
        size = np.concatenate([np.frombuffer(h, "<u4", k, 8 * k) for h, k in zip(heads, n, strict=True)]).astype(np.int64)
        part = np.concatenate([np.frombuffer(h, np.uint8, k, 12 * k) for h, k in zip(heads, n, strict=True)])
        raw = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("b")])
        begin, windows = np.cumsum(size) - size, size - window + 1
        upto = np.cumsum(windows) - windows
        # one bit for each window of each shipped segment: does it start in a smaller document?
        gone = np.empty(int(windows.sum()), bool)
        for low, high in _few_parts(np.bincount(part, size, PARTS), SORT_BYTES):
            some = np.flatnonzero((part >= low) & (part < high))
            text = raw[_spread(begin[some], size[some])].tobytes()
            gone[_spread(upto[some], windows[some])] = _in_smaller(text, size[some], least[some], window)
        return _answers(table, 1, np.add.reduceat(windows, np.cumsum(n) - n), gone)

    def finish(key, left, right):
        copies, masks = _split(right)
        left = in_order(left)
        c = _Chunk(left, copies, window)
        starts = np.zeros(len(c.data) + window, bool)
        if masks.num_rows:
            found = segments(c, masks)
            windows = found.size - window + 1
            own = windows[found.head]
            ends, mine = bucket_ends(found.anchor, n_buckets), np.zeros(int(own.sum()), bool)
            upto = np.concatenate([[0], np.cumsum(own)])
            for r in masks.select(["kind", "bucket", "n", "hits"]).to_pylist():
                if r["kind"] == 1:
                    a = upto[ends[r["bucket"]]]
                    mine[a : a + r["n"]] = unbits(r["hits"], r["n"])
            # of a group, rows with its smallest id lose what the shard says, and all later ones everything
            later = found.id != found.id[found.head][found.group]
            gone = mine[_spread(upto[:-1][found.group], windows)] | np.repeat(later, windows)
            starts[_spread(found.first, windows)[gone]] = True
        so_far = np.cumsum(starts)
        covered = so_far - np.concatenate([np.zeros(window, np.int64), so_far[:-window]]) > 0
        raw = np.frombuffer(c.data, np.uint8)
        cols = ([], [], [], [])
        for text, copy, a in zip(c.texts, c.copy, c.start.tolist(), strict=True):
            mine = np.ones(len(text), bool) if copy else covered[a : a + len(text)]
            removed = int(mine.sum())
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0
            kept = text if not removed else b"" if copy else raw[a : a + len(text)][~mine].tobytes()
            for col, x in zip(cols, (len(text), removed, spans, kept), strict=True):
                col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([left.column("id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    # copies and answers reach a chunk in one table
    sent = "chunk bigint, kind int, bucket int, n int, hits binary, id bigint, th bigint"
    marked = copies.selectExpr("chunk", "-1 kind", "0 bucket", "0 n", "cast(null as binary) hits", "id", "th")
    blobs = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(anchors, _BLOBS)
    near = blobs.groupBy("bucket").applyInArrow(repeated, sent)
    shipped = by_chunk.cogroup(marked.unionAll(near).groupBy("chunk")).applyInArrow(ship, _BLOBS)
    answers = shipped.groupBy("bucket").applyInArrow(sort_shard, sent)
    right = marked.unionAll(near).unionAll(answers).groupBy("chunk")
    done = by_chunk.cogroup(right).applyInArrow(finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return done.withColumn("id", F.col("id").cast(docs.schema["id"].dataType)).withColumnRenamed("id", id_col)


def _in_smaller(raw: bytes, size: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each window of segments that stand one after the other, whether it also stands in one with a smaller id."""
    ends = np.cumsum(size)
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(raw[z - s : z], len(known)) for s, z in zip(size.tolist(), ends.tolist(), strict=True)], np.int64)
    own = np.full(len(known), _NO_ID)
    np.minimum.at(own, which, least)
    lengths = np.array([len(x) for x in known], np.int64)
    stop = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(stop[-1]) + 1, np.uint16)
    body = np.ones(len(text), bool)
    body[stop] = False
    text[body] = np.frombuffer(b"".join(known), np.uint8).astype(np.uint16) + 1
    del known, body
    keys = sort_keys(text)
    order = two_stage_order(text, keys, window)
    room = np.repeat(stop.astype(np.int32), lengths + 1) - np.arange(len(text), dtype=np.int32)
    segment = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    order = order[room[order] >= window]
    group = np.cumsum(~common_prefix_reaches(order, text, keys, window)) - 1
    smallest = np.full(int(group[-1]) + 1, _NO_ID)
    np.minimum.at(smallest, group, own[segment[order]])
    found = np.full(len(text), _NO_ID)
    found[order] = smallest[group]
    windows = size - window + 1
    return found[_spread(stop[which] - lengths[which], windows)] < np.repeat(least, windows)


def _parts(values: np.ndarray, n: int) -> np.ndarray:
    """In which of PARTS parts of its bucket each value is, sorted values of `n` buckets."""
    ends, out = bucket_ends(values, n), np.empty(len(values), np.uint8)
    for k, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
        out[a:z] = np.minimum((values[a:z] - np.uint64((k << 64) // n)) // np.uint64((1 << 64) // n // PARTS), PARTS - 1)
    return out


def _few_parts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of parts that hold something, of `most` together, or one part."""
    out, held = [], most
    for k in np.flatnonzero(sizes).tolist():
        if held + sizes[k] > most:
            out.append((k, k))
            held = 0
        out[-1] = (out[-1][0], k + 1)
        held += sizes[k]
    return out


_BLOBS = "bucket int, chunk bigint, n int, a binary, b binary"


def _blobs(chunk: int, values: np.ndarray, n_buckets: int, pack) -> pa.Table:
    ends = bucket_ends(values, n_buckets)
    spans = [(b, a, z) for b, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]
    packed = [pack(a, z) for _, a, z in spans]
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
            "chunk": pa.array([chunk] * len(spans), pa.int64()),
            "n": pa.array([z - a for _, a, z in spans], pa.int32()),
            "a": pa.array([x for x, _ in packed], pa.binary()),
            "b": pa.array([x for _, x in packed], pa.binary()),
        }
    )


def _answers(table: pa.Table, kind: int, n: np.ndarray, hit: np.ndarray) -> pa.Table:
    """For each blob with a hit, its n bits."""
    ends = np.cumsum(n)
    at = [i for i, (e, k) in enumerate(zip(ends, n, strict=True)) if hit[e - k : e].any()]
    rows, none = len(at), pa.nulls(len(at), pa.int64())
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(at, pa.int64())),
            "kind": pa.array([kind] * rows, pa.int32()),
            "bucket": table.column("bucket").take(pa.array(at, pa.int64())),
            "n": pa.array([int(n[i]) for i in at], pa.int32()),
            "hits": pa.array([bits(hit[ends[i] - n[i] : ends[i]]) for i in at], pa.binary()),
            "id": none,
            "th": none,
        }
    )


def _split(right: pa.Table) -> tuple[pa.Table, pa.Table]:
    import pyarrow.compute as pc

    mark = pc.equal(right.column("kind"), -1)
    return right.filter(mark), right.filter(pc.invert(mark))


def _hits(values: np.ndarray, ends: list[int], masks: pa.Table, kind: int) -> np.ndarray:
    keep = np.zeros(len(values), bool)
    for row in masks.select(["kind", "bucket", "n", "hits"]).to_pylist():
        if row["kind"] == kind:
            a = ends[row["bucket"]]
            keep[a : a + row["n"]] = unbits(row["hits"], row["n"])
    return values[keep]


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, j * 500 AS base, substring(h, j * 1000 + 1, 1098) AS h FROM (SELECT r, doc_id, h, unnest(range(0, (len(h) + 999) // 1000)) AS j FROM d)),
w AS (SELECT r, doc_id, base + k AS k, substring(h, 2 * k - 1, 100) AS s FROM (SELECT r, doc_id, base, h, unnest(range(1, len(h) // 2 - 48)) AS k FROM p WHERE len(h) >= 100)),
f AS (SELECT r, k FROM (SELECT r, k, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
b AS (SELECT r, base + k AS k, substring(h, 2 * k - 1, 2) AS x FROM (SELECT r, base, h, unnest(range(1, least(len(h) // 2, 500) + 1)) AS k FROM p)),
c AS (SELECT b.r, b.k, x, max(f.k) OVER (PARTITION BY b.r ORDER BY b.k) AS last FROM b LEFT JOIN f ON f.r = b.r AND f.k = b.k),
e AS (SELECT r, k, x, coalesce(k - last < 50, false) AS gone FROM c),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY k), false) AS opens FROM e),
t AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, count(*) FILTER (opens) AS s, string_agg(x, '' ORDER BY k) FILTER (NOT gone) AS kept FROM o GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
