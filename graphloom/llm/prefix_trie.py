"""The trie of conversations by their turns: union-find over the common prefixes of sorted neighbours, deepest first.

Conversations are range-sorted by their turns' digests. A block of neighbours is one task's work: its edges, the depths
that neighbours share, are taken in descending order, every union closes or extends a branching node, and nodes that the
block's neighbours can still change (those on the first or last conversation's way) are contracted to a forest of two
ways. Forests are merged over block boundaries in the same way, some at a time, until one closes all.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written

DIGEST = 16
#: Turns of a block, on average, and forests that are merged at once.
BLOCK_TURNS = 20_000
MERGED = 32
#: Conversation ids of a piece of a list that goes through several blocks.
PIECE_IDS = 400
#: Rows that a task hands on at once.
ROWS_OUT = 10_000

NODE, FOREST, OPEN, ENDS = range(4)
FIELDS = [
    ("kind", pa.int8(), "tinyint"),
    ("block", pa.int64(), "bigint"),
    ("conv_id", pa.int64(), "bigint"),
    ("depth", pa.int64(), "bigint"),
    ("parent_conv_id", pa.int64(), "bigint"),
    ("n_convs", pa.int64(), "bigint"),
    ("n_children", pa.int64(), "bigint"),
    ("n_leaves", pa.int64(), "bigint"),
    ("saved_tokens", pa.int64(), "bigint"),
    ("ends_sha256", pa.string(), "string"),
    ("key", pa.binary(), "binary"),
    ("above", pa.binary(), "binary"),
    ("part", pa.int64(), "bigint"),
    ("payload", pa.binary(), "binary"),
]
SCHEMA = ", ".join(f"{n} {s}" for n, _, s in FIELDS)
_ARROW = pa.schema([(n, t) for n, t, _ in FIELDS])
#: More than any conv_id.
_NO_ID = 1 << 63
_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass
class Way:
    """A sequence of turns and what is known of the nodes on it: depth -> [n, smallest id, children, leaves, saved]."""

    path: bytes
    chars: list[int]
    known: dict[int, list[int]] = field(default_factory=dict)
    ends: list[int] | None = None


class _Part:
    """A component: neighbours that share the node at its top, and what has been summed up to there."""

    def __init__(self, way: Way, at: int):
        self.left = self.right = at
        self.chars, self.depth, self.known, self.ends = way.chars, len(way.path) // DIGEST, dict(way.known), way.ends
        self.sums = self.known.pop(self.depth, None) or [0, _NO_ID, 0, 0, 0]
        self.waiting: list[dict] = []  # closed children, until their parent's smallest id is known


def _added(a: list[int], b: list[int]) -> list[int]:
    return [a[0] + b[0], min(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4]]


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _keys(path: bytes) -> list[bytes]:
    """A name for each prefix of a path, from the empty one on."""
    h, out = hashlib.md5(usedforsecurity=False), []
    for k in range(0, len(path) + 1, DIGEST):
        out.append(h.digest())
        h.update(path[k : k + DIGEST])
    return out


def grow(ways: list[Way], last: bool, named: bool) -> Iterator[dict | list[Way]]:
    """Rows of the nodes that close, of those that stay open, then the ways that stay.

    `ways` are neighbours in the order of their paths. With `last` all nodes close. `named` nodes were open in a block
    before: their rows carry their key, by which the ids that end in them are found.
    """
    n = len(ways)
    first, final = _keys(ways[0].path), _keys(ways[-1].path)
    paths = [first] * n if not named else [_keys(w.path) for w in ways]
    part = [_Part(w, k) for k, w in enumerate(ways)]
    above = list(range(n))
    stays: list[dict[int, list[int]]] = [{}, {}]

    def find(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    def closed(p: _Part, stop: int) -> Iterator[dict]:
        """The nodes of a component from its top to just below depth `stop`; those that may change are kept in `stays`."""
        while p.depth > stop:
            d, sums = p.depth, p.sums
            inherited = p.known.pop(d - 1, None) or [0, _NO_ID, 0, 0, 0]
            if not last and (p.left == 0 or p.right == n - 1):
                key = first[d] if p.left == 0 else final[d]
                stays[p.left != 0][d] = sums
                yield {"kind": OPEN, "key": key}
                yield from ({**row, "above": key} for row in p.waiting)
                for k in range(0, len(p.ends or ()), PIECE_IDS):
                    yield {"kind": ENDS, "key": key, "part": k, "payload": ",".join(map(str, p.ends[k : k + PIECE_IDS])).encode()}
                p.waiting, p.sums = [], inherited
            else:
                leaves, saved = sums[3] or 1, sums[4] + (sums[0] - 1) * (p.chars[d - 1] if d > 0 else 0)
                yield from ({**row, "parent_conv_id": sums[1]} for row in p.waiting)
                row = {"kind": NODE, "conv_id": sums[1], "depth": d, "n_convs": sums[0], "n_children": sums[2], "n_leaves": leaves, "saved_tokens": saved}
                if named:
                    row["key"] = paths[p.left][d]
                else:
                    row["ends_sha256"] = hashlib.sha256(",".join(map(str, p.ends)).encode()).hexdigest() if p.ends else _NOTHING
                p.waiting, p.sums = [row], _added(inherited, [sums[0], sums[1], 1, leaves, saved])
            p.depth, p.ends = d - 1, None

    shared = [0, *(_shared(a.path, b.path) for a, b in zip(ways, ways[1:], strict=False))]
    for k in sorted(range(1, n), key=lambda k: -shared[k]):
        a, b = find(k - 1), find(k)
        for x in (a, b):
            yield from closed(part[x], shared[k])
        small, large = sorted((a, b), key=lambda x: len(part[x].waiting) + len(part[x].known))
        p, q = part[large], part[small]
        p.left, p.right = part[a].left, part[b].right
        p.sums, p.ends = _added(p.sums, q.sums), p.ends or q.ends
        p.waiting += q.waiting
        for d, sums in q.known.items():
            p.known[d] = _added(p.known[d], sums) if d in p.known else sums
        above[small], part[small] = large, None
    root = part[find(0)]
    yield from closed(root, -1)
    if last:
        yield from root.waiting
    else:
        kept = [Way(ways[0].path, ways[0].chars, stays[0])]
        if stays[1]:
            kept.append(Way(ways[-1].path, ways[-1].chars, stays[1]))
        yield kept


def _packed(ways: list[Way]) -> bytes:
    return pickle.dumps([(w.path, w.chars, w.known) for w in ways])


def _unpacked(payload: bytes) -> list[Way]:
    return [Way(*w) for w in pickle.loads(payload)]


def _rows(found: Iterator[dict | list[Way]], block: int) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for row in found:
        rows.append({"kind": FOREST, "block": block, "payload": _packed(row)} if isinstance(row, list) else {**row, "block": block})
        if len(rows) >= ROWS_OUT:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, path, chars) of one partition: closed nodes, and what neighbours can change."""
    ways: list[Way] = []
    for b in batches:
        for c, path, chars in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist(), b.column("chars").to_pylist(), strict=True):
            if ways and ways[-1].path == path:
                ways[-1].ends.append(c)
            else:
                ways.append(Way(path, chars, {}, [c]))
    for w in ways:
        w.known[len(w.path) // DIGEST] = [len(w.ends), min(w.ends), 0, 0, 0]
    if ways:
        yield from _rows(grow(ways, last=False, named=False), TaskContext.get().partitionId())


def _merge(last: bool):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        ways = [w for _, payload in rows for w in _unpacked(payload)]
        return pa.Table.from_batches(_rows(grow(ways, last, named=True), rows[0][0] // MERGED), schema=_ARROW)

    return merge


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, payload) in order: the hash of each key's payloads, comma-joined; one piece is held at a time."""
    key, h, keys, hashes = None, None, [], []
    for b in batches:
        for k, payload in zip(b.column("key").to_pylist(), b.column("payload").to_pylist(), strict=True):
            if k != key:
                if h is not None:
                    keys.append(key)
                    hashes.append(h.hexdigest())
                key, h = k, hashlib.sha256(payload)
            else:
                h.update(b"," + payload)
    if h is not None:
        keys.append(key)
        hashes.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "hash"])


def prefix_trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of `sequences` (conv_id, path, chars).

    A path is the digests of a conversation's turns, 16 bytes each, chars the code points of their texts; conv_ids are
    not null and differ. A node is a distinct path of the first d turns; its row has conv_id (smallest of its members),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 as in `op12_prefix_trie`. An empty
    path is a member of the root only; no sequences, no rows.

    Equal and long paths may go on over any number of blocks: a block holds `block_turns` turns on average and at least
    one conversation. Ids that end in a node which blocks share are hashed as a stream of pieces. The driver sees only
    counts and the bounds of the range sort (a sample of paths).
    """
    sequences = written(sequences.select("conv_id", "path", "chars"), "sequences")
    turns = sequences.agg(F.sum(F.size("chars") + 1)).first()[0]
    n = -(-(turns or 0) // block_turns) or 1
    order = ("path", "conv_id")
    blocks = sequences.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_block, SCHEMA)
    levels = [written(blocks, "trie-blocks")]
    while n > 1 or len(levels) == 1:
        n = -(-n // MERGED)
        forests = levels[-1].where(F.col("kind") == FOREST).select("block", "payload")
        merged = forests.groupBy((F.col("block") / MERGED).cast("bigint")).applyInArrow(_merge(n == 1), SCHEMA)
        levels.append(written(merged, "trie-merged"))
    table = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        table = table.unionByName(level.withColumn("level", F.lit(k)))
    named = table.where((F.col("kind") == NODE) & F.col("key").isNotNull())
    # a block's children of an open node ask for it in that block's name, so a parent of many is no hot key
    asked = table.where(F.col("kind") == OPEN).select("level", "block", F.col("key").alias("above"))
    answers = asked.join(named.select(F.col("key").alias("above"), F.col("conv_id").alias("found")), "above")
    nodes = table.where(F.col("kind") == NODE).join(answers, ["level", "block", "above"], "left")
    pieces = table.where(F.col("kind") == ENDS).select("key", "block", "part", "payload")
    ends = pieces.repartition("key").sortWithinPartitions("key", "block", "part").mapInArrow(_hashed, "key binary, hash string")
    nodes = nodes.join(ends, "key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    digest = F.coalesce("ends_sha256", "hash", F.lit(_NOTHING)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def turn_lists(turns: DataFrame, key: str) -> DataFrame:
    """conv_id, `key` and turns (number, digest, chars) in order; rows without a conv_id are left out.

    Turns go by turn, null first, those with the same number by the digest of role and text; null values are empty.
    Only digests and lengths are shuffled, once, by `key`, a function of conv_id.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = turns.where("conv_id IS NOT NULL").select("conv_id", F.expr(key).alias("key"), F.struct("turn", digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    return own.repartition("key").groupBy("key", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path and chars of each conversation c as the query rebuilds it.

    It has the first h turns of conversation c - c % 100, as far as there are, and its own after its first h, with
    h = crc32(c as text) % 6. Extra columns are not looked at.
    """
    own = turn_lists(turns, "conv_id - conv_id % 100")
    head = F.first(F.when(F.col("conv_id") == F.col("key"), F.slice("turns", 1, 5)), ignorenulls=True).over(Window.partitionBy("key"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = own.select("conv_id", "turns", head.alias("head"), h.alias("h"))
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    both = F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    own = own.select("conv_id", both.alias("both"))
    path = F.unhex(F.array_join(F.transform("both", lambda t: t["digest"]), ""))
    return own.select("conv_id", path.alias("path"), F.transform("both", lambda t: t["chars"]).alias("chars"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = """
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, d) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
          list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.base),
u AS (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM r),
p AS (SELECT conv_id, d, len(ts) AS size, array_to_string(list_transform(ts[1:d], lambda x: x.d), '') AS k,
             array_to_string(list_transform(ts[1:d - 1], lambda x: x.d), '') AS up, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS chars FROM u),
n AS (SELECT k, d, min(conv_id) AS c, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM p GROUP BY k, d),
f AS (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
s AS (SELECT a.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved
      FROM m JOIN p a ON a.conv_id = m.c AND a.d <= m.d GROUP BY a.k)
SELECT m.c AS conv_id, m.d AS depth, q.c AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (k) LEFT JOIN m q ON m.d > 0 AND q.k = m.up
"""
