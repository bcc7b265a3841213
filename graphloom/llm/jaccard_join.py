"""N-gram Jaccard join: near-duplicate classes of documents by the overlap of their word shingles.

Documents are sent to signature trees in clusters. Two sets that link share one of their rarest shingles, in an order
by the number of documents with a shingle; only shingles that other documents have lead anywhere, so a cluster is little
more than a group of near copies. Dual traversal of a cluster's tree finds its links; a large cluster is cut into
blocks, and what their own trees leave apart is compared with every block of its cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .components import components
from .exchange import CHUNK_BYTES, bucket_ends, chunked, in_order, rolling
from ..plans.shared import written
from .signature_tree import links

SHINGLE, NUM, DEN = 3, 90, 100
#: Sets that one tree holds at most, and shingles that its sets have in all on average, but for a single larger set.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 21

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0xD6E8FEB86659FD93


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, the whole sequence is one."""
    words = text.encode("utf-8").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        return rolling(h, len(h), _BASE) ^ np.uint64(len(h))
    return np.unique(rolling(h, k, _BASE))


def _pack4(values: np.ndarray) -> bytes:
    """Bits 16 to 47: with the bucket's range enough to tell nearly all values apart; the order needs no more."""
    return (values >> np.uint64(16)).astype("<u4").tobytes()


def jaccard_classes(
    docs: DataFrame,
    shingle: int = SHINGLE,
    num: int = NUM,
    den: int = DEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per input row: id_col, n_shingles and component_id, the smallest id that links lead to, its own included.

    Words are runs of anything but ASCII white space with A-Z lower-cased; a set is a text's distinct shingles. Rows
    link when den * |intersection| >= num * |union|. Rows without words link with nothing. Rows that share an id are
    one document, joined by the links of any of its texts. A null id links with nothing and gets a null component.
    Ids are integers. Other columns of `docs` are not looked at.
    """
    start, n_buckets = chunked(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), "id", "text", chunk_bytes)
    by_chunk = start.groupBy("chunk")
    none = np.empty(0, np.uint64)

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [shingle_set(t.as_py(), shingle) for t in table.column("text")]

    def send(key, table):
        values, n = np.unique(np.concatenate([none, *sets_of(table)]), return_counts=True)
        ends = bucket_ends(values, n_buckets)
        spans = [(b, a, z) for b, (a, z) in enumerate(zip(ends, ends[1:], strict=False)) if z > a]
        n = np.minimum(n, 255).astype(np.uint8)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in spans], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "values": pa.array([_pack4(values[a:z]) for _, a, z in spans], pa.binary()),
                "n": pa.array([n[a:z].tobytes() for _, a, z in spans], pa.binary()),
            }
        )

    def count(key, table):
        raw = [v.as_py() for v in table.column("values")]
        v = np.frombuffer(b"".join(raw), "<u4")
        n = np.frombuffer(b"".join(x.as_py() for x in table.column("n")), np.uint8)
        order = np.argsort(v)
        first = np.flatnonzero(np.concatenate([[True], np.diff(v[order]) > 0]))
        total = np.empty(len(v), np.uint8)
        sums = np.minimum(np.add.reduceat(n[order], first, dtype=np.int64), 255).astype(np.uint8)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(v))))
        ends = np.cumsum([len(r) // 4 for r in raw])
        parts = [total[e - len(r) // 4 : e].tobytes() for e, r in zip(ends, raw, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": pa.array(parts, pa.binary())})

    def prefixes(key, table, counts):
        table = in_order(table)
        sets = sets_of(table)
        got = {r["bucket"]: r["n"] for r in counts.select(["bucket", "n"]).to_pylist()}
        values = np.unique(np.concatenate([none, *sets]))
        df = np.frombuffer(b"".join(got[b] for b in sorted(got)), np.uint8)
        out = []
        for s in sets:
            n = df[np.searchsorted(values, s)]
            length = len(s) - -(-num * len(s) // den) + 1
            first = np.lexsort((s, n))[:length] if len(s) else np.empty(0, np.int64)
            out.append(s[first[n[first] > 1]].view(np.int64))
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(sets), pa.int64()),
                "id": table.column("id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "prefix": pa.array(out, pa.list_(pa.int64())),
            }
        )

    counts = by_chunk.applyInArrow(send, "bucket int, chunk bigint, values binary, n binary").groupBy("bucket").applyInArrow(count, "chunk bigint, bucket int, n binary")
    rows = by_chunk.cogroup(counts.groupBy("chunk")).applyInArrow(prefixes, "chunk bigint, id bigint, n_shingles bigint, key binary, prefix array<bigint>")
    rows = written(rows, "prefixes")

    # equal sets are one node, named by its smallest id
    full = rows.where("n_shingles > 0 AND id IS NOT NULL")
    nodes = written(full.groupBy("key").agg(F.min_by(F.struct("chunk", "id", "prefix", "n_shingles"), "id").alias("first")), "nodes")
    heads = nodes.select("first.*").where(F.size("prefix") > 0).withColumnRenamed("id", "node")
    entries = heads.select("node", F.explode("prefix").alias("e")).repartition("e")
    hubs = entries.groupBy("e").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub < most")
    stars = entries.join(hubs, "e").where("node > hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(stars)
    sized = clusters.join(heads.select("node", "chunk", "n_shingles"), "node")

    def pieces():
        """How many parts a group of sets is cut into."""
        return F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / block_shingles)).cast("int")

    placed = sized.join(sized.groupBy("component").agg(pieces().alias("blocks")), "component")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = written(placed.selectExpr("chunk", "node", "n_shingles", "component AS cluster", "blocks", "block"), "clusters")

    wanted_cols = ("chunk", "node", "cluster", "x", "y", "side", "label")
    shipped = "cluster bigint, x int, y int, side int, node bigint, label bigint, hashes binary"

    def ship(key, table, wanted):
        asked: dict[int, list[dict]] = {}
        for r in wanted.to_pylist():
            asked.setdefault(r["node"], []).append(r)
        table = in_order(table)
        cols: dict[str, list] = {c: [] for c in ("cluster", "x", "y", "side", "node", "label", "hashes")}
        seen = set()
        for node, text in zip(table.column("id").to_pylist(), table.column("text"), strict=True):
            if node in asked:
                s = shingle_set(text.as_py(), shingle).tobytes()
                if s and (node, s) not in seen:
                    seen.add((node, s))
                    for r in asked[node]:
                        for c in cols:
                            cols[c].append(s if c == "hashes" else r[c])
        kinds = {"x": pa.int32(), "y": pa.int32(), "side": pa.int32(), "hashes": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items()})

    def tree_join(table):
        def side(k: int):
            part = table.filter(pc.equal(table.column("side"), k))
            return part.column("node").to_numpy(), [np.frombuffer(h.as_py(), np.uint64) for h in part.column("hashes")], part.column("label").to_numpy()

        right = side(1)
        found = links(side(0), right if len(right[0]) else None, num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def linked(wanted: DataFrame) -> DataFrame:
        sent = by_chunk.cogroup(wanted.select(*wanted_cols).groupBy("chunk")).applyInArrow(ship, shipped)
        return sent.groupBy("cluster", "x", "y").applyInArrow(tree_join, "a bigint, b bigint")

    found = written(linked(placed.selectExpr("chunk", "node", "cluster", "block AS x", "block AS y", "0 AS side", "node AS label")), "links")
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        # first the heads of what the blocks have joined, then whatever is outside a cluster's largest part against all
        def labelled(found: DataFrame) -> DataFrame:
            return written(large.join(components(found), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")

        heads_only = labelled(found).where("node = label")
        parts = heads_only.groupBy("cluster").agg(pieces().alias("parts"))
        between = heads_only.join(parts, "cluster").withColumn("x", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        found = written(found.unionAll(linked(between.selectExpr("chunk", "node", "cluster", "x", "x AS y", "0 AS side", "label"))), "links")
        now = labelled(found)
        largest = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        apart = now.join(largest, "cluster").where("label <> main")
        piles = apart.groupBy("cluster").agg(pieces().alias("piles"))
        apart = apart.join(piles, "cluster").withColumn("x", F.pmod(F.xxhash64("node"), F.col("piles")).cast("int"))
        left = apart.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).selectExpr("chunk", "node", "cluster", "x", "y", "0 AS side", "label")
        right = now.join(piles, "cluster").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("piles") - 1))).selectExpr("chunk", "node", "cluster", "x", "block AS y", "1 AS side", "label")
        found = written(found.unionAll(linked(left.unionAll(right))), "links")

    named = full.select("id", "key").join(nodes.select("key", F.col("first.id").alias("node")), "key").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    joined = components(found.unionAll(named)).withColumnRenamed("node", "id")
    out = rows.select("id", "n_shingles").join(joined, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, doc_id, n FROM d JOIN (SELECT r, count(*) AS n FROM g GROUP BY r) USING (r)),
p AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y
      FROM (SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL) JOIN n a ON a.r = ra JOIN n b ON b.r = rb
      WHERE 100 * c >= 90 * (a.n + b.n - c)),
c AS (SELECT DISTINCT doc_id, doc_id AS m FROM d UNION SELECT p.y, c.m FROM c JOIN p ON p.x = c.doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT doc_id, min(m) AS component_id FROM c GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""
