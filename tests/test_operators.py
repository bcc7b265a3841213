import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import features, graphtext, logs, mappings
from graphloom.operators import dictionary, graphs, mining, scoring
from graphloom.plans.shared import numbered
from graphloom.sources import tables
from graphloom.streaming import scoring as streaming

def largest_without_rare(rows, k):
    """What is left when items with a label of fewer than k groups go, again and again."""
    while True:
        groups = {}
        for g, _, x in rows:
            groups.setdefault(x, set()).add(g)
        bad = {(g, i) for g, i, x in rows if len(groups[x]) < k}
        if not bad:
            return {x: len(g) for x, g in groups.items()}
        rows = [r for r in rows if r[:2] not in bad]


def test_cascade(spark):
    r = random.Random(11)
    for k in (0, 1, 2, 3, 4):
        rows = [(g, i, x) for g in range(7) for i in range(3) for x in r.sample("ABCDEFGH", r.randint(1, 3))]
        left = dictionary.mincount_cascade(spark.createDataFrame([*rows, rows[0]], "group int, item int, label string"), k)
        got = {x["label"]: x["n"] for x in left.groupBy("label").agg(F.countDistinct("group").alias("n")).collect()}
        assert got == largest_without_rare(rows, k)


# How infinite and missing log-weights share.
@pytest.mark.parametrize(
    "given, want",
    [
        ([math.inf, math.inf], [-math.log(2)] * 2), ([math.inf, 3.0], [0.0, -math.inf]), ([-math.inf, -math.inf], [-math.log(2)] * 2),
        ([-math.inf, 3.0], [-math.inf, 0.0]), ([0.0, 0.0], [-math.log(2)] * 2), ([0.0, 1.0], [-1.31326169, -0.31326169]), ([math.nan, 1.0], [math.nan] * 2),
    ],
)
def test_normalized_logs(spark, given, want):
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(given)], "g int, k int, x double")
    got = [r["y"] for r in logs.normalized_logs(df, ["g"], "x", "y").orderBy("k").collect()]
    assert all((math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=1e-7) for a, b in zip(got, want, strict=True))


def test_mappings(spark):
    # Mappings with gaps and repeats, and what must become of them.
    one = spark.range(1)
    arr = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<int>")
    r = one.select(
        mappings.inverse(arr(4, 3, 1, 4, None)), mappings.compose(arr(0, 5, 2, 8), arr(4, 3, 1, 4, None)), mappings.permute(arr(0, 3, 1, 0), arr(3, 1, 4, 5)),
        *(mappings.is_permutation(arr(*x)) for x in ((0, 3, 1, 2), (), (0, 3, 1, 0), (0, None, 1, 2), (None,))),
    ).first()
    assert list(r) == [[None, 2, None, 1, 0], [None, 8, 5, None, None], [3, 5, 1, 3], True, True, False, False, False]


def test_graph_text_and_features(spark):
    df = spark.createDataFrame([("0,1,1,2;3,4,3",), (";5",), (";",)], "t string")
    back = df.select("t", graphtext.format_graph(graphtext.parse_bonds(F.col("t")), graphtext.parse_colors(F.col("t"))).alias("u"))
    assert all(r["t"] == r["u"] for r in back.collect())
    f = spark.createDataFrame([([("x", 2)],), (None,)], f"f {features.FEATURES}")
    enc = f.select(features.encode_features(F.col("f")).alias("e"), "f")
    assert all(r["f"] == r["g"] for r in enc.select("f", features.decode_features(F.col("e")).alias("g")).collect())


def test_compact(spark):
    rows = [(1, 1, 0, 1.0, 0.0, 2.0, "NONE"), (1, 1, 0, 1.0, -math.log(3), 6.0, "NONE"), (1, 1, 1, 3.0, -1.0, 7.0, "FILTER"), (2, 2, 0, 1.0, None, 1.0, "NONE")]
    df = spark.createDataFrame(rows, "group int, group_item int, group_norm int, weight_ug double, lweight_part double, pred_x double, filter string")
    strict = scoring.compact(df, ("pred_x",)).collect()
    assert [r["group_item"] for r in strict] == [2] and strict[0]["lweight_part"] is None
    mixed = df.where("group_item = 1").withColumn("lweight_part", F.expr("nullif(lweight_part, 0.0)"))
    assert [tuple(r)[2:] for r in scoring.compact(mixed, ("pred_x",), strict=False).collect()] == [(None, None)]
    between = spark.createDataFrame([(1, 1, 0, 1.0, -1.0, 2.0, "NONE"), (1, 1, 1, 1.0, 0.0, None, "NONE")], df.schema)
    assert [tuple(r)[2:] for r in scoring.compact(between, ("pred_x",)).collect()] == [(-0.5, None)]
    loose = {r["group_item"]: r for r in scoring.compact(df, ("pred_x",), strict=False).collect()}
    assert math.isclose(loose[1]["pred_x"], 3.0) and math.isclose(loose[1]["lweight_part"], math.log(4 / 3))


def test_mining(spark):
    """A tree of ten vertices: counts of disjoint embeddings, and ties at the limit."""
    bonds = [(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (3, 6), (4, 7), (5, 8), (6, 9)]
    df = spark.createDataFrame([(0, 0, 1.0, bonds, [2, 1, 2, 1, 2, 2, 2, 2, 2, 2])], "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int>>, colors array<int>")
    at = lambda k: {r["fragment"]: r["weight"] for r in mining.most_common(df, 3, limit=k).collect()}
    assert at(2) == {";2": 8.0, ";1": 2.0}
    assert at(3) == {";2": 8.0, ";1": 2.0, "0,1;2,2": 3.0}
    assert at(4) == at(5) and sorted(at(4).values()) == [2.0, 2.0, 2.0, 3.0, 8.0]


def test_components_and_ties(spark):
    v = spark.createDataFrame([(0, k) for k in range(9)] + [(1, 0)], "graph_id long, v int")
    b = spark.createDataFrame([(0, k, k + 1) for k in range(5)] + [(0, 7, 8)], "graph_id long, src int, trg int")
    for find in (graphs.components, graphs.components_at_large):
        got = {(r["graph_id"], r["v"]): r["component"] for r in find(v, b).collect()}
        assert got == {**{(0, k): 0 for k in range(6)}, (0, 6): 6, (0, 7): 7, (0, 8): 7, (1, 0): 0}
    t = spark.createDataFrame([(x,) for x in (9, 9, 9, 6, 5)], "n int")
    assert [graphs.top_with_ties(t, k, "n").count() for k in (0, 1, 3, 4)] == [0, 3, 3, 4]


def test_tables(spark, tmp_path):
    assert [tables.format_of(p) for p in ("a.csv", "b.TSV", "c.pqt", "d.parquet")] == ["csv", "tsv", "parquet", "parquet"]
    assert tables.format_of("x", ".CSV") == "csv"
    with pytest.raises(ValueError):
        tables.format_of("x.json")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for kind in ("csv", "tsv", "parquet"):
        tables.save_table(df, str(tmp_path / f"t.{kind}"))
        assert sorted(map(tuple, tables.load_table(spark, str(tmp_path / f"t.{kind}")).collect())) == [(1, "a"), (2, "b")]
    tables.write_json({"a": [1, None]}, str(tmp_path / "j"))
    assert tables.read_json(str(tmp_path / "j")) == {"a": [1, None]}


def test_stream_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 01:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts, IF(id % 2 = 0, 'a', 'b') AS event_type FROM range(6)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.label_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, streaming.label_counts(rows).collect()))


def test_numbers(spark):
    """In order, without gaps, over many ranges; and rows without a group are numbered so."""
    r = random.Random(5)
    keys = r.sample(range(10_000), 700)
    df = spark.createDataFrame([(k, f"d{k}") for k in keys], "k int, d string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {x["k"]: x["n"] for x in numbered(df, "n", "k").collect()}
    rows = features.canonical_columns(df, "d", order="k").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: n for n, k in enumerate(sorted(keys))}
    assert {x["data"]: x["group"] for x in rows} == {f"d{k}": n for k, n in got.items()}
    assert numbered(df.where("1 = 0"), "n", "k").collect() == []
