"""What keeps work in proportion: equal graphs are one, packed tables aren't broadcast, dictionaries have no fixed bound."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import growth
from graphloom.plans.shared import ranked, same_rows

GRAPH = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int,color:int>>, colors array<int>"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, g % 3, 0.5, [(0, 1, g % 2)], [g % 2, 1]) for g in range(12)]
    return spark.createDataFrame(rows, GRAPH).cache()


def test_neighbors_are_shuffled_and_equal_graphs_are_one(table):
    near, members = growth.with_neighbors(table)
    assert near.count() == 2 and members.count() == 12
    plan = growth.extensions(growth.single_vertices(near), near)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    found, _ = growth.mine(table, 2)
    at = {r["fragment"]: (r["n_graphs"], r["n_groups"], r["n_disjoint"], r["weight"]) for r in found.where("size = 2").collect()}
    assert set(at.values()) == {(6, 3, 6, 3.0)} and len(at) == 2
    pins = found.select("fragment")
    assert growth.locate(table, growth.tree_of(pins), pins).select("graph_id").distinct().count() == 12


def test_ranks_and_equal_rows(spark):
    df = spark.createDataFrame([(k, k % 4, [k % 4]) for k in range(40)], "k long, a int, b array<int>")
    distinct, members = same_rows(df, "k", ("a", "b"))
    names = {r["k"]: r["a"] for r in distinct.where("n_same = 10").collect()}
    assert len(names) == 4 and sorted(names.values()) == [0, 1, 2, 3]
    assert all(r["k"] % 4 == names[r["first"]] for r in members.collect()) and members.count() == 40
    got = ranked(df, "rank", {"a": -F.col("a")}).select("a", "rank").distinct().collect()
    assert {r["a"]: r["rank"] for r in got} == {3: 1, 2: 11, 1: 21, 0: 31}


def test_dictionary_of_any_length(monkeypatch, table):
    monkeypatch.setattr(growth, "MAX_FRAGMENTS", 1, raising=False)
    found, _ = growth.mine(table, 2, closed=True)
    assert found.count() > 1


def test_equal_graphs_are_searched_once(spark):
    from graphloom.operators import mining

    kind = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int>>, colors array<int>"
    g = spark.createDataFrame([(k // 2, k % 3, 0.5, [(0, 1)], [k % 2, 1]) for k in range(12)], kind)  # two graphs a row
    distinct, members = mining.distinct_graphs(g)
    assert [(r["n_same"], r["weight"]) for r in distinct.collect()] == [(6, 3.0)] * 2
    sizes = mining.for_all(members, distinct.selectExpr("graph_id", "colors[0] AS c")).groupBy("graph_id").agg(F.sum("c").alias("c"), F.count("c").alias("n"))
    assert [(r["c"], r["n"]) for r in sizes.collect()] == [(1, 2)] * 6
    found = mining.most_common(g, 2, min_count=3).where("size = 2").collect()
    assert sorted((r["weight"], r["n_groups"]) for r in found) == [(3.0, 3)] * 2


def test_batches_of_few_rows():
    import pyarrow as pa

    from graphloom.operators import mining

    b = pa.RecordBatch.from_pylist([{"k": k} for k in range(100)])
    out = list(mining.each([("k", pa.int64())], lambda r: ({"k": r["k"]} for _ in range(100)))(iter([b])))
    assert sum(x.num_rows for x in out) == 10_000 and max(x.num_rows for x in out) <= 4096
    assert [r["k"] for r in mining.few_rows(b)] == list(range(100))


def test_small_forms_at_sight():
    from graphloom.operators import kernels
    from graphloom.operators.bonded import bonded_search, bonded_text

    for a in range(3):
        assert kernels.canonical((a,), ()) == kernels._canonical((a,), ())
        for b in range(3):
            for bonds in (((0, 1),), ((1, 0),), (), ((0, 1), (1, 0))):
                assert kernels.canonical((a, b), bonds) == kernels._canonical((a, b), bonds)
            order = [0, 1] if a <= b else [1, 0]
            assert bonded_text([a, b], [(0, 1, 1)], order) == bonded_text([a, b], [(0, 1, 1)], bonded_search([a, b], [(0, 1, 1)])[0])


def test_idle_without_forms_of_all(spark):
    """Only fragments that can be dependent are canonised: of these pairs, one stands in one surrounding twice."""
    rows = [(0, 0, 1.0, [(0, 1, 0), (1, 2, 0)], [1, 2, 3]), (1, 0, 1.0, [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [1, 2, 3, 4])]
    rows += [(k, 0, 1.0, [(0, 1, 0), (1, 2, 0)], [5, 6, k]) for k in (7, 8)]
    near, _ = growth.with_neighbors(spark.createDataFrame(rows, GRAPH))
    more = growth.extensions(growth.single_vertices(near), near)
    at = growth.by_graph(growth.grown(more, growth.steps_of(more.select("parent", "op").distinct())))
    longer = growth.extensions(at.selectExpr("graph_id", "fragment", "explode(maps) AS m"), near)
    want = growth.dependent(at, longer, growth.steps_of(longer.select("parent", "op").distinct()))
    got = growth.idle_fragments(at, longer)
    assert {r[0] for r in got.collect()} == {r[0] for r in want.collect()} == {"0,1,0;1,2", "0,1,0;2,3", "0,1,0;3,4", "0,1,0;6,7", "0,1,0;6,8"}


def test_vertices_inside_pairs(spark):
    import random

    from graphloom.operators import structure

    r, rows = random.Random(5), [(900, None, [1]), (901, [], [])]
    for g in range(80):
        n = r.randint(1, 6)
        rows.append((g, [(a, b) if r.random() < 0.5 else (b, a) for a in range(n) for b in range(a) if r.random() < 0.4], [r.randint(0, 12) for _ in range(n)]))
    g = spark.createDataFrame(rows, "graph_id long, bonds array<struct<src:int,trg:int>>, colors array<int>")

    def table(df):
        return {(x["fragment"], x["child"]): x["n"] for x in df.groupBy("fragment", "child").agg(F.sum("n").alias("n")).collect()}

    assert table(structure._inside_pairs(g)) == table(structure._inside_larger(g, 1))


def test_rows_get_their_key_without_a_join(spark, monkeypatch):
    """Rows with null values keep their place, too, and values that share a hash are told apart."""
    from graphloom.plans import shared

    df = spark.createDataFrame([(k, None if k % 3 == 0 else [k % 3], 1.0) for k in range(12)], "k long, b array<int>, w double")
    distinct, members = same_rows(df, "k", ("b",), ("w",))
    assert "Join" not in members._jdf.queryExecution().executedPlan().toString()
    names = {r["k"]: r["b"] for r in distinct.collect()}
    assert {r["k"]: names[r["first"]] for r in members.collect()} == {r["k"]: r["b"] for r in df.collect()}
    monkeypatch.setattr(shared.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    distinct, members = same_rows(df, "k", ("b",), ("w",))
    names = {r["k"]: r["b"] for r in distinct.where("n_same = 4 AND w = 4").collect()}
    assert {r["k"]: names[r["first"]] for r in members.collect()} == {r["k"]: r["b"] for r in df.collect()}


def test_distinct_graphs_are_spread(table):
    from graphloom.operators import mining

    for distinct in (mining.distinct_graphs(table)[0], mining.counted_graphs(table)):
        assert distinct.rdd.getNumPartitions() == 4 and sorted(r["n_same"] for r in distinct.collect()) == [6, 6]


def test_batches_hold_little():
    """A graph may have thousands of partitions, so what is handed on goes by the entries of lists, too."""
    import pyarrow as pa

    from graphloom.operators import mining

    b = pa.RecordBatch.from_pylist([{"k": k} for k in range(100)])
    fields = [("parts", pa.list_(pa.list_(pa.int64())))]
    out = list(mining.each(fields, lambda r: [{"parts": [list(range(10))] * 1000}])(iter([b])))
    assert sum(x.num_rows for x in out) == 100 and max(x.num_rows for x in out) <= 6


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Four equal orders of five lines, the last two customers' and the others another's."""
    d = str(tmp_path_factory.mktemp("orders"))
    spark.sql("SELECT id AS o_orderkey, id DIV 2 AS o_custkey, 1.0D AS o_totalprice FROM range(4)").write.parquet(f"{d}/orders.parquet")
    lines = """SELECT id DIV 5 AS l_orderkey, id % 5 AS l_linenumber, 1 AS l_partkey, element_at(array(3, 4, 3, 3, 4), cast(id % 5 AS int) + 1) AS l_suppkey, 1 AS l_shipdate,
    1 AS l_extendedprice, 1 AS l_quantity, 1 AS l_discount, 1 AS l_tax, if(id % 5 = 1, 'N', 'R') AS l_returnflag, 'F' AS l_linestatus FROM range(20)"""
    spark.sql(lines).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_lines_are_gathered_once(spark, orders):
    """Chords come from a graph's own lines, so no lines are joined with lines."""
    from graphloom import registry

    g = registry._order_graphs(spark, orders)
    assert g._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # that of labels and their dictionary
    want = [(0, 1), (0, 2), (1, 2), (0, 3), (2, 3), (1, 4), (3, 4)]
    assert [[(b["src"], b["trg"]) for b in r["bonds"]] for r in g.collect()] == [want] * 4
    assert {(r["group"], r["weight"], tuple(r["colors"])) for r in g.collect()} in ({(k, 0.5, c) for k in (0, 1)} for c in ((0, 1, 0, 0, 0), (1, 0, 1, 1, 1)))


def test_equal_rows_are_parsed_once(spark, orders, monkeypatch):
    from graphloom import stage_queries
    from graphloom.model import GraphModel
    from graphloom.parsing import parsed
    from graphloom.stages import Stages

    seen, read = [], stage_queries.parsed_alternatives
    monkeypatch.setattr(stage_queries, "parsed_alternatives", lambda rows: (seen.append(rows.count()), read(rows))[1])
    assert stage_queries.several_graphs_a_row(spark, orders).groupBy("group_item").count().count() == 4 and seen == [1]
    model = GraphModel({"A": 0}, {}, {";0": (0, -1.5)}, coefficients={"y": {0: 2.0}}, stages=Stages(parse=lambda rows: (seen.append(rows.count()), parsed(rows))[1]))
    rows = spark.createDataFrame([(k, k % 2, ';["A"]' if k < 6 else ';["B"]') for k in range(8)], "group_item long, group long, data string")
    got = {(r["group_item"], r["group"], r["lweight_part"], r["pred_y"]) for r in model.evaluate(rows).collect()}
    assert got == {(k, k % 2, -1.5, 2.0) for k in range(6)} and seen == [1, 2]


def test_groups_are_counted_without_a_row_for_each_fragment(spark):
    from graphloom.operators import mining

    kind = "first long, number long"
    found = spark.createDataFrame([(f, n) for f in range(6) for n in range(200) if (n * 7 + f) % (f + 2) == 0], kind)
    members = spark.createDataFrame([(k % 7, None if k % 5 == 0 else k % 4) for k in range(40)], "first long, group long")
    want = found.join(members, "first").groupBy("number").agg(F.countDistinct("group").alias("n_groups")).where("n_groups > 0")
    got = mining._group_counts(found, members)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "count(distinct" not in plan


def test_fragments_of_no_group(spark):
    from graphloom.operators import mining

    kind = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int>>, colors array<int>"
    g = spark.createDataFrame([(k, None if k < 6 else k % 3, 1.0, [(0, 1)], [0, 1] if k < 6 else [2, 3]) for k in range(12)], kind)
    got = {r["fragment"]: (r["weight"], r["n_groups"]) for r in mining.most_common(g, 2).collect()}
    assert got == {";0": (6.0, 0), ";1": (6.0, 0), ";2": (6.0, 3), ";3": (6.0, 3), "0,1;2,3": (6.0, 3)}
