"""Rows that are several graphs, stages saved with a model, and solvers, against plain loops and numpy."""

import itertools
import json
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.model import GraphModel, train
from graphloom.operators import krylov, linear
from graphloom.operators.bonded import canonical_typed
from graphloom.parsing import parsed_alternatives, readings
from graphloom.stages import Alternatives, Best, Bounded, Every, Share, Stages, Within, stage

FEATURES = "array<struct<name:string,count:bigint>>"


def text(bonds, labels):
    return ",".join(f"{a},{b}" for a, b in bonds) + ";" + json.dumps(labels)


def test_readings():
    ring = [(0, 1), (1, 2), (2, 0)]
    got = readings(text(ring, [["A", "B"], ["A", "B"], "A"]))
    forms = [canonical_typed(g["labels"], [(b["src"], b["trg"]) for b in g["bonds"]]) for g in got]
    want = Counter(canonical_typed([*c, "A"], ring) for c in itertools.product("AB", "AB"))
    assert forms == list(want) and [g["weight_ug"] for g in got] == [n / 4 for n in want.values()]
    assert [sorted(g["labels"]) for g in got] == [["A", "A", "A"], ["A", "A", "B"], ["A", "B", "B"]]
    assert [g["weight_ug"] for g in readings(';[["A", "A", "B"]]')] == [2 / 3, 1 / 3]
    many = text([], [["A", "B"]] * 12)
    assert len(readings(many)) == 13 and readings(many, 4095) is None
    for bad in (None, "", "x", ";", ";[]", ";[[]]", ";[1]", ';["A", [2]]', '0;["A"]', '0,1;["A"]', '-1,0;["A"]', 'a,b;["A","B"]', ';{"A": 1}'):
        assert readings(bad) is None


def test_rows_of_several_graphs(spark):
    rows = [(1, text([(0, 1)], [["A", "B"], "C"]), None), (2, "no graph", None), (3, None, [("x", 1)]), (4, None, None), (5, ';["A"]', None), (5, ';["A"]', None), (None, ';[["A","B"]]', None)]
    df = spark.createDataFrame(rows, f"group_item long, data string, extern_feat {FEATURES}").withColumn("part", F.lit("clash"))
    got = [(r.group_item, r.group_norm, r.weight_ug, tuple(r.labels or ()), r.filter) for r in parsed_alternatives(df).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(
        [
            (1, 0, 0.5, ("A", "C"), "NONE"), (1, 1, 0.5, ("B", "C"), "NONE"), (2, 0, 1.0, (), "PARSE"), (3, 0, 1.0, (), "NONE"), (4, 0, 1.0, (), "PARSE"),
            (5, 0, 1.0, ("A",), "NONE"), (5, 0, 1.0, ("A",), "NONE"), (None, 0, 0.5, ("A",), "NONE"), (None, 1, 0.5, ("B",), "NONE"),
        ],
        key=key,
    )
    assert parsed_alternatives(df.where("1 = 0")).collect() == []


def test_averages_over_readings(spark):
    """Information and predictions of a row are those of its readings by their shares; one unknown reading spoils it."""
    model = GraphModel({"A": 0, "B": 1}, {"x": 0}, {";0": (0, -1.0), ";1": (1, -2.0), "0,1;0,1": (2, -2.5)}, 2, {"y": {0: 1.0, 1: 10.0, 2: 100.0, 3: 1000.0}}, stages=Stages(parse=Alternatives()))
    rows = [(1, 1, text([(0, 1)], [["A", "B"], "A"]), None), (2, 2, text([], [["A", "Z"]]), None), (3, 3, text([], [["B", "B"]]), [("x", 2)]), (4, 4, None, [("x", 1)])]
    df = spark.createDataFrame(rows, f"group_item long, group long, data string, extern_feat {FEATURES}")
    got = {r.group_item: (r.lweight_part, r.pred_y) for r in model.evaluate(df).collect()}
    split, whole = math.exp(-3.0), math.exp(-2.5)
    mixed = (split * 11 + whole * 100) / (split + whole)
    assert got.keys() == {1, 3, 4}
    assert np.allclose(got[1], ((-2.0 + math.log(split + whole)) / 2, (2.0 + mixed) / 2))
    assert np.allclose(got[3], (-2.0, 10.0 + 2000.0)) and np.allclose(got[4], (0.0, 1000.0))
    states = Counter((r.group_item, r.filter) for r in model.process(df).select("group_item", "group_norm", "filter").distinct().collect())
    assert states == {(1, "NONE"): 2, (2, "NONE"): 1, (2, "COLOR"): 1, (3, "NONE"): 1, (4, "NONE"): 1}
    reasons = {r.group_item: r.reason for r in model.explain(df).collect()}
    assert reasons == {1: None, 2: "unknown labels: Z", 3: None, 4: None}
    assert model.final_features() == [";0", ";1", "0,1;0,1", "x"]


def test_training_with_readings(spark):
    """A reading counts by its share, in the weights of fragments and in the fit."""
    rows = [(0, 0, 1.0, text([], [["A", "B"]]), 3.0), (1, 1, 1.0, text([], ["A"]), 1.0), (2, 2, 1.0, text([], ["B"]), 5.0)]
    df = spark.createDataFrame(rows, "group_item long, group long, weight double, data string, value_y double")
    for tolerance in (None, 1e-12):
        model = train(spark, df, ("y",), stages=Stages(parse=Alternatives()), tolerance=tolerance)
        assert np.allclose([w for _, w in model.fragments.values()], math.log(0.5))
        got = {r.group_item: r.pred_y for r in model.evaluate(df).collect()}
        a, b = (0.5 * 3 + 1) / 1.5, (0.5 * 3 + 5) / 1.5
        assert np.allclose([got[0], got[1], got[2]], [(a + b) / 2, a, b])


@stage("color", "test only: nothing")
@dataclass(frozen=True)
class Nothing:
    state: str = "COLOR"

    def __call__(self, rows):
        return rows.withColumn("filter", F.lit(self.state))


def test_stages_are_saved(spark, tmp_path):
    stages = Stages(Alternatives(9), Nothing("PARTITION"), Share(0.25), Within(1e-3), Bounded(None, 2.0))
    GraphModel({"A": 0}, {}, {";0": (0, 0.0)}, stages=stages).save(str(tmp_path / "m"))
    model = GraphModel.load(str(tmp_path / "m"))
    assert model.stages == stages
    df = spark.createDataFrame([(1, 1, ';["A"]')], "group_item long, group long, data string")
    assert [r.filter for r in model.process(df).collect()] == ["PARTITION"]
    assert [r.filter for r in model.process(df, Stages()).collect()] == ["NONE"]
    plain = GraphModel({}, {}, {})
    plain.save(str(tmp_path / "p"))
    assert GraphModel.load(str(tmp_path / "p")).stages == Stages()


def test_stages_of_no_known_type(tmp_path):
    with pytest.raises(ValueError):
        GraphModel({}, {}, {}, stages=Stages(predict=lambda rows: rows)).save(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        Stages.from_json({"parse": {"type": "nobody's", "data": {}}})
    with pytest.raises(ValueError):
        stage("parse", "alternatives")(Nothing)
    with pytest.raises(ValueError):
        stage("nothing", "x")


def test_stages_of_partitions(spark):
    model = GraphModel({"A": 0}, {}, {";0": (0, -1.0), "0,1;0,0": (1, -1.5)}, 2, {"y": {0: 1.0, 1: 4.0}})
    df = spark.createDataFrame([(1, 1, '0,1,1,2;["A","A","A"]')], "group_item long, group long, data string")
    number = lambda s: model.process(df, Stages(partition=s)).count()
    assert [number(s) for s in (Every(), Best(limit=2), Best(limit=None), Best(max_iter=1), Share(0.0), Share(1.0))] == [3, 2, 3, 1, 3, 1]
    got = {r.pred_y for r in model.process(df, Stages(predict=Bounded(4.0, 4.5))).collect()}
    assert got == {4.0, 4.5}


def system(spark, a, y, w):
    cells = spark.createDataFrame([(r, c * 10, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]], "row_id long, idx int, value double")
    targets = spark.createDataFrame([(r, float(w[r]), None if np.isnan(y[r]) else float(y[r])) for r in range(len(y))], "row_id long, weight double, y double")
    return cells, targets


@pytest.mark.parametrize("rank", [6, 4])
def test_iterations(spark, rank):
    r = np.random.default_rng(rank)
    a = r.normal(size=(40, rank)) @ r.normal(size=(rank, 6)) if rank < 6 else r.normal(size=(40, 6)) * (r.random((40, 6)) < 0.7)
    y, w = r.normal(size=40), r.random(40) + 0.1
    y[3], w[5] = np.nan, 1e-30
    cells, targets = system(spark, a, y, w)
    keep = [k for k in range(40) if k not in (3, 5)]
    root = np.sqrt(w[keep])
    b = a[keep] * root[:, None]
    scale = np.linalg.norm(b, axis=0)
    want = np.linalg.lstsq(b / scale, y[keep] * root, rcond=1e-10)[0] / scale
    found = krylov.least_squares(cells, targets, 1e-12)
    assert found.stop == krylov.LEAST and found.converged and found.steps <= 12
    assert np.allclose([found.coefficients[c * 10] for c in range(6)], want, rtol=1e-6, atol=1e-9)
    assert math.isclose(found.residual, np.linalg.norm(b @ want - y[keep] * root), rel_tol=1e-6)
    direct = linear.least_squares(cells, targets)
    assert np.allclose([found.coefficients[c] for c in direct], list(direct.values()), rtol=1e-5, atol=1e-8)
    short = krylov.least_squares(cells, targets, 1e-12, max_iterations=1)
    assert short.stop == krylov.LIMIT and not short.converged and not krylov.meets(cells, targets)
    with pytest.raises(ValueError):
        krylov.solved(cells, targets, 1e-12, max_iterations=1)


def test_systems_that_are_met(spark):
    r = np.random.default_rng(9)
    a, x = r.normal(size=(12, 4)), r.normal(size=4)
    cells, targets = system(spark, a, a @ x, np.ones(12))
    found = krylov.least_squares(cells, targets, 1e-9)
    assert found.stop == krylov.COMPATIBLE and krylov.meets(cells, targets) and np.allclose(list(found.coefficients.values()), x, rtol=1e-6)
    nothing = krylov.least_squares(*system(spark, a, np.zeros(12), np.ones(12)))
    assert nothing.stop == krylov.ZERO and set(nothing.coefficients.values()) == {0.0}
    assert krylov.least_squares(cells, targets.where("1 = 0")).coefficients == {}


def test_covariance_groups(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=(50, 9))
    a[:, 4] = a[:, 0] + a[:, 1]
    a[:, 6] = 3 * a[:, 5]
    cells, _ = system(spark, a, np.zeros(50), np.ones(50))
    assert linear.covariance_groups(linear.scaled_gram(cells)) == [[0, 10, 40], [50, 60]]
    assert linear.covariance_groups(linear.scaled_gram(cells.where("idx NOT IN (40, 60)"))) == []
    assert linear.covariance_groups(linear.scaled_gram(cells.where("1 = 0"))) == []
