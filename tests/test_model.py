import math

import pytest
from pyspark.sql import functions as F

from graphloom.cli import evaluate, main
from graphloom.model import GraphModel, Stages, parsed, train
from graphloom.operators import mining
from graphloom.stages import Alternatives, Best

# Rows and a query whose information and prediction must come out as below.
ROWS = [
    (0, 1, 0.5, '0,1;["A","A"]', -20.24), (1, 2, 1.0, '0,1,1,2;["A","B","A"]', -24.82), (2, 3, 1.0, '0,1,1,2,2,3;["A","B","B","A"]', -30.15),
    (3, 4, 1.0, '0,1,1,2;["A","C","D"]', -56.2), (4, 5, 1.0, '0,1,1,2,2,3;["D","C","C","D"]', -92.4), (5, 6, 1.0, '0,1,1,2,2,3,3,4;["D","C","B","C","D"]', -104.04),
]
BUTANOL = '0,1,1,2,2,3,3,4;["A","B","B","C","D"]'


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "group_item long, group long, weight double, data string, value_h double")


def test_single_labels(spark, rows, tmp_path):
    model = train(spark, rows.withColumn("weight", F.lit(1.0)), ("h",), filtered=True)
    model.save(str(tmp_path / "m"))
    model = GraphModel.load(str(tmp_path / "m"))
    assert math.isclose(evaluate(spark, model, "info", BUTANOL), -7.2852374924538195, rel_tol=1e-9)
    assert math.isclose(evaluate(spark, model, "predict", BUTANOL, "h"), -69.59441860465111, rel_tol=1e-6)
    assert evaluate(spark, model, "filter", BUTANOL) == "NONE"
    assert evaluate(spark, model, "label", BUTANOL) == ["A", "B", "B", "C", "D"]
    assert evaluate(spark, model, "debug", '0,1;["A","Z"]') == {"filter": "COLOR", "unknown_labels": ["Z"]}
    assert evaluate(spark, model, "explain", '0,1;["A","Z"]') == {"filter": "COLOR", "reason": "unknown labels: Z"}
    assert evaluate(spark, model, "features", BUTANOL) == {f";{model.labels[x]}": float(n) for x, n in (("A", 1), ("B", 2), ("C", 1), ("D", 1))}
    assert evaluate(spark, model, "info", '0,1;["A","Z"]') is None
    for bad in ("", "x", "0,5;[\"A\"]", ";[]"):
        assert evaluate(spark, model, "filter", bad) == "PARSE"


def test_larger_fragments(spark, rows):
    model = train(spark, rows, (), min_count=2, max_size=2)
    out = model.process(rows).where("filter = 'NONE'")
    assert out.select("group_item").distinct().count() >= 4
    whole = model.evaluate(rows)
    assert whole.where("lweight_part > 0").count() == 0


def test_features_and_weights(spark):
    rows = spark.createDataFrame(
        [(0, 0, 1.0, ';["A"]', [("x", 2)], 3.0), (1, 1, 1.0, ';["A"]', [("x", 4)], 5.0), (2, 2, 1.0, None, [("x", 1)], 1.0), (3, 3, 1.0, None, None, 9.0)],
        "group_item long, group long, weight double, data string, extern_feat array<struct<name:string,count:bigint>>, value_y double",
    )
    model = train(spark, rows, ("y",))
    got = {r["group_item"]: r["pred_y"] for r in model.evaluate(rows).collect()}
    assert set(got) == {0, 1, 2} and all(math.isclose(got[k], v, rel_tol=1e-6) for k, v in {0: 3.0, 1: 5.0, 2: 1.0}.items())
    states = {r["group_item"]: r["filter"] for r in model.process(rows).collect()}
    assert states == {0: "NONE", 1: "NONE", 2: "NONE", 3: "PARSE"}


def test_command_line(spark, rows, tmp_path, capsys):
    rows.drop("group_item").coalesce(1).write.csv(str(tmp_path / "in.csv"), header=True, escape='"')
    path, model = str(tmp_path / "in.csv"), str(tmp_path / "model")
    assert main(["train", path, model, "--group-column", "group", "--target-column", "value_h"]) == 0
    assert main(["map", model, path, str(tmp_path / "out.parquet"), "--compact", "--group-column", "group"]) == 0
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 6
    capsys.readouterr()
    assert main(["eval", "filter", model, BUTANOL]) == 0 and "NONE" in capsys.readouterr().out
    assert main(["eval", "info", model, ';["unknown"]']) == 1
    more = ["--enable-part", "--max-ssize", "2", "--prune-frac", "0.3", "--plimit", "0", "--max-iter", "0", "--max-heap", "0", "--min-part-weight", "-20"]
    assert main(["train", path, model, "--group-column", "group", "--target-column", "value_h", "--alternatives", "--fit-tolerance", "1e-10", *more]) == 0
    found = GraphModel.load(model)
    assert found.stages == Stages(parse=Alternatives(), partition=Best(None, None, None)) and all(w >= -21 for _, w in found.fragments.values())
    assert evaluate(spark, found, "label", ';[["A","B"]]') == [["A"], ["B"]]


def test_replaced_stages(spark):
    model = GraphModel({"A": 0}, {}, {";0": (0, -1.0)}, 1, {"y": {0: 2.0}})
    data = spark.createDataFrame([(0, 0, "A A A"), (1, 1, "B")], "group_item long, group long, data string")
    as_labels = lambda df: parsed(df.withColumn("data", F.concat(F.lit(";"), F.to_json(F.split("data", " ")))))
    half = lambda df: df.withColumn("pred_y", F.col("pred_y") / 2)
    first = lambda *x: mining.partitions(*x, limit=1)
    got = {r["group_item"]: (r["filter"], r["lweight_part"], r["pred_y"]) for r in model.process(data, Stages(as_labels, partition=first, predict=half)).collect()}
    assert got == {0: ("NONE", -3.0, 3.0), 1: ("COLOR", None, None)}
    assert {r["group_item"]: r["filter"] for r in model.process(data).collect()} == {0: "PARSE", 1: "PARSE"}
