"""python -m graphloom.cli: train, map, eval and debug."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.features import canonical_columns, decode_features, encode_features
from .model import GraphModel, train
from .operators.tuning import Search
from .plans.shared import written
from .sources.tables import load_table, save_table
from .stages import Alternatives, Best, Stages


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    columns = argparse.ArgumentParser(add_help=False)
    for name in ("data", "group", "weight", "feature"):
        columns.add_argument(f"--{name}-column", default="data" if name == "data" else None)
    columns.add_argument("--input-format")
    t = sub.add_parser("train", parents=[columns])
    t.add_argument("data")
    t.add_argument("outfile")
    t.add_argument("--target-column", action="append", default=[])
    t.add_argument("--min-count", type=int, default=1)
    t.add_argument("--enable-part", action="store_true")
    t.add_argument("--max-ssize", type=int, default=1)
    t.add_argument("--slimit", type=int)
    t.add_argument("--train-iter", type=int, default=5)
    t.add_argument("--prune-frac", type=float, default=0.0)
    t.add_argument("--filter", action="store_true")
    t.add_argument("--min-part-weight", type=float, default=-50.0, help="least log-weight of a fragment")
    t.add_argument("--plimit", type=int, default=64, help="partitions of a graph that are looked at; 0: all")
    t.add_argument("--max-iter", type=int, default=65536, help="states of a search for partitions; 0: any number")
    t.add_argument("--max-heap", type=int, default=65536, help="states that a search keeps; 0: any number")
    t.add_argument("--fit-tolerance", type=float, help="solve linear models by iteration, to this tolerance")
    t.add_argument("--fit-iter-lim", type=int, default=10_000)
    t.add_argument("--alternatives", action="store_true", help="labels may be lists of alternatives")
    m = sub.add_parser("map", parents=[columns])
    for name in ("model", "datafile", "outfile"):
        m.add_argument(name)
    m.add_argument("--format")
    m.add_argument("--compact", action="store_true")
    e = sub.add_parser("eval")
    e.add_argument("what", choices=("label", "filter", "info", "predict", "debug", "explain", "features"))
    e.add_argument("model")
    e.add_argument("graph")
    e.add_argument("target", nargs="?")
    e.add_argument("--features")
    return p


def _rows(spark: SparkSession, a, path: str):
    df = load_table(spark, path, a.input_format)
    rows = canonical_columns(df, a.data_column, a.group_column, a.weight_column, a.feature_column, tuple(getattr(a, "target_column", ())))
    return written(rows.withColumn("group_item", F.monotonically_increasing_id()), "rows")  # numbers that stay, however often they are read


def evaluate(spark: SparkSession, model: GraphModel, what: str, graph: str, target: str | None = None, features: str | None = None):
    """One graph's labels, features, state, information or prediction; None if it has none.

    debug and explain say why it was rejected, by unknown labels and in words. A graph with several readings has a list of labels for each; its state is the worst of theirs.
    """
    row = spark.createDataFrame([(0, 0, 1.0, graph, features)], "group_item long, group long, weight double, data string, f string")
    row = row.withColumn("extern_feat", decode_features(F.col("f"))).drop("f")
    if what == "label":
        found = [r["labels"] for r in model.parsed(row).orderBy("group_norm").select("labels").collect()]
        return found[0] if len(found) == 1 else found
    if what == "features":
        cells = [c for r in model.process(row).where("group_norm = 0 AND part = 0").select("cells").collect() for c in r["cells"] or ()]
        names = model.final_features()
        return {names[c["idx"]]: c["value"] for c in cells} or None
    if what in ("filter", "debug", "explain"):
        said = model.explain(row).first()
        labels = {x for r in model.parsed(row).select("labels").collect() for x in r["labels"] or ()}
        more = {"debug": {"unknown_labels": sorted(labels - model.labels.keys())}, "explain": {"reason": said["reason"]}}
        return said["filter"] if what == "filter" else {"filter": said["filter"], **more[what]}
    found = model.evaluate(row).first()
    if found is None:
        return None
    return found["lweight_part"] if what == "info" else found[f"pred_{target}"]


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "train":
        size = a.max_ssize if a.enable_part else 1
        search = Search(a.plimit or None, a.max_iter or None, a.max_heap or None)
        parse = {"parse": Alternatives()} if a.alternatives else {}
        model = train(
            spark, _rows(spark, a, a.data), tuple(a.target_column), a.min_count, size, a.slimit, a.train_iter, a.prune_frac, a.filter,
            Stages(partition=Best(search.limit, search.max_iter, search.max_heap), **parse), a.min_part_weight, search, a.fit_tolerance, a.fit_iter_lim,
        )
        model.save(a.outfile)
    elif a.command == "map":
        model, rows = GraphModel.load(a.model), _rows(spark, a, a.datafile)
        out = model.evaluate(rows) if a.compact else model.process(rows)
        flat = out if a.compact else out.withColumn("extern_feat", encode_features(F.col("extern_feat"))).withColumn("cells", F.to_json("cells"))
        save_table(flat, a.outfile, a.format)
    else:
        found = evaluate(spark, GraphModel.load(a.model), a.what, a.graph, a.target, a.features)
        print(json.dumps(found))
        return 0 if found is not None else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
