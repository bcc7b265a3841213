"""A fitted model: parse, colour, partition, filter and predict as one DataFrame plan, each row with its own state."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.features import FEATURES, state_rank
from .operators import dictionary, krylov, linear, mining, scoring
from .operators.tuning import Search
from .parsing import parsed  # noqa: F401 (the default parser, under its old name)
from .plans.shared import same_rows, spread, written
from .sources.tables import read_json, write_json
from .stages import Stages


#: Labels or features of a dictionary, at most.
MAX_LABELS = 1_000_000
GRAPH = ("group_item", "group_norm")
ROW = (*GRAPH, "part")


@dataclass
class GraphModel:
    """Label and feature dictionaries, fragments by canonical text with id and log-weight, and linear coefficients.

    `span` has the columns, norms and basis of what training rows span, which the filter lets pass; None: no filter.
    `stages` are what is replaced in `process`; those of registered types are saved with the model.
    """

    labels: dict[str, int]
    features: dict[str, int]
    fragments: dict[str, tuple[int, float]]
    max_size: int = 1
    coefficients: dict[str, dict[int, float]] = field(default_factory=dict)
    span: dict[str, list] | None = None
    stages: Stages = Stages()

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        data = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "stages"}
        write_json({"type": "graph-model-1", "data": {**data, "stages": self.stages.to_json()}}, path, spark)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> GraphModel:
        found = read_json(path, spark)
        if found.get("type") != "graph-model-1":
            raise ValueError(f"no model of a known type: {found.get('type')!r}")
        d = found["data"]
        ints = lambda x: {int(k): v for k, v in x.items()}
        d["fragments"] = {k: (i, w) for k, (i, w) in d["fragments"].items()}
        d["coefficients"] = {t: ints(c) for t, c in d["coefficients"].items()}
        d["stages"] = Stages.from_json(d.get("stages", {}))
        return GraphModel(**d)

    def final_features(self) -> list[str]:
        """What each column of a vector counts, in order: fragments by their text, then features by their name."""
        texts = [t for t, _ in sorted(self.fragments.items(), key=lambda x: x[1][0])]
        return [*texts, *sorted(self.features, key=self.features.get)]

    def parsed(self, rows: DataFrame, stages: Stages | None = None) -> DataFrame:
        """What the parser makes of the rows: labels, bonds, group_norm and weight_ug, and the state so far."""
        if "extern_feat" not in rows.columns:
            rows = rows.withColumn("extern_feat", F.lit(None).cast(FEATURES))
        g = (stages or self.stages).parse(rows)
        for name, value in (("group_norm", 0), ("weight_ug", 1.0)):
            g = g if name in g.columns else g.withColumn(name, F.lit(value))
        return g

    def process(self, rows: DataFrame, stages: Stages | None = None) -> DataFrame:
        """One row per input, graph and partition: group_item, group_norm, weight_ug, filter, lweight_part, cells (idx, value) and pred_<target>.

        `rows` has group_item (a long that tells rows apart), group, data (labelled graph text) and may have
        extern_feat. A row that fails keeps its place with the state of the stage that stopped it and null results.
        `stages` stand in for the model's own.
        """
        spark, stages = rows.sparkSession, stages or self.stages
        g = self.parsed(rows, stages)
        vertices = g.select(*GRAPH, F.posexplode("labels").alias("v", "label")).join(self._dictionary(spark, "labels"), "label", "left")
        cells = F.array_sort(F.collect_list(F.struct("v", "idx")))
        colors = vertices.groupBy(*GRAPH).agg(F.when(F.bool_and(F.col("idx").isNotNull()), F.transform(cells, lambda x: x["idx"])).alias("colors"))
        g = g.join(colors, list(GRAPH), "left")
        none = F.array().cast("array<struct<idx:int,count:bigint>>")
        if self.features:
            named = g.select(*GRAPH, F.explode("extern_feat").alias("f")).select(*GRAPH, F.col("f.name").alias("label"), F.col("f.count").alias("count"))
            named = named.join(self._dictionary(spark, "features"), "label", "left").groupBy(*GRAPH).agg(F.array_sort(F.collect_list(F.struct("idx", "count"))).alias("extras"))
            g = g.join(named, list(GRAPH), "left").withColumn("extras", F.coalesce("extras", none))
        else:
            unnamed = F.transform("extern_feat", lambda f: F.struct(F.lit(None).cast("int").alias("idx"), f["count"].alias("count")))
            g = g.withColumn("extras", F.coalesce(unnamed, none))
        unknown = (F.size("labels") > 0) & F.col("colors").isNull() | F.exists("extras", lambda f: f["idx"].isNull())
        g = g.withColumn("filter", F.when((F.col("filter") == "NONE") & unknown, "COLOR").otherwise(F.col("filter")))
        g = stages.color(g) if stages.color else g
        good = g.where("filter = 'NONE'").select(F.struct(*GRAPH).alias("graph_id"), "bonds", "colors")
        n, parts = len(self.fragments), stages.partition(good.where("size(colors) > 0"), self.fragments, self.max_size)
        out = g.join(parts.select("graph_id.*", *(c for c in parts.columns if c != "graph_id")), list(GRAPH), "left")
        # a row without a graph but with features has one partition, of log-weight 0
        bare = (F.col("filter") == "NONE") & (F.coalesce(F.size("labels"), F.lit(0)) == 0)
        out = out.withColumn("lweight_part", F.when(bare, 0.0).otherwise(F.col("lweight")))
        lost = (F.col("filter") == "NONE") & F.col("lweight_part").isNull()
        out = out.withColumn("filter", F.when(lost, "PARTITION").otherwise(F.col("filter")))
        own = F.transform(F.coalesce("frags", F.array().cast("array<struct<id:int,n:int>>")), lambda f: F.struct(f["id"].alias("idx"), f["n"].cast("double").alias("value")))
        more = F.transform("extras", lambda f: F.struct((f["idx"] + n).alias("idx"), f["count"].cast("double").alias("value")))
        out = out.withColumn("cells", F.when(F.col("filter") == "NONE", F.concat(own, more)))
        out = out.withColumn("part", F.coalesce("part", F.lit(0)))
        if self.span is not None:
            n_columns = len(self.span["columns"])
            ok = stages.in_span(long_cells(out), self.span["columns"], np.array(self.span["norms"]), np.array(self.span["basis"], float).reshape(n_columns, -1))
            out = out.withColumn("row_id", F.struct(*ROW)).join(ok, "row_id", "left").drop("row_id")
            out = out.withColumn("filter", F.when((F.col("filter") == "NONE") & ~F.coalesce("in_span", F.lit(True)), "FILTER").otherwise(F.col("filter"))).drop("in_span")
        for target, c in self.coefficients.items():
            # one row of data, not literals of the plan; a vector's columns are as many as the model's dictionaries
            row = spark.createDataFrame([([c.get(i, 0.0) for i in range(n + len(self.features))],)], "_weights array<double>")
            out = out.crossJoin(F.broadcast(row))
            total = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["value"] * F.coalesce(F.get("_weights", x["idx"]), F.lit(0.0)))
            out = out.withColumn(f"pred_{target}", F.when(F.col("filter") == "NONE", total)).drop("_weights")
        out = stages.predict(out) if stages.predict else out
        return out.drop("lweight", "frags", "extras", "bonds", "labels", "colors")

    def _dictionary(self, spark: SparkSession, kind: str) -> DataFrame:
        """(label, idx); Spark broadcasts it if it is small enough."""
        return spark.createDataFrame(list(getattr(self, kind).items()) or [("", -1)], "label string, idx int").where("idx >= 0")

    def explain(self, rows: DataFrame) -> DataFrame:
        """group_item, filter and reason of each input: what stopped it, in words; null for those that nothing stopped."""
        done = self.process(rows).groupBy("group_item").agg(F.max_by("filter", state_rank(F.col("filter"))).alias("filter"))
        labels = self.parsed(rows).select("group_item", F.explode("labels").alias("label")).distinct()
        found = labels.join(self._dictionary(rows.sparkSession, "labels"), "label", "left")
        unknown = F.collect_list(F.when(F.col("idx").isNull(), F.col("label")))
        found = found.groupBy("group_item").agg(F.array_sort(F.collect_list("label")).alias("labels"), F.array_sort(unknown).alias("unknown"))
        says = (
            F.when(F.col("filter") == "PARSE", "no graph text, or bonds beyond its vertices")
            .when((F.col("filter") == "COLOR") & (F.size("unknown") > 0), F.concat(F.lit("unknown labels: "), F.array_join("unknown", ", ")))
            .when(F.col("filter") == "COLOR", "unknown features")
            .when(F.col("filter") == "PARTITION", F.concat(F.lit("no partition into known fragments of: "), F.array_join("labels", ", ")))
            .when(F.col("filter") == "FILTER", "outside the span of the training rows")
        )
        return done.join(found, "group_item", "left").select("group_item", "filter", says.alias("reason"))

    def evaluate(self, rows: DataFrame, strict: bool = True) -> DataFrame:
        """One row per input: information (lweight_part) and predictions over all its partitions.

        Inputs that are equal but for group and group_item are one, and what the parser makes of them is written, so that
        it is parsed once. A stage that looks at these two needs `process`.
        """
        said = tuple(c for c in rows.columns if c not in ("group", "group_item"))
        distinct, members = same_rows(rows, "group_item", said)
        good = written(self.parsed(spread(distinct.withColumn("group", F.lit(None).cast(rows.schema["group"].dataType)), "group_item")), "parsed")
        done = self.process(good, replace(self.stages, parse=lambda g: g))
        found = scoring.compact(done, tuple(f"pred_{t}" for t in self.coefficients), strict).drop("group").withColumnRenamed("group_item", "first")
        return members.select("group", "group_item", "first").join(found, "first").drop("first")


def long_cells(rows: DataFrame) -> DataFrame:
    return rows.where("filter = 'NONE'").select(F.struct(*ROW).alias("row_id"), F.explode("cells").alias("c")).select("row_id", F.col("c.idx").alias("idx"), F.col("c.value").alias("value"))


def train(
    spark: SparkSession,
    rows: DataFrame,
    targets: tuple[str, ...] = (),
    min_count: int = 1,
    max_size: int = 1,
    limit: int | None = None,
    rounds: int = 5,
    prune: float = 0.0,
    filtered: bool = False,
    stages: Stages = Stages(),
    floor: float = -50.0,
    search: Search = Search(),
    tolerance: float | None = None,
    max_iterations: int = 10_000,
) -> GraphModel:
    """Fits dictionaries, fragments and a linear model for each target; rows that don't parse are left out.

    `rows` has group_item, group, weight, data, extern_feat if any, and value_<target> columns. A row that parses to
    several graphs trains with each by its share. `floor` is the least log-weight of a fragment, `search` limits the
    search for partitions. With a tolerance, linear models are solved by `krylov` iterations, of `max_iterations` at
    most, else on the driver; one that doesn't converge is an error. Dictionaries beyond MAX_LABELS are an error.
    """
    model = GraphModel({}, {}, {}, max_size, stages=stages)
    good = written(model.parsed(rows).where("filter = 'NONE'"), "parsed")
    seen = good.select("group", F.col("group_item").alias("item"), F.explode("labels").alias("label"), F.lit("label").alias("kind"))
    named = good.select("group", F.col("group_item").alias("item"), F.explode("extern_feat.name").alias("label"), F.lit("feature").alias("kind"))
    left = dictionary.mincount_cascade(seen.unionAll(named), min_count, "kind")
    counts = left.groupBy("kind", "label").agg(F.countDistinct("group").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels and features; set a larger min_count")
    for r in counts:
        names = model.labels if r["kind"] == "label" else model.features
        names[r["label"]] = len(names)
    items = left.select(F.col("item").alias("group_item")).distinct()
    good = written(good.join(items, "group_item", "left_semi"), "kept")
    colors = good.select(*GRAPH, F.posexplode("labels").alias("v", "label")).join(model._dictionary(spark, "labels"), "label")
    colors = colors.groupBy(*GRAPH).agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "idx"))), lambda x: x["idx"]).alias("colors"))
    graphs = good.join(colors, list(GRAPH)).select(F.col("group_item").alias("graph_id"), "group", (F.col("weight") * F.col("weight_ug")).alias("weight"), "bonds", "colors")
    model.fragments = mining.fit_fragments(graphs, max_size, limit, min_count, rounds, prune, floor, search=search)
    if targets or filtered:
        plain = good.drop("labels", "bonds", *GRAPH[1:], "weight_ug").dropDuplicates(["group_item"])
        done = written(model.process(plain), "vectors")
        cells = long_cells(done)
        if filtered:
            columns, norms, basis = linear.span_basis(cells)
            model.span = {"columns": columns, "norms": norms.tolist(), "basis": basis.tolist()}
        known = written(scoring.final_weights(done.where("filter = 'NONE'")), "weighted") if targets else None
        for t in targets:
            y = known.select(F.struct(*ROW).alias("row_id"), F.col("final_weight").alias("weight"), F.col(f"value_{t}").alias("y"))
            missing = good.where(F.col(f"value_{t}").isNull()).select("group_item").distinct().count()
            if missing:
                warnings.warn(f"{missing} rows have no value of {t!r} and are left out of its model", stacklevel=2)
            if tolerance is None:
                model.coefficients[t] = linear.least_squares(cells, y)
            else:
                model.coefficients[t] = krylov.solved(cells, y, tolerance, max_iterations)
    return model
