"""Queries on rows that are several graphs, stages that are saved with a model, and iterative solvers."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import OV, order_lines, query, rounded
from .model import GraphModel
from .operators import krylov, linear
from .operators.mining import each
from .parsing import parsed_alternatives
from .plans.shared import for_members, same_rows, shared_folder, spread
from .registry import _CELLS, _cells, _solved_sql, _targets
from .stages import Alternatives, Best, Bounded, Stages
from .table_queries import _EVALUATED, _NAMES, _VALUES, _rows, _small_model

#: Lines of every third supplier may also have this label.
OTHER = "AF"


def _uncertain_rows(spark, sf_dir) -> DataFrame:
    """Path graphs as text, with a list of labels where there is a choice."""
    v = order_lines(spark, sf_dir)
    one = F.to_json(F.array("label"))
    name = F.when(F.col("supplier") % 3 == 0, F.to_json(F.array("label", F.lit(OTHER)))).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))
    lines = F.array_sort(F.collect_list(F.struct("v", name.alias("name"))))
    g = v.groupBy("graph_id").agg(F.first("group").alias("group"), lines.alias("lines"))
    bonds = F.array_join(F.transform(F.filter("lines", lambda x: x["v"] > 0), lambda x: F.concat_ws(",", x["v"] - 1, x["v"])), ",")
    text = F.concat(bonds, F.lit(";["), F.array_join(F.transform("lines", lambda x: x["name"]), ","), F.lit("]"))
    return g.select(F.col("graph_id").alias("group_item"), "group", text.alias("data"))


def _path_names(df: DataFrame) -> DataFrame:
    """The labels of path graphs along the path, from the end that gives the smaller text."""

    def kernel(r):
        near: dict[int, list[int]] = {v: [] for v in range(len(r["labels"]))}
        for b in r["bonds"]:
            near[b["src"]].append(b["trg"])
            near[b["trg"]].append(b["src"])
        walk = [next(v for v in near if len(near[v]) <= 1)]
        while len(walk) < len(near):
            walk.append(next(w for w in near[walk[-1]] if w not in walk))
        names = ["-".join(r["labels"][v] for v in x) for x in (walk, walk[::-1])]
        yield {"group_item": r["group_item"], "group_norm": r["group_norm"], "weight_ug": r["weight_ug"], "name": min(names)}

    fields = [("group_item", pa.int64()), ("group_norm", pa.int32()), ("weight_ug", pa.float64()), ("name", pa.string())]
    return df.select("group_item", "group_norm", "weight_ug", "labels", "bonds").mapInArrow(each(fields, kernel), "group_item bigint, group_norm int, weight_ug double, name string")


@query(f"""WITH RECURSIVE {OV}, len AS (SELECT graph_id, count(*) AS n FROM ov GROUP BY graph_id),
alts AS (SELECT graph_id, v, label, 0 AS j, CASE WHEN supplier % 3 = 0 THEN 2 ELSE 1 END AS m FROM ov UNION ALL SELECT graph_id, v, '{OTHER}', 1, 2 FROM ov WHERE supplier % 3 = 0),
r AS (SELECT graph_id, 0 AS v, '' AS a, '' AS b, 0::BIGINT AS k FROM len UNION ALL SELECT graph_id, r.v + 1, a || CASE WHEN r.v > 0 THEN '-' ELSE '' END || label,
label || CASE WHEN r.v > 0 THEN '-' ELSE '' END || b, k * m + j FROM r JOIN alts USING (graph_id) WHERE alts.v = r.v),
g AS (SELECT graph_id, least(a, b) AS name, count(*) AS c, min(k) AS first FROM r JOIN len USING (graph_id) WHERE v = n GROUP BY graph_id, least(a, b))
SELECT graph_id AS group_item, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS INT) AS group_norm, round(c / sum(c) OVER (PARTITION BY graph_id), 6) AS weight_ug, name FROM g""")
def several_graphs_a_row(spark, sf_dir) -> DataFrame:
    """Each row's readings, isomorphic ones as one, with their shares, in the order in which choices give them."""
    texts, members = same_rows(_uncertain_rows(spark, sf_dir), "group_item", ("data",))
    texts = spread(texts, "group_item").withColumn("extern_feat", F.lit(None).cast("array<struct<name:string,count:bigint>>"))
    found = _path_names(parsed_alternatives(texts)).withColumn("weight_ug", rounded("weight_ug"))
    return for_members(members, found, "group_item")


@query(f"""WITH {OV}, m AS (SELECT * FROM (VALUES {_VALUES}) t(label, w, b)), k AS (SELECT graph_id FROM ov GROUP BY graph_id HAVING bool_and(label IN ({_NAMES}))),
o AS (SELECT w, b FROM m WHERE label = '{OTHER}'), x AS (SELECT ov.graph_id, grp, CASE WHEN supplier % 3 = 0 THEN (m.w + o.w) / 2 ELSE m.w END AS w, CASE WHEN supplier % 3 = 0 THEN (m.b + o.b) / 2 ELSE m.b END AS b
FROM ov JOIN k USING (graph_id) JOIN m USING (label), o)
SELECT grp AS "group", graph_id AS group_item, round(sum(w), 6) AS lweight_part, round(sum(b), 6) AS pred_y FROM x GROUP BY grp, graph_id""")
def evaluate_several_graphs(spark, sf_dir) -> DataFrame:
    """Information and prediction averaged over a row's readings, by a model that was saved with its parser."""
    model = _small_model()
    model.stages = Stages(parse=Alternatives())
    return _saved(spark, model).evaluate(_uncertain_rows(spark, sf_dir)).withColumns({c: rounded(c) for c in ("lweight_part", "pred_y")})


def _saved(spark, model: GraphModel) -> GraphModel:
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-model"
    model.save(path, spark)
    return GraphModel.load(path, spark)


@query(f'SELECT "group", group_item, lweight_part, least(greatest(pred_y, 0.5), 3.0) AS pred_y FROM ({_EVALUATED})')
def model_stages_saved(spark, sf_dir) -> DataFrame:
    """A model with a partition search and a prediction of registered types, written and read again."""
    model = _small_model()
    model.stages = Stages(partition=Best(limit=1), predict=Bounded(0.5, 3.0))
    return _saved(spark, model).evaluate(_rows(spark, sf_dir)).withColumns({c: rounded(c) for c in ("lweight_part", "pred_y")})


@query(_solved_sql())
def krylov_least_squares(spark, sf_dir) -> DataFrame:
    """The weighted fit by iteration."""
    found = krylov.solved(_cells(spark, sf_dir), _targets(spark, sf_dir), 1e-12)
    return spark.createDataFrame(sorted(found.items()), "idx int, coef double").withColumn("coef", rounded("coef", 4))


@query(f"""WITH {_CELLS} SELECT DISTINCT CAST(unnest(CASE WHEN idx = 0 THEN [0, 100] WHEN idx = 1 THEN [1, 101] WHEN idx = 2 THEN [2, 101] END) AS INT) AS idx,
CAST(CASE WHEN idx = 0 THEN 0 ELSE 1 END AS INT) AS first FROM c WHERE idx <= 2""")
def covariance_groups(spark, sf_dir) -> DataFrame:
    """Columns that can't be told apart after two were added: twice the first one, and the sum of the next two."""
    cells = _cells(spark, sf_dir)
    added = cells.where("idx = 0").withColumns({"idx": F.lit(100), "value": F.col("value") * 2})
    both = cells.where("idx IN (1, 2)").groupBy("row_id").agg(F.sum("value").alias("value")).select("row_id", F.lit(101).alias("idx"), "value")
    every = cells.select("row_id", "idx", "value").unionByName(added.select("row_id", "idx", "value")).unionByName(both)
    groups = linear.covariance_groups(linear.scaled_gram(every))
    return spark.createDataFrame([(i, g[0]) for g in groups for i in g], "idx int, first int")
