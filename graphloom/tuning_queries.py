"""Queries on tuning by loss, on the path graphs of `path_queries`, where sums over all partitions follow by recursion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, rounded
from .operators import mining, tuning
from .path_queries import N_COLORS, RUNS, _model, _named, _path_graphs, structure_name

FLOOR, SHARE, ROUNDS = -100.0, 0.3, 2
ALL = tuning.Search(None, None, None)


def _start_sql() -> str:
    rows = [f"({i}, '{'-'.join(map(str, structure_name(t)))}', {w!r}::DOUBLE)" for t, (i, w) in _model().items()]
    return f"""RECURSIVE {RUNS}, m0 AS (SELECT * FROM (VALUES {', '.join(rows)}) t(id, name, lw)),
len AS (SELECT graph_id, count(*) AS n, any_value(weight) AS gw FROM pv GROUP BY graph_id)"""


def _em_sql(k: int) -> str:
    """m{k + 1}: the model after one round from m{k}; t: tiles, f and b: sums over tilings before and from a line on."""
    return f"""t{k} AS (SELECT graph_id, v, size, id, lw FROM runs JOIN m{k} USING (name) WHERE size <= 2),
f{k} AS (SELECT graph_id, 0 AS v, 1.0::DOUBLE AS z, 0.0::DOUBLE AS z0 FROM len
UNION ALL SELECT f.graph_id, f.v + 1, f.z * exp(a.lw) + CASE WHEN b.lw IS NULL THEN 0 ELSE f.z0 * exp(b.lw) END, f.z
FROM f{k} f JOIN t{k} a ON a.graph_id = f.graph_id AND a.v = f.v AND a.size = 1 LEFT JOIN t{k} b ON b.graph_id = f.graph_id AND b.v = f.v - 1 AND b.size = 2),
b{k} AS (SELECT graph_id, n AS v, 1.0::DOUBLE AS z, 0.0::DOUBLE AS z0 FROM len
UNION ALL SELECT f.graph_id, f.v - 1, f.z * exp(a.lw) + CASE WHEN b.lw IS NULL THEN 0 ELSE f.z0 * exp(b.lw) END, f.z
FROM b{k} f JOIN t{k} a ON a.graph_id = f.graph_id AND a.v = f.v - 1 AND a.size = 1 LEFT JOIN t{k} b ON b.graph_id = f.graph_id AND b.v = f.v - 1 AND b.size = 2),
ms{k} AS (SELECT id, sum(gw * f.z * exp(lw) * b.z / e.z) AS mass FROM t{k} t JOIN len USING (graph_id) JOIN f{k} f ON f.graph_id = t.graph_id AND f.v = t.v
JOIN b{k} b ON b.graph_id = t.graph_id AND b.v = t.v + t.size JOIN f{k} e ON e.graph_id = t.graph_id AND e.v = len.n GROUP BY id),
r{k} AS (SELECT m.id, name, coalesce(greatest(ln(mass / (SELECT sum(mass) FROM ms{k})), {FLOOR}::DOUBLE), {FLOOR}::DOUBLE) AS lw FROM m{k} m LEFT JOIN ms{k} p ON p.id = m.id),
m{k + 1} AS (SELECT id, name, lw - (SELECT ln(sum(exp(lw))) FROM r{k}) AS lw FROM r{k})"""


def _loss_sql(k: int) -> str:
    """l{k}: id, name, lw and loss of the fragments of two lines in m{k}; an unused one frees what its weight says, too."""
    return f"""t{k}_ AS (SELECT graph_id, v, size, id, lw FROM runs JOIN m{k} USING (name) WHERE size <= 2),
c{k} AS (SELECT id, unnest(string_split(name, '-')) AS color FROM m{k}), s{k} AS (SELECT color, ln(count(*) / (SELECT count(*) FROM c{k})) AS w FROM c{k} GROUP BY color),
o{k} AS (SELECT id, sum(w) AS own FROM c{k} JOIN s{k} USING (color) GROUP BY id),
lf{k} AS (SELECT graph_id, m.id AS without, 1 / (1 - exp(m.lw)) AS s, 0 AS v, 1.0::DOUBLE AS z, 0.0::DOUBLE AS z0 FROM len, m{k} m WHERE m.id >= {N_COLORS}
UNION ALL SELECT f.graph_id, without, s, f.v + 1, f.z * exp(a.lw) * s + CASE WHEN b.lw IS NULL OR b.id = without THEN 0 ELSE f.z0 * exp(b.lw) * s END, f.z
FROM lf{k} f JOIN t{k}_ a ON a.graph_id = f.graph_id AND a.v = f.v AND a.size = 1 LEFT JOIN t{k}_ b ON b.graph_id = f.graph_id AND b.v = f.v - 1 AND b.size = 2),
l{k} AS (SELECT without AS id, any_value(m.name) AS name, any_value(m.lw) AS lw, sum(gw * ln(z)) - any_value(own) AS loss
FROM lf{k} f JOIN len ON len.graph_id = f.graph_id AND f.v = len.n JOIN o{k} ON o{k}.id = without JOIN m{k} m ON m.id = without GROUP BY without)"""


def _store(spark, sf_dir) -> tuning.PartitionStore:
    return tuning.partition_store(_path_graphs(spark, sf_dir), _model(), 2, ALL)


_GONE = max(int(len(_model()) * SHARE), 1)


@query(f"""WITH {_start_sql()}, {_em_sql(0)}, {_em_sql(1)}, {_loss_sql(2)},
g AS (SELECT id FROM l2 ORDER BY loss DESC, lw, id DESC LIMIT {_GONE}), k AS (SELECT * FROM m2 WHERE id NOT IN (SELECT id FROM g)),
m3 AS (SELECT id, name, lw - (SELECT ln(sum(exp(lw))) FROM k) AS lw FROM k), {_em_sql(3)}, {_em_sql(4)} SELECT CAST(id AS INT) AS id, name AS fragment, round(lw, 5) AS lweight FROM m5""")
def tune_by_loss(spark, sf_dir) -> DataFrame:
    """The model after two rounds, without the fragments that cost least to lose, and after two rounds more."""
    model = _model()
    found = tuning.tune(_store(spark, sf_dir), model, ROUNDS, SHARE, FLOOR, size=len(model) - _GONE)
    return _named(mining.model_table(spark, found)).withColumn("lweight", rounded("lweight", 5))


@query(f"""WITH {_start_sql()}, {_em_sql(0)}, {_loss_sql(1)} SELECT CAST(id AS INT) AS id, round(loss, 3) AS loss FROM l1""")
def stored_losses(spark, sf_dir) -> DataFrame:
    """Losses of the fragments of two lines after a round, over stored partitions."""
    store = _store(spark, sf_dir)
    losses, _ = tuning.fragment_losses(store, tuning.em_round(store, _model(), FLOOR))
    rows = [(i, x) for i, x in sorted(losses.items()) if i >= N_COLORS]
    return spark.createDataFrame(rows, "id int, loss double").withColumn("loss", rounded("loss", 3))


@query(f"""WITH {_start_sql()}, {_loss_sql(0)}, r AS (SELECT *, row_number() OVER (ORDER BY loss DESC, lw, id DESC) AS place, greatest(CAST(floor(count(*) OVER () * 0.4) AS INT), 1) AS gone FROM l0)
SELECT name AS fragment, CAST(len(string_split(name, '-')) AS INT) AS size FROM m0 WHERE id NOT IN (SELECT id FROM r WHERE place <= gone)""")
def prune_by_loss(spark, sf_dir) -> DataFrame:
    """The model without the two fifths of its larger fragments that cost least to lose."""
    model = _model()
    losses, _ = tuning.fragment_losses(_store(spark, sf_dir), model)
    size = F.size(F.split(F.element_at(F.split("fragment", ";"), -1), ","))
    loss = spark.createDataFrame([(i, float(x)) for i, x in losses.items() if x > -math.inf or i >= N_COLORS], "id int, loss double")
    table = mining.model_table(spark, model).withColumn("size", size).join(loss, "id", "left")
    return _named(mining.least_lossy(table, 0.4)).select("fragment", "size")
