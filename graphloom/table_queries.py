"""Queries for files, models with their states, index mappings, counts and the model's own table, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import OV, order_lines, query, rounded
from .functions import logs, mappings
from .model import GraphModel
from .operators import dictionary, graphs, mining, scoring
from .path_queries import RUNS, _named, _runs
from .plans import views
from .plans.shared import shared_folder
from .sources.tables import load_table, save_table


def _round_trip(spark, df: DataFrame, name: str, keyword: str | None = None) -> DataFrame:
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-{name}"
    save_table(df, path, keyword)
    return load_table(spark, path, keyword)


@query("SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey::INTEGER AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir) -> DataFrame:
    return _round_trip(spark, views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "t.csv")


@query("""SELECT p_partkey::INTEGER AS p_partkey, p_name || ' "' || p_brand || '", ' || p_type AS words, p_size::INTEGER AS p_size, p_retailprice FROM part""")
def tsv_round_trip(spark, sf_dir) -> DataFrame:
    """Text with quotes and commas, and the format by keyword."""
    words = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", '), "p_type").alias("words")
    return _round_trip(spark, views.table(spark, sf_dir, "part").select("p_partkey", words, "p_size", "p_retailprice"), "t.txt", ".TSV")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_round_trip(spark, sf_dir) -> DataFrame:
    return _round_trip(spark, views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "t.pqt")


# ------------------------------------------------------------------------------------------------ models

#: Colours by label, log-weights of single labels, and coefficients of the model of the queries below.
LABELS = {"AF": 0, "NF": 1, "NO": 2}
WEIGHTS = (-1.25, -0.5, -2.0)
COEFFICIENTS = (2.0, -1.0, 0.5)


def _small_model(fragments: int = 3, span: bool = False) -> GraphModel:
    model = GraphModel(dict(LABELS), {}, {f";{c}": (c, WEIGHTS[c]) for c in range(fragments)}, 1, {"y": dict(enumerate(COEFFICIENTS))})
    if span:
        model.span = {"columns": [0, 1], "norms": [1.0, 1.0], "basis": [[1.0], [0.0]]}  # rows of the first label alone
    return model


def _rows(spark, sf_dir) -> DataFrame:
    """Order graphs without bonds as text; each eleventh is no graph."""
    v = order_lines(spark, sf_dir)
    labels = F.transform(F.array_sort(F.collect_list(F.struct("v", "label"))), lambda x: x["label"])
    g = v.groupBy("graph_id").agg(F.first("group").alias("group"), labels.alias("labels"))
    text = F.when(F.col("graph_id") % 11 == 0, "no graph").otherwise(F.concat(F.lit(";"), F.to_json("labels")))
    return g.select(F.col("graph_id").alias("group_item"), "group", text.alias("data"))


_NAMES = ", ".join(f"'{x}'" for x in LABELS)
_STATE = f"""{OV}, st AS (SELECT graph_id, CASE WHEN graph_id % 11 = 0 THEN 'PARSE' WHEN NOT bool_and(label IN ({_NAMES})) THEN 'COLOR'
WHEN bool_or(label = 'NO') THEN 'PARTITION' WHEN bool_or(label = 'NF') THEN 'FILTER' ELSE 'NONE' END AS filter,
string_agg(DISTINCT label, ', ' ORDER BY label) AS names, string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (label NOT IN ({_NAMES})) AS odd FROM ov GROUP BY graph_id)"""


@query(f"WITH {_STATE} SELECT graph_id AS group_item, filter FROM st")
def model_row_states(spark, sf_dir) -> DataFrame:
    """Each stage stops some rows: parse, colour, partition, filter."""
    return _small_model(2, span=True).process(_rows(spark, sf_dir)).select("group_item", "filter")


@query(f"""WITH {_STATE} SELECT graph_id AS group_item, filter, CASE filter WHEN 'PARSE' THEN 'no graph text, or bonds beyond its vertices' WHEN 'COLOR' THEN 'unknown labels: ' || odd
WHEN 'PARTITION' THEN 'no partition into known fragments of: ' || names WHEN 'FILTER' THEN 'outside the span of the training rows' END AS reason FROM st""")
def model_reject_reasons(spark, sf_dir) -> DataFrame:
    return _small_model(2, span=True).explain(_rows(spark, sf_dir))


_VALUES = ", ".join(f"('{k}', {WEIGHTS[c]}::DOUBLE, {COEFFICIENTS[c]}::DOUBLE)" for k, c in LABELS.items())
_EVALUATED = f"""WITH {OV}, m AS (SELECT * FROM (VALUES {_VALUES}) t(label, w, b)), k AS (SELECT graph_id FROM ov GROUP BY graph_id HAVING graph_id % 11 <> 0 AND bool_and(label IN ({_NAMES})))
SELECT grp AS "group", graph_id AS group_item, round(sum(w), 6) AS lweight_part, round(sum(b), 6) AS pred_y FROM ov JOIN k USING (graph_id) JOIN m USING (label) GROUP BY grp, graph_id"""


@query(_EVALUATED)
def model_evaluate(spark, sf_dir) -> DataFrame:
    return _small_model().evaluate(_rows(spark, sf_dir)).withColumns({c: rounded(c) for c in ("lweight_part", "pred_y")})


@query(_EVALUATED)
def model_saved_and_loaded(spark, sf_dir) -> DataFrame:
    """The same by a model that was written as compressed JSON to the shared folder and read again."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-model"
    _small_model().save(path, spark)
    return GraphModel.load(path, spark).evaluate(_rows(spark, sf_dir)).withColumns({c: rounded(c) for c in ("lweight_part", "pred_y")})


# ------------------------------------------------------------------------------------------------ mappings and counts


@query(f"""WITH {OV}, s AS (SELECT graph_id, CAST(count(*) AS INT) AS n, list(label ORDER BY v) AS l FROM ov GROUP BY graph_id), r AS (SELECT *, list_transform(range(n), lambda i: n - 1 - i) AS rev, list_transform(range(n), lambda i: (i + 1) % n) AS sh FROM s)
SELECT graph_id, array_to_string(list_transform(range(n), lambda i: (i + n - 1) % n), ',') AS inverse, array_to_string(list_transform(sh, lambda x: n - 1 - x), ',') AS composed,
array_to_string(list_transform(sh, lambda x: l[x + 1]), ',') AS permuted, true AS is_permutation, array_to_string(list_filter(range(n), lambda i: i <> n // 2), ',') AS without,
array_to_string(list_append(rev, 0), ',') AS appended, array_to_string(list_transform(range(n), lambda i: CASE WHEN i = 0 THEN n - 1 ELSE i END), ',') AS substituted FROM r""")
def index_mappings(spark, sf_dir) -> DataFrame:
    labels = F.transform(F.array_sort(F.collect_list(F.struct("v", "label"))), lambda x: x["label"])
    g = order_lines(spark, sf_dir).groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("n"), labels.alias("l"))
    n, every = F.col("n"), mappings.identity(F.col("n"))
    g = g.withColumns({"rev": F.transform(every, lambda i: n - 1 - i), "sh": F.transform(every, lambda i: ((i + 1) % n).cast("int"))})

    def text(m, name: str):
        return F.array_join(F.transform(m, lambda x: x.cast("string")), ",").alias(name)

    return g.select(
        "graph_id",
        text(mappings.inverse(F.col("sh")), "inverse"),
        text(mappings.compose(F.col("rev"), F.col("sh")), "composed"),
        text(mappings.permute(F.col("sh"), F.col("l")), "permuted"),
        mappings.is_permutation(F.col("sh")).alias("is_permutation"),
        text(mappings.identity_minus(n, F.floor(n / 2).cast("int")), "without"),
        text(mappings.append(F.col("rev"), F.lit(0)), "appended"),
        text(mappings.subst(every, F.lit(0), n - 1), "substituted"),
    )


@query(f"""WITH {OV}, s AS (SELECT graph_id, count(*) AS n FROM ov GROUP BY graph_id)
SELECT graph_id, round(ln(factorial(CAST(n AS INT))::DOUBLE), 6) AS ln_factorial, round(ln(factorial(CAST(2 * n AS INT))::DOUBLE) - n * ln(2) - ln(factorial(CAST(n AS INT))::DOUBLE), 6) + 0.0 AS ln_pairings,
round(n * (ln(0.792 * n) - ln(ln(n + 1))) - (0.792 * 0 + 1) * (ln(0.792) - ln(ln(2))) + ln(n), 6) + 0.0 AS bell_ratio FROM s""")
def counting_functions(spark, sf_dir) -> DataFrame:
    s = order_lines(spark, sf_dir).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    ratio = logs.ln_bell_ratio(n, F.lit(1), n)
    return s.select("graph_id", rounded(logs.ln_factorial(n)).alias("ln_factorial"), (rounded(logs.ln_odd_factorial(n)) + 0.0).alias("ln_pairings"), (rounded(ratio) + 0.0).alias("bell_ratio"))


_COUNTS = ", ".join(f"({n}, {x}::DOUBLE)" for n, x in enumerate(logs.CONNECTED_GRAPHS))


@query(f"WITH {OV}, s AS (SELECT graph_id, count(*) AS n FROM ov GROUP BY graph_id) SELECT graph_id, x AS n_graphs FROM s LEFT JOIN (VALUES {_COUNTS}) t(k, x) ON k = n")
def connected_graph_counts(spark, sf_dir) -> DataFrame:
    s = order_lines(spark, sf_dir).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("graph_id", logs.connected_graphs(F.col("n")).alias("n_graphs"))


@query("SELECT c_nationkey AS nation, round(ln(count(*) / (SELECT count(*) FROM customer)), 6) AS share FROM customer GROUP BY c_nationkey")
def normalize_counts(spark, sf_dir) -> DataFrame:
    n = views.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return logs.shares_of_counts(n, "n", "share").select("nation", rounded("share").alias("share"))


@query(f"""WITH {OV}, g AS (SELECT grp, graph_id, list(label ORDER BY v) AS l, any_value(weight) AS w FROM ov GROUP BY grp, graph_id)
SELECT grp AS "group", string_agg(array_to_string(l, ','), ';' ORDER BY graph_id) AS graphs, round(avg(w * len(l)), 6) AS weight FROM g GROUP BY grp""")
def regroup_lists(spark, sf_dir) -> DataFrame:
    """A list of lists and a mean for each group."""
    labels = F.transform(F.array_sort(F.collect_list(F.struct("v", "label"))), lambda x: x["label"])
    g = order_lines(spark, sf_dir).groupBy("group", "graph_id").agg(labels.alias("l"), F.first("weight").alias("w"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("graph_id", "l"))), lambda x: F.array_join(x["l"], ","))
    return g.groupBy("group").agg(F.array_join(lists, ";").alias("graphs"), rounded(F.avg(F.col("w") * F.size("l"))).alias("weight"))


@query(f"""WITH {OV}, g AS (SELECT grp, graph_id, list(label ORDER BY v) AS l FROM ov GROUP BY grp, graph_id)
SELECT grp AS "group", graph_id, CAST(row_number() OVER (PARTITION BY grp ORDER BY l, graph_id DESC) AS INT) AS place FROM g""")
def sort_by_nested_key(spark, sf_dir) -> DataFrame:
    labels = F.transform(F.array_sort(F.collect_list(F.struct("v", "label"))), lambda x: x["label"])
    g = order_lines(spark, sf_dir).groupBy("group", "graph_id").agg(labels.alias("l"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("l", F.desc("graph_id")))
    return g.select("group", "graph_id", place.alias("place"))


@query("""WITH a AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey), b AS (SELECT l_orderkey AS k, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY l_orderkey)
SELECT b.k AS graph_id, CAST(coalesce(a.n, 0) + b.n AS INT) AS n_features FROM b LEFT JOIN a USING (k)""")
def concat_feature_lists(spark, sf_dir) -> DataFrame:
    """Two feature lists of an order as one; a missing list is an empty one."""
    t = views.table(spark, sf_dir, "lineitem")
    a = t.where("l_quantity > 25").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"))
    b = t.groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("b"))
    both = F.concat(F.coalesce("a", F.array().cast("array<string>")), "b")
    return b.join(a, "l_orderkey", "left").select(F.col("l_orderkey").alias("graph_id"), F.size(both).alias("n_features"))


# ------------------------------------------------------------------------------------------------ the model's own table

_EM = f"{OV}, em AS (SELECT label, ln(count(*) / (SELECT count(*) FROM ov)) AS lw FROM ov GROUP BY label)"


@query(f"WITH {_EM}, f AS (SELECT label, greatest(lw, -2.0) AS lw FROM em) SELECT label, round(lw - (SELECT ln(sum(exp(lw))) FROM f), 6) AS lweight FROM f")
def floor_weights(spark, sf_dir) -> DataFrame:
    return mining.floored(scoring.label_logweights(order_lines(spark, sf_dir)), -2.0).withColumn("lweight", rounded("lweight"))


@query(f"WITH {_EM}, f AS (SELECT * FROM em WHERE label LIKE '%F') SELECT label, round(lw - (SELECT ln(sum(exp(lw))) FROM f), 6) AS lweight FROM f")
def model_subset(spark, sf_dir) -> DataFrame:
    return mining.subset(scoring.label_logweights(order_lines(spark, sf_dir)), "label LIKE '%F'").withColumn("lweight", rounded("lweight"))


@query(f"""WITH {RUNS}, n AS (SELECT DISTINCT name FROM runs), c AS (SELECT name, unnest(string_split(name, '-')) AS color FROM n), s AS (SELECT color, ln(count(*) / (SELECT count(*) FROM c)) AS w FROM c GROUP BY color)
SELECT name AS fragment, round(sum(w), 6) AS lweight FROM c JOIN s USING (color) GROUP BY name""")
def fragment_color_likelihood(spark, sf_dir) -> DataFrame:
    return _named(mining.color_likelihoods(_runs(spark, sf_dir)).withColumn("lweight", rounded("lweight")))


@query("""WITH p AS (SELECT 'r' || r_regionkey AS v, r_regionkey AS r FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT v, min(v) OVER (PARTITION BY r) AS component FROM p""")
def place_components(spark, sf_dir) -> DataFrame:
    """Components of one large graph: regions, nations, customers and suppliers."""
    bonds = views.place_bonds(spark, sf_dir).withColumn("graph_id", F.lit(0))
    vertices = bonds.select("graph_id", F.col("src").alias("v")).unionAll(bonds.select("graph_id", F.col("trg").alias("v"))).distinct()
    return graphs.components_at_large(vertices, bonds).select("v", "component")


@query(f"""WITH {OV}, d AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS idx FROM (SELECT label, count(DISTINCT grp) AS n FROM ov GROUP BY label))
SELECT graph_id, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce({math.e}::DOUBLE * idx, 0)), 6) AS weight FROM ov LEFT JOIN d USING (label) GROUP BY graph_id""")
def fragment_weight_lookup(spark, sf_dir) -> DataFrame:
    """Weights of fragments found by their text."""
    v = order_lines(spark, sf_dir)
    weights = dictionary.label_dictionary(v).select("label", (F.lit(math.e) * F.col("idx")).alias("weight_of"))
    found = v.join(F.broadcast(weights), "label", "left")
    return found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(F.coalesce("weight_of", F.lit(0.0)))).alias("weight"))
