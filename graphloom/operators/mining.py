"""Frequent connected fragments, partitions of graphs into them, and their weights by expectation-maximisation.

Graphs come as rows (graph_id, group, weight, bonds, colors); what tasks hold is one graph and the model, a dictionary of
fragments that the mining limits bound.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.logs import logsumexp, normalized_logs, shares_of_counts
from ..plans.shared import distinct_rows, for_members, numbered, same_rows, spread, written
from .kernels import all_exact_covers, bonding_cost, canonical, composition_cost, composition_cost_of, fragments_of, most_disjoint, top_n_exact_covers, top_p_exact_covers, top_structural_covers
from .sums import Steps, best_sums, by_sets, log_sums, shares, ways_by_pieces


#: Fragments of a model, and of a level of its search, at most.
MAX_FRAGMENTS = 200_000
#: Rows that a kernel's results are handed on by, and what their lists hold together, at most.
AT_ONCE, HELD_AT_ONCE = 4096, 65_536


def graph_of(row: dict) -> tuple[list[int], list[tuple[int, int]]]:
    return list(row["colors"] or ()), [(b["src"], b["trg"]) for b in row["bonds"] or ()]


def each(fields: list[tuple[str, pa.DataType]], kernel):
    """A mapInArrow function that gives the rows that `kernel` makes of each row; what it holds is a few rows' worth."""
    at_once, held_at_once = AT_ONCE, HELD_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = pa.schema(fields), [], 0
        for b in batches:
            for r in few_rows(b):
                for x in kernel(r):
                    rows.append(x)
                    held += sum(len(v) + sum(len(y) for y in v if isinstance(y, list)) for v in x.values() if isinstance(v, list))
                    if len(rows) == at_once or held >= held_at_once:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def few_rows(b: pa.RecordBatch, at_once: int = 16) -> Iterator[dict]:
    """A batch's rows, made of it a few at a time, as those of large graphs may each hold thousands of partitions."""
    for start in range(0, b.num_rows, at_once):
        yield from b.slice(start, at_once).to_pylist()


def distinct_graphs(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct graphs (graph_id: any number, n_same, weight summed, bonds, colors), and all rows with that number as `first`.

    What depends on bonds and colours alone is found once for each of them, and joined back by `for_all` if at all. They
    are spread over all tasks, as a graph's search is long for its size.
    """
    distinct, members = same_rows(graphs, "graph_id", ("bonds", "colors"), ("weight",))
    return spread(distinct), members


def counted_graphs(graphs: DataFrame) -> DataFrame:
    """The distinct graphs alone, for what needs no row of its own; `graphs` are read once and not written."""
    return spread(distinct_rows(graphs, "graph_id", ("bonds", "colors"), ("weight",)))


def for_all(members: DataFrame, found: DataFrame) -> DataFrame:
    """`found`, rows of distinct graphs, as rows of all graphs that equal them."""
    return for_members(members, found, "graph_id")


def canonical_forms(graphs: DataFrame) -> DataFrame:
    """graph_id, canonical text and number of automorphisms; a task works on equal graphs once, and nothing is shuffled."""

    def kernel(r):
        colors, bonds = graph_of(r)
        text, n = canonical(tuple(colors), tuple(bonds))
        yield {"graph_id": r["graph_id"], "canonical": text, "automorphisms": n}

    fields = [("graph_id", pa.int64()), ("canonical", pa.string()), ("automorphisms", pa.int64())]
    return graphs.select("graph_id", "bonds", "colors").mapInArrow(each(fields, kernel), "graph_id bigint, canonical string, automorphisms bigint")


def _bounded(rows: DataFrame) -> list:
    """Rows of a model's dictionary, on the driver; too many are an error."""
    found = rows.limit(MAX_FRAGMENTS + 1).collect()
    if len(found) > MAX_FRAGMENTS:
        raise ValueError(f"more than {MAX_FRAGMENTS} fragments; set a larger min_count, a limit or a smaller size")
    return found


def embeddings(graphs: DataFrame, most: int, accepted: frozenset[str] | None = None) -> DataFrame:
    """graph_id, group, weight, fragment, n (connected vertex sets) and n_disjoint (how many without common vertices).

    With `accepted`, sets grow only from fragments in it.
    """

    def kernel(r):
        found = fragments_of(*graph_of(r), most, None if accepted is None else accepted.__contains__)
        for text, sets in found.items():
            yield {"graph_id": r["graph_id"], "group": r["group"], "weight": r["weight"], "fragment": text, "size": len(sets[0]), "n": len(sets), "n_disjoint": most_disjoint(sets, exact=False)}

    fields = [("graph_id", pa.int64()), ("group", pa.int64()), ("weight", pa.float64()), ("fragment", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("n_disjoint", pa.int64())]
    return graphs.mapInArrow(each(fields, kernel), "graph_id bigint, `group` bigint, weight double, fragment string, size int, n bigint, n_disjoint bigint")


def most_common(graphs: DataFrame, max_size: int, limit: int | None = None, min_count: int | None = None) -> DataFrame:
    """fragment, size, weight (disjoint embeddings by graph weight), n_groups and rank.

    Single vertices come first; larger fragments need min_count groups and a parent that has them, so they are found
    size by size. All that tie with the last one within `limit` are returned.
    """
    return _most_common(*distinct_graphs(graphs.select("graph_id", "group", "weight", "bonds", "colors")), max_size, limit, min_count)


#: Numbers that one column of bits holds.
_BITS = 63


def _group_counts(found: DataFrame, members: DataFrame) -> DataFrame:
    """number and n_groups: in how many groups of `members` (first, group) the numbers of `found` (first, number) are.

    Numbers are bits by blocks of them, so a row goes on once for each block and not for each number, and what has the
    same group and block is one by `bit_or`, in each task first. Null is no group.
    """
    bit = F.expr(f"shiftleft(1L, CAST(number % {_BITS} AS INT))")
    block = F.floor(F.col("number") / _BITS).alias("block")
    of_first = found.groupBy("first", block).agg(F.bit_or(bit).alias("bits"))
    of_group = members.where("`group` IS NOT NULL").select("first", "group").join(of_first, "first").groupBy("group", "block").agg(F.bit_or("bits").alias("bits"))
    alike = of_group.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("n"))
    each_bit = F.explode(F.expr(f"filter(sequence(0, {_BITS - 1}), k -> shiftright(bits, k) & 1 = 1)"))
    numbers = alike.select("block", "n", each_bit.alias("bit")).select((F.col("block") * _BITS + F.col("bit")).alias("number"), "n")
    return numbers.groupBy("number").agg(F.sum("n").alias("n_groups"))


def _most_common(distinct: DataFrame, members: DataFrame, max_size: int, limit: int | None, min_count: int | None) -> DataFrame:
    accepted: frozenset[str] | None = None
    level = None
    for size in range(min(2, max_size), max_size + 1):  # all single vertices are accepted, so pairs are found with them
        at = written(embeddings(distinct.withColumn("group", F.lit(None).cast("bigint")), size, accepted).select("graph_id", "fragment", "size", "weight", "n_disjoint"), "embeddings")
        sums = numbered(at.groupBy("fragment", "size").agg(F.sum(F.col("n_disjoint") * F.col("weight")).alias("weight")), "number", "fragment")
        support = _group_counts(at.join(sums.select("fragment", "number"), "fragment").select(F.col("graph_id").alias("first"), "number"), members)
        level = sums.join(support, "number", "left").fillna(0, ["n_groups"]).select("fragment", "size", "weight", "n_groups")
        level = written(level.where((F.col("size") == 1) | (F.col("n_groups") >= (min_count or 1))), "fragments")
        accepted = frozenset(r["fragment"] for r in _bounded(level.select("fragment")))
    # one place ranks a dictionary that has been found to be of MAX_FRAGMENTS at most
    order = Window.orderBy((F.col("size") > 1).cast("int"), F.desc(F.round("weight", 9)), F.desc("n_groups"))
    ranked = level.withColumn("rank", F.rank().over(order))
    return ranked if limit is None else ranked.where((F.col("rank") <= limit) | (F.col("size") == 1))


def partitions(
    graphs: DataFrame,
    model: dict[str, tuple[int, float]],
    most: int,
    limit: int | None = 64,
    max_iter: int | None = 65536,
    max_heap: int | None = 65536,
    share: float | None = None,
    every: bool = False,
    structural: bool = False,
) -> DataFrame:
    """graph_id, part, lweight and frags (id, count) of partitions into the model's fragments.

    `model` maps a fragment's text to its id and log-weight. A graph with a vertex that no fragment covers has none.
    They come in the order of the search (`top_exact_covers`), which is not that of their likelihood, `limit` of them;
    with `share`, as many as leave at most that share of the likelihood by
    estimate; with `every`, all there are, in no order. With `structural`, `limit` of them by a search whose costs, and
    whose lweight, also tell how many ways there are to compose and bond the pieces (`top_structural_covers`).
    """

    def search(covers: list[list[int]], costs: list[float]):
        if every:
            return all_exact_covers(covers)
        if share is not None:
            return top_p_exact_covers(covers, costs, share, max_iter, max_heap)
        return top_n_exact_covers(covers, costs, limit, max_iter, max_heap)

    def kernel(r):
        colors, bonds = graph_of(r)
        found = fragments_of(colors, bonds, most)
        rows = [(m, *model[t]) for t, sets in found.items() if t in model for m in sets]
        if not colors or {v for m, _, _ in rows for v in m} != set(range(len(colors))):
            return
        rows.sort()
        places, costs = [list(m) for m, _, _ in rows], [-w for _, _, w in rows]
        if structural:
            pairs = {(min(b), max(b)) for b in bonds}
            inner = [sum(a in m and b in m for a, b in pairs) for m in map(set, places)]
            ids = [i for _, i, _ in rows]
            found_covers = islice(top_structural_covers(places, costs, inner, len(pairs), ids, len(colors), max_iter, max_heap), limit)
        else:
            found_covers = search(places, costs)
        for k, cover in enumerate(found_covers):
            used = Counter(rows[x][1] for x in cover)
            lweight = sum(rows[x][2] for x in cover)
            if structural:
                lweight -= composition_cost(used.elements(), 0) + bonding_cost(sum(inner[x] for x in cover), len(pairs))
            yield {"graph_id": r["graph_id"], "part": k, "lweight": lweight, "frags": [{"id": i, "n": n} for i, n in sorted(used.items())]}

    frag, kind = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int32())])), graphs.schema["graph_id"].dataType
    fields = [("graph_id", to_arrow_type(kind)), ("part", pa.int32()), ("lweight", pa.float64()), ("frags", frag)]
    return graphs.mapInArrow(each(fields, kernel), f"graph_id {kind.simpleString()}, part int, lweight double, frags array<struct<id:int,n:int>>")


def places_of(row: dict, ids: dict[str, int], most: int) -> tuple[tuple[tuple[int, ...], ...], list[int]]:
    """Vertex sets of a graph that are fragments in `ids`, in order, and their ids; none if a vertex is in none of them."""
    colors, bonds = graph_of(row)
    places = sorted((m, ids[t]) for t, sets in fragments_of(colors, bonds, most).items() if t in ids for m in sets)
    if {v for m, _ in places for v in m} != set(range(len(colors))):
        return (), []
    return tuple(m for m, _ in places), [i for _, i in places]


def summed_partitions(graphs: DataFrame, model: dict[str, tuple[int, float]], most: int, structural: bool = False) -> DataFrame:
    """graph_id, n_parts, lweight (ln of their sum) and best (the largest log-weight) of what `partitions` finds without limits.

    All partitions count, whatever their order, so they are summed and not listed. A graph without any has no row. n_parts
    is null where it is beyond a bigint. With `structural`, log-weights are those of `partitions` with it; what they add
    depends on how many pieces there are of each kind, so partitions are counted by that.
    """
    shared = graphs.sparkSession.sparkContext.broadcast(model)
    kind = graphs.schema["graph_id"].dataType
    fields = [("graph_id", to_arrow_type(kind)), ("n_parts", pa.int64()), ("lweight", pa.float64()), ("best", pa.float64())]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sorted(shared.value.values())
        at = {i: k for k, (i, _) in enumerate(order)}
        ids, weights = {t: at[i] for t, (i, _) in shared.value.items()}, np.array([w for _, w in order])
        rows = ((r["graph_id"], *places_of(r, ids, most)) for b in batches for r in few_rows(b))
        for keys, steps, used in by_sets(x for x in rows if x[1]):
            w, n = weights[used], steps.n_parts if steps.n_parts < 1 << 63 else None
            columns = [keys, [n] * len(keys), log_sums(steps, w), best_sums(steps, w)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    def structural_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weight = {t: i for t, (i, _) in shared.value.items()}, dict(shared.value.values())

        def rows():
            for r in (r for b in batches for r in few_rows(b)):
                places, used = places_of(r, ids, most)
                if places:
                    pairs = {(min(b), max(b)) for b in graph_of(r)[1]}
                    inner = [sum(a in m and b in m for a, b in pairs) for m in map(set, places)]
                    yield (r["graph_id"], inner, len(pairs)), places, used

        for keys, steps, used in by_sets(rows()):
            out = [(key, *_structural_sums(steps, row, weight, inner, n)) for (key, inner, n), row in zip(keys, used.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [f for f, _ in fields])

    return graphs.select("graph_id", "bonds", "colors").mapInArrow(structural_sums if structural else sums, f"graph_id {kind.simpleString()}, n_parts bigint, lweight double, best double")


def _structural_sums(steps: Steps, ids: list[int], weight: dict[int, float], inner: list[int], bonds: int) -> tuple[int | None, float, float]:
    """n_parts, lweight and best of a graph whose rows have these ids and so many of its bonds inside."""
    pieces = sorted(set(zip(ids, inner, strict=True)))
    at = {p: k for k, p in enumerate(pieces)}
    n_parts, lweights = 0, []
    for counts, n in ways_by_pieces(steps, [at[p] for p in zip(ids, inner, strict=True)]):
        used: dict[int, int] = {}
        for (i, _), k in zip(pieces, counts, strict=True):
            if k:
                used[i] = used.get(i, 0) + k
        lweight = sum(weight[i] * k for i, k in used.items()) - composition_cost_of(used.values(), 0)
        n_parts += n
        lweights.append((lweight - bonding_cost(sum(b * k for (_, b), k in zip(pieces, counts, strict=True)), bonds), n))
    sums = [w + math.log(n) for w, n in lweights]
    best, top = max(w for w, _ in lweights), max(sums)
    return n_parts if n_parts < 1 << 63 else None, top if math.isinf(top) else top + math.log(math.fsum(math.exp(x - top) for x in sums)), best


def em_round(graphs: DataFrame, model: dict[str, tuple[int, float]], most: int, by: str = "weight") -> tuple[DataFrame, DataFrame, DataFrame]:
    """`em_step` over all partitions of `graphs` (bonds, colors and the column `by`), which are summed, not listed.

    New (id, lweight), the expected log-likelihood of partitions as in `em_step`, and that of the graphs themselves as in
    `em_step_unweighted`. Each task adds up its graphs before anything is shuffled.
    """
    spark, order = graphs.sparkSession, sorted(model.values())
    at = {i: k for k, (i, _) in enumerate(order)}
    shared = spark.sparkContext.broadcast(({t: at[i] for t, (i, _) in model.items()}, [i for i, _ in order], np.array([w for _, w in order])))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ids, weights = shared.value
        mass, whole, seen = np.zeros(len(ids)), 0.0, False
        rows = ((r[by], *places_of(r, places, most)) for b in batches for r in few_rows(b) if r[by] is not None and r[by] > 0)
        for n, steps, used in by_sets(x for x in rows if x[1]):
            total, share = shares(steps, weights[used])
            np.add.at(mass, used, np.array(n, float)[:, None] * share)
            whole, seen = whole + float(np.array(n, float) @ total), True
        found = np.flatnonzero(mass > 0)
        out = [(ids[k], float(mass[k])) for k in found] + [(None, whole)] * seen
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.float64())], ["id", "s"])

    found = graphs.select("bonds", "colors", by).mapInArrow(sums, "id int, s double").groupBy("id").agg(F.sum("s").alias("s"))
    mass = found.where("id IS NOT NULL")
    total = mass.agg(F.sum("s").alias("total"))
    new = mass.crossJoin(F.broadcast(total)).select("id", F.ln(F.col("s") / F.col("total")).alias("lweight"))
    expected = mass.join(F.broadcast(spark.createDataFrame(order, "id int, w double")), "id").agg(F.sum(F.col("s") * F.col("w")).alias("log_likelihood"))
    return new, expected, found.where("id IS NULL").agg(F.sum("s").alias("log_likelihood"))


def fragment_loss(parts: DataFrame, weights: DataFrame, model: dict[str, tuple[int, float]]) -> DataFrame:
    """id and loss: what stays of the likelihood without a fragment, less what the fragment itself costs.

    Of a graph's partitions those without the fragment stay, likelier by the mass that it frees, to the power of the
    number of their pieces; graphs add the logarithm of the sum by weight. A graph with none left makes it minus
    infinity. The fragment's own cost is the log-likelihood of its colours, by their counts over the model's fragments.
    `parts` is a table of `partitions`, `weights` has graph_id and weight. Sums are made in each task for all fragments,
    which the model bounds; a graph adds one array of as many numbers for each number of pieces (`tuning.losses_of`).
    """
    from .tuning import color_costs, freed, losses_of

    ids, own = sorted(i for i, _ in model.values()), color_costs(model)
    at, spark = {i: k for k, i in enumerate(ids)}, parts.sparkSession
    by_place = np.empty(len(ids))
    for i, w in model.values():
        by_place[at[i]] = w
    shared = spark.sparkContext.broadcast((at, freed(by_place)))
    each_graph = parts.groupBy("graph_id").agg(F.collect_list(F.struct("lweight", "frags")).alias("parts")).join(weights.select("graph_id", "weight"), "graph_id")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, free = shared.value
        found = np.zeros(len(place))
        for b in batches:
            for r in few_rows(b):
                own_parts = [(p["lweight"], [{"id": place[f["id"]], "n": f["n"]} for f in p["frags"]]) for p in r["parts"]]
                found += r["weight"] * losses_of(own_parts, free)
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.int32()), pa.array(found)], ["id", "loss"])

    loss = each_graph.mapInArrow(sums, "id int, loss double").groupBy("id").agg(F.sum("loss").alias("loss"))
    cost = spark.createDataFrame(sorted(own.items()), "id int, cost double")
    return loss.join(cost, "id").select("id", (F.col("loss") - F.col("cost")).alias("loss"))


def least_lossy(table: DataFrame, share: float) -> DataFrame:
    """`table` (id, size, lweight, loss) without the share of its fragments that lose least, one at least, single vertices exempt.

    The next to go has the largest loss, then the smallest log-weight, then the largest id.
    """
    several = table.where("size > 1")
    n = several.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.orderBy(F.desc("loss"), "lweight", F.desc("id")))  # of a model's fragments, not of rows
    gone = several.withColumn("_place", place).crossJoin(F.broadcast(n)).where("_place <= _n").select("id")
    return table.join(gone, "id", "left_anti")


def floored(table: DataFrame, floor: float) -> DataFrame:
    """Log-weights of at least `floor`, which then sum to 1."""
    raised = table.withColumn("lweight", F.greatest("lweight", F.lit(floor)))
    total = raised.agg(F.ln(F.sum(F.exp("lweight"))).alias("_total"))
    return raised.crossJoin(F.broadcast(total)).withColumn("lweight", F.col("lweight") - F.col("_total")).drop("_total")


def subset(table: DataFrame, keep: str) -> DataFrame:
    """The fragments for which the condition holds, their log-weights to sum to 1 again."""
    return floored(table.where(keep), -math.inf)


def color_likelihoods(fragments: DataFrame) -> DataFrame:
    """fragment and lweight, the log-likelihood of its colours by their counts over all the fragments."""
    colors = fragments.select("fragment", F.posexplode(F.split(F.element_at(F.split("fragment", ";"), -1), ",")).alias("place", "color"))
    shares = shares_of_counts(colors.groupBy("color").agg(F.count(F.lit(1)).alias("n")), "n", "share")
    return colors.join(F.broadcast(shares), "color").groupBy("fragment").agg(F.sum("share").alias("lweight"))


def em_step_unweighted(parts: DataFrame, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`em_step` with every graph counting once, or by `counts` (graph_id, n_same), and the log-likelihood of the graphs themselves."""
    counts = parts.select("graph_id", F.lit(1).alias("n_same")).distinct() if counts is None else counts
    shared = normalized_logs(parts, ["graph_id"], "lweight", "share").join(counts, "graph_id")
    mass = shared.select((F.col("n_same") * F.exp("share")).alias("m"), F.explode("frags").alias("f")).groupBy(F.col("f.id").alias("id")).agg(F.sum(F.col("m") * F.col("f.n")).alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"))
    likelihood = logsumexp(parts, ["graph_id"], "lweight", "ll").join(counts, "graph_id").agg(F.sum(F.col("n_same") * F.col("ll")).alias("log_likelihood"))
    return mass.crossJoin(F.broadcast(total)).where("mass > 0").select("id", F.ln(F.col("mass") / F.col("total")).alias("lweight")), likelihood


def em_step(parts: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New (id, lweight), and the log-likelihood: each graph's partitions share its weight by their likelihood."""
    shared = normalized_logs(parts, ["graph_id"], "lweight", "share").join(weights, "graph_id").where("weight > 0")
    likelihood = shared.agg(F.sum(F.col("weight") * F.exp("share") * F.col("lweight")).alias("log_likelihood"))
    mass = shared.select((F.col("weight") * F.exp("share")).alias("m"), F.explode("frags").alias("f")).groupBy(F.col("f.id").alias("id")).agg(F.sum(F.col("m") * F.col("f.n")).alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"))
    return mass.crossJoin(F.broadcast(total)).where("mass > 0").select("id", F.ln(F.col("mass") / F.col("total")).alias("lweight")), likelihood


def fit_fragments(
    graphs: DataFrame,
    max_size: int,
    limit: int | None = None,
    min_count: int | None = None,
    rounds: int = 5,
    prune: float = 0.0,
    floor: float = -50.0,
    size: int | None = None,
    search=None,
) -> dict[str, tuple[int, float]]:
    """Mined fragments and their log-weights, tuned by `tuning.tune` over partitions that are searched once.

    `prune` is the share of fragments that goes at a time, by loss, as long as the model gets likelier or, with `size`,
    until so many are left. `search` is a `tuning.Search`, the limits of the search for partitions.
    """
    same = distinct_graphs(graphs.select("graph_id", "group", "weight", "bonds", "colors"))
    return fit_distinct(*same, max_size, limit, min_count, rounds, prune, floor, size, search)


def fit_distinct(distinct: DataFrame, members: DataFrame, max_size: int, limit=None, min_count=None, rounds=5, prune=0.0, floor=-50.0, size=None, search=None) -> dict[str, tuple[int, float]]:
    """`fit_fragments` of graphs that `distinct_graphs` has made."""
    from .tuning import Search, partition_store, resized, tune

    rows = _bounded(_most_common(distinct, members, max_size, limit, min_count).orderBy("rank", "fragment"))
    total = sum(r["weight"] for r in rows) or 1.0
    model = {r["fragment"]: (k, math.log(r["weight"] / total) if r["weight"] else floor) for k, r in enumerate(rows)}
    store = partition_store(distinct, model, max_size, search or Search())
    return resized(tune(store, model, rounds, prune, floor, size))


def model_table(spark: SparkSession, model: dict[str, tuple[int, float]]) -> DataFrame:
    return spark.createDataFrame([(i, t, w) for t, (i, w) in model.items()], "id int, fragment string, lweight double")
