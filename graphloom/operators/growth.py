"""Growth of fragments over a table of their occurrences, and the tree of fragments that names what it meets.

Graphs are rows (graph_id, group, weight, bonds, colors) with coloured bonds; equal ones (bonds and colours) are one, which
counts as often as it stands, so work grows with the distinct graphs. An occurrence is a fragment and its vertex
map: the graph's vertex for each vertex of the fragment's canonical form. One step adds a vertex and its bonds by a join
with the graph's neighbours; which fragment that makes, and how its vertices are numbered, depends on the fragment and
the operation alone, so it is looked up in a table of steps (parent, operation) -> (fragment, places), made once for each
pair. Nothing is enumerated again from single vertices.

An operation is text, `color;i,bond,i,bond,...`: a vertex of the colour, bonded to the parent's vertices i. `places` has,
for each vertex of the grown fragment, its place among the parent's vertices and, last, the new one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import ln_bell, shares_of_counts
from ..plans.shared import ranked, same_rows, written
from .bonded import BOND, bonded_search, bonded_text, parse_bonded
from .kernels import most_disjoint
from .mining import each

#: Fragments that tasks hold to pick their occurrences, at most.
MAX_LIKELY = 1 << 19
STEPS = "parent string, op string, fragment string, places array<int>"
_STEP_FIELDS = [("parent", pa.string()), ("op", pa.string()), ("fragment", pa.string()), ("places", pa.list_(pa.int32()))]


def with_neighbors(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """graph_id, n_same, colors and near, each vertex's (w, bond), of distinct graphs; and all graphs (graph_id, group, weight, first).

    Null bonds and colours are none.
    """
    none = F.array().cast(f"array<{BOND}>")
    g = graphs.select("graph_id", "group", "weight", F.coalesce("bonds", none).alias("bonds"), F.coalesce("colors", F.array().cast("array<int>")).alias("colors"))
    g, members = same_rows(g, "graph_id", ("bonds", "colors"))

    def near(v: Column) -> Column:
        ends = F.filter("bonds", lambda b: ((b["src"] == v) | (b["trg"] == v)) & (b["src"] != b["trg"]))
        return F.transform(ends, lambda b: F.struct(F.when(b["src"] == v, b["trg"]).otherwise(b["src"]).alias("w"), b["color"].alias("bond")))

    return written(g.select("graph_id", "n_same", "colors", F.transform("colors", lambda _, v: near(v)).alias("near")), "neighbors"), members


def single_vertices(near: DataFrame) -> DataFrame:
    """Occurrences (graph_id, fragment, m) of one vertex."""
    v = near.select("graph_id", F.posexplode("colors").alias("v", "color"))
    return v.select("graph_id", F.concat(F.lit(";"), F.col("color").cast("string")).alias("fragment"), F.array("v").alias("m"))


def extensions(occurrences: DataFrame, near: DataFrame) -> DataFrame:
    """graph_id, parent, op and full (the map and the new vertex): each way to add a neighbour with all its bonds."""
    # a table of packed arrays is far larger on the driver than its file says, so it is never broadcast
    at = occurrences.join(near.select("graph_id", "colors", "near").hint("merge"), "graph_id")

    def outward(v: Column, i: Column) -> Column:
        out = F.filter(F.get("near", v), lambda x: ~F.array_contains("m", x["w"]))
        return F.transform(out, lambda x: F.struct(x["w"].alias("w"), i.alias("i"), x["bond"].alias("bond")))

    at = at.select("graph_id", "fragment", "m", "colors", F.flatten(F.transform("m", outward)).alias("links"))
    new = at.select("*", F.explode(F.array_distinct(F.transform("links", lambda x: x["w"]))).alias("w"))
    own = F.array_sort(F.transform(F.filter("links", lambda x: x["w"] == F.col("w")), lambda x: F.struct(x["i"].alias("i"), x["bond"].alias("bond"))))
    bonded = F.array_join(F.transform(own, lambda x: F.concat(x["i"].cast("string"), F.lit(","), x["bond"].cast("string"))), ",")
    op = F.concat(F.get("colors", F.col("w")).cast("string"), F.lit(";"), bonded)
    return new.select("graph_id", F.col("fragment").alias("parent"), op.alias("op"), F.concat("m", F.array("w")).alias("full"))


def _parse_op(op: str) -> tuple[int, list[tuple[int, int]]]:
    color, _, links = op.partition(";")
    x = [int(i) for i in links.split(",")]
    return int(color), list(zip(x[::2], x[1::2], strict=True))


def _op_text(color: int, links: list[tuple[int, int]]) -> str:
    return f"{color};" + ",".join(f"{i},{b}" for i, b in sorted(links))


def steps_of(pairs: DataFrame) -> DataFrame:
    """The steps of distinct pairs (parent, op); the canonical form is computed once for each."""

    def kernel(r):
        colors, bonds = parse_bonded(r["parent"])
        color, links = _parse_op(r["op"])
        n = len(colors)
        colors, bonds = [*colors, color], [*bonds, *((i, n, b) for i, b in links)]
        # of two vertices the smaller colour comes first; with many colours there are very many pairs
        order = [0, 1] if n == 1 and colors[0] <= color else [1, 0] if n == 1 else bonded_search(colors, bonds)[0]
        yield {"parent": r["parent"], "op": r["op"], "fragment": bonded_text(colors, bonds, order), "places": order}

    return pairs.mapInArrow(each(_STEP_FIELDS, kernel), STEPS)


def grown(extended: DataFrame, steps: DataFrame) -> DataFrame:
    """Occurrences after the steps; of the ways to one set of vertices, the one with the least map. The rest go."""
    full = extended.join(steps, ["parent", "op"])
    m = F.transform("places", lambda p: F.get("full", p))
    met = full.select("graph_id", F.array_sort("full").alias("members"), F.struct("fragment", m.alias("m")).alias("found"))
    return met.groupBy("graph_id", "members").agg(F.min("found").alias("found")).select("graph_id", "found.*")


def by_graph(occurrences: DataFrame) -> DataFrame:
    """graph_id, fragment, maps and n_disjoint, how many of them have no common vertices (as `most_disjoint` counts)."""
    rows = occurrences.groupBy("graph_id", "fragment").agg(F.array_sort(F.collect_list("m")).alias("maps"))

    @F.udf("bigint", useArrow=True)
    def disjoint(maps):
        return most_disjoint(sorted(maps, key=lambda m: sum(1 << v for v in m)), exact=False)

    # equal maps are counted once; one alone needs no search
    several = written(rows, "maps")
    counts = several.where(F.size("maps") > 1).select("maps").distinct().withColumn("n_disjoint", disjoint("maps"))
    out = several.join(counts, "maps", "left").withColumn("n_disjoint", F.coalesce("n_disjoint", F.lit(1).cast("bigint")))
    return out.select("graph_id", "fragment", "maps", "n_disjoint")


def size_of(fragment: str) -> Column:
    return F.size(F.split(F.element_at(F.split(fragment, ";"), -1), ","))


KEY = ("weight", "n_groups", "n_graphs", "n_disjoint")


def measured(rows: DataFrame, near: DataFrame, members: DataFrame) -> DataFrame:
    """fragment, size, the key that ranks it (weight, n_groups, n_graphs, n_disjoint) and n, its occurrences."""
    same = members.groupBy("first").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n_same")).withColumnRenamed("first", "graph_id")
    at = rows.select("graph_id", "fragment", "n_disjoint", F.size("maps").cast("bigint").alias("n"))
    sums = at.join(same.hint("merge"), "graph_id").groupBy("fragment").agg(
        F.round(F.sum(F.col("n_disjoint") * F.col("w")), 9).alias("weight"),
        F.sum("n_same").alias("n_graphs"),
        F.sum(F.col("n_disjoint") * F.col("n_same")).alias("n_disjoint"),
        F.sum(F.col("n") * F.col("n_same")).alias("n"),
    )
    groups = members.select(F.col("first").alias("graph_id"), "group").distinct()
    groups = at.select("graph_id", "fragment").join(groups.hint("merge"), "graph_id").groupBy("fragment").agg(F.countDistinct("group").alias("n_groups"))
    return sums.join(groups, "fragment").select("fragment", size_of("fragment").alias("size"), *KEY, "n")


def idle_fragments(rows: DataFrame, more: DataFrame) -> DataFrame:
    """The fragments of `rows` that `dependent` gives, with canonical forms only where they can matter.

    One occurrence alone that grows at all does so into one fragment. Of others, all occurrences that grow into one and
    the same fragment do so by a vertex of one colour and bonds of the same colours; only fragments for which some such
    kind of operation has them all are looked at further.
    """
    n = written(rows.groupBy("fragment").agg(F.sum(F.size("maps")).alias("n")), "numbers")
    alone = more.select(F.col("parent").alias("fragment")).join(n.where("n = 1"), "fragment", "left_semi").distinct()
    several = more.join(n.where("n > 1").select(F.col("fragment").alias("parent"), "n"), "parent")
    links = F.split(F.substring_index("op", ";", -1), ",")
    kind = F.concat_ws(",", F.substring_index("op", ";", 1), F.array_sort(F.filter(links, lambda _, i: i % 2 == 1)))
    each_once = several.select("parent", "n", kind.alias("kind"), "graph_id", F.slice("full", F.lit(1), F.size("full") - 1).alias("m")).distinct()
    likely = each_once.groupBy("parent", "kind").agg(F.count(F.lit(1)).alias("inside"), F.first("n").alias("n")).where("inside = n")
    likely = written(likely.select(F.col("parent").alias("fragment")).distinct(), "likely")
    some = rows.join(likely, "fragment", "left_semi")
    left = written(more.join(likely.withColumnRenamed("fragment", "parent"), "parent", "left_semi"), "likely-extensions")
    return alone.unionByName(dependent(some, left, steps_of(left.select("parent", "op").distinct())))


def dependent(rows: DataFrame, more: DataFrame, made: DataFrame) -> DataFrame:
    """The fragments of `rows` all of whose occurrences grow, by a step of `made`, into one and the same fragment.

    `more` are their extensions; an occurrence counts once for each fragment that it grows into.
    """
    n = rows.groupBy("fragment").agg(F.sum(F.size("maps")).alias("n"))
    into = more.join(made, ["parent", "op"]).select("graph_id", F.col("parent").alias("fragment"), F.slice("full", F.lit(1), F.size("full") - 1).alias("m"), F.col("fragment").alias("child"))
    into = into.distinct().groupBy("fragment", "child").agg(F.count(F.lit(1)).alias("inside"))
    return into.join(n, "fragment").where("inside = n").select("fragment").distinct()


def mine(graphs: DataFrame, max_size: int, min_groups: int = 1, limit: int | None = None, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The common fragments of up to `max_size` vertices with their rank, and the steps that made them.

    Fragments are what connected sets of vertices induce. Single vertices all stay and come first; they and larger ones
    grow on while they stand in `min_groups` groups, and larger ones with fewer go. Ranks go by weight (disjoint
    occurrences by graph weight), groups, graphs and disjoint occurrences; equal keys share one. With `limit`, single
    vertices and the first of the others up to that number stay, with all that tie with the last; where single vertices
    in enough groups reach it alone, only single vertices. As no fragment has a better key than one that it grew from,
    those behind the limit don't grow.

    With `closed`, a fragment of more than one vertex is left out, though it grows, if all its occurrences grow into one
    and the same larger one, which then says all that it does; the limit counts those that stay. Those of `max_size` are
    judged by what they would grow into.

    One shuffle of occurrences by graph for each size; the dictionary of fragments is a table of any length, ranked over
    ranges, and nothing of it comes to the driver but the key of the last one within `limit`. Graphs without vertices have no occurrences; repeated graph_ids are one graph's rows
    and not allowed.
    """
    near, members = with_neighbors(graphs)
    occurrences, steps = single_vertices(near), []
    found = enough = n_single = None
    for size in range(1, max_size + 1):
        rows = written(by_graph(occurrences), "occurrences")
        level = measured(rows, near, members)
        level = written(level if size == 1 else level.where(F.col("n_groups") >= min_groups), "fragments")
        growing = level.where(F.col("n_groups") >= min_groups)
        if closed and size > 1:
            all_of = rows.join(level.select("fragment"), "fragment", "left_semi")
            longer = written(extensions(all_of.select("graph_id", "fragment", F.explode("maps").alias("m")), near), "extensions")
            idle = idle_fragments(all_of, longer)
            level = written(level.join(idle, "fragment", "left_anti"), "closed")
        found = level if found is None else found.unionByName(level)
        if limit is not None:
            if size == 1:
                n_single, n_growing = level.count(), growing.count()
                if n_growing >= limit:
                    break
                enough = max(limit - n_single, 1)
            else:
                last = found.where("size > 1").orderBy(*(F.desc(k) for k in KEY)).limit(enough).collect()
                if len(last) == enough:
                    bound = [F.lit(last[-1][k]).cast(kind).alias(k) for k, kind in level.select(*KEY).dtypes]
                    growing = growing.where(F.struct(*KEY) >= F.struct(*bound))
        if size == max_size or growing.isEmpty():
            break
        kept = rows.join(growing.select("fragment"), "fragment", "left_semi").select("graph_id", "fragment", F.explode("maps").alias("m"))
        more = written(extensions(kept, near), "extensions")
        made = written(steps_of(more.select("parent", "op").distinct()), "steps")
        steps.append(made)
        occurrences = grown(more, made)
    order = {"single": (F.col("size") > 1).cast("int"), **{k: -F.col(k) for k in KEY}}
    places = ranked(found, "rank", order)
    if limit is not None:
        places = places.where("size = 1") if enough is None else places.where((F.col("size") == 1) | (F.col("rank") <= n_single + enough))
    none = graphs.sparkSession.createDataFrame([], STEPS)
    for made in steps:
        none = none.unionByName(made)
    # of closed fragments, those that are left out may lie on the way
    return places, none if closed else none.join(places.select("fragment"), "fragment", "left_semi").select("parent", "op", "fragment", "places")


def closed_pairs(graphs: DataFrame) -> DataFrame:
    """fragment, size and n of what `mine(graphs, 2, closed=True)` finds, without its ranks and what they go by.

    All of a pair's neighbourhood is in its graph's row, so nothing is joined by graph: graphs are written once, one sum
    over their vertices and pairs tells how many there are of each fragment and how many of these grow at all. A pair
    that stands once is left out if it grows; one of which some occurrence doesn't grow stays. Only for what is left it
    is looked up into what the occurrences grow.
    """
    g = written(_linked(graphs), "links")
    single = F.transform("colors", lambda c: F.struct(F.concat(F.lit(";"), c.cast("string")).alias("fragment"), F.lit(1).alias("size"), F.lit(False).alias("grows")))
    pairs = F.transform("links", lambda p: F.struct(_pair_text(p).alias("fragment"), F.lit(2).alias("size"), F.exists("links", lambda x: _beside(p, x)).alias("grows")))
    counts = g.select(F.explode(F.concat(single, pairs)).alias("x")).select("x.*").where("fragment IS NOT NULL")
    counts = written(counts.groupBy("fragment", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("grows").alias("n_grow")), "fragments")
    likely = written(counts.where("n > 1 AND n_grow = n").select("fragment", "n"), "likely")
    if likely.count() <= MAX_LIKELY:
        at = g.select("links", F.explode("links").alias("p")).withColumn("fragment", _pair_text(F.col("p")))
        ways = at.join(F.broadcast(likely), "fragment").select("fragment", "n", _ways(F.col("p")).alias("ways"))
    else:  # rows go to the others of their fragment without their graph
        ways = F.transform("links", lambda p: F.struct(_pair_text(p).alias("fragment"), _ways(p).alias("ways")))
        ways = g.select(F.explode(ways).alias("x")).select("x.*").where(F.size("ways") > 0).join(likely, "fragment")
    into = ways.select("fragment", "n", F.explode("ways").alias("way"))
    idle = into.groupBy("fragment", "way").agg(F.count(F.lit(1)).alias("inside"), F.first("n").alias("n")).where("inside = n").select("fragment").distinct()
    left = likely.join(idle, "fragment", "left_anti").select("fragment", F.lit(2).alias("size"), "n")
    return counts.where("n_grow < n").select("fragment", "size", "n").unionByName(left)


def _linked(graphs: DataFrame) -> DataFrame:
    """colors and links: each bonded pair of vertices a < z once, as a, z, their colours ca and cz, and its bonds as text."""
    none = F.array().cast(f"array<{BOND}>")
    ends = F.filter(F.coalesce("bonds", none), lambda b: (b["src"] != b["trg"]) & F.get("colors", b["src"]).isNotNull() & F.get("colors", b["trg"]).isNotNull())
    ends = F.array_sort(F.transform(ends, lambda b: F.struct(F.least(b["src"], b["trg"]).alias("a"), F.greatest(b["src"], b["trg"]).alias("z"), b["color"].alias("color"))))
    keys = F.array_distinct(F.transform("ends", lambda e: F.struct(e["a"].alias("a"), e["z"].alias("z"))))

    def text(color: Column) -> Column:
        return F.concat(F.lit("0,1,"), color.cast("string"))

    def link(e: Column, bonds: Column) -> Column:
        return F.struct(e["a"].alias("a"), e["z"].alias("z"), F.get("colors", e["a"]).alias("ca"), F.get("colors", e["z"]).alias("cz"), bonds.alias("bonds"))

    def same(e: Column) -> Column:
        return F.transform(F.filter("ends", lambda x: (x["a"] == e["a"]) & (x["z"] == e["z"])), lambda x: text(x["color"]))

    several = F.transform("keys", lambda e: link(e, F.array_join(same(e), ",")))
    links = F.when(F.size("keys") == F.size("ends"), F.transform("ends", lambda e: link(e, text(e["color"])))).otherwise(several)
    # a column for each step, as what a lambda names is worked out for each element
    g = graphs.select(F.coalesce("colors", F.array().cast("array<int>")).alias("colors"), ends.alias("ends")).withColumn("keys", keys)
    return g.select("colors", links.alias("links"))


def _pair_text(p: Column) -> Column:
    """The canonical form of a link."""
    return F.concat(p["bonds"], F.lit(";"), F.least(p["ca"], p["cz"]).cast("string"), F.lit(","), F.greatest(p["ca"], p["cz"]).cast("string"))


def _beside(p: Column, x: Column) -> Column:
    """Whether link x has one of the ends of link p."""
    return ((x["a"] == p["a"]) | (x["a"] == p["z"])) != ((x["z"] == p["a"]) | (x["z"] == p["z"]))


def _ways(p: Column) -> Column:
    """How a third vertex can lie beside link p: its colour and its bonds to both ends, the end of the smaller colour first.

    Of one pair of vertices, two ways are equal if and only if they make the same fragment: in a fragment of three vertices,
    an automorphism brings any pair to any other that has the same bonds and colours.
    """

    def to(v: Column, w: Column) -> Column:
        found = F.filter("links", lambda x: (x["a"] == F.least(v, w)) & (x["z"] == F.greatest(v, w)))
        return F.coalesce(F.get(found, F.lit(0))["bonds"], F.lit(""))

    def way(x: Column) -> Column:
        turned = (p["ca"] > p["cz"]) | ((p["ca"] == p["cz"]) & (x["a"] > x["z"]))
        return F.concat_ws("|", x["color"].cast("string"), F.when(turned, x["z"]).otherwise(x["a"]), F.when(turned, x["a"]).otherwise(x["z"]))

    def other(x: Column) -> Column:
        a, z = F.struct(x["a"].alias("v"), x["ca"].alias("color")), F.struct(x["z"].alias("v"), x["cz"].alias("color"))
        return F.when((x["a"] == p["a"]) | (x["a"] == p["z"]), z).otherwise(a)

    third = F.array_distinct(F.transform(F.filter("links", lambda x: _beside(p, x)), other))
    sides = F.transform(third, lambda w: F.struct(w["color"].alias("color"), to(p["a"], w["v"]).alias("a"), to(p["z"], w["v"]).alias("z")))
    return F.array_distinct(F.transform(sides, way))


def bell_seeds(graphs: DataFrame, max_size: int, n_fragments: int, min_graphs: int = 1, ratio: bool = True) -> DataFrame:
    """fragment, size, n_graphs and lweight, a first guess of a model's log-weights.

    Single vertices all stay. Of larger fragments, found size by size from those that stay so far, those in the most
    graphs stay, so that there are n_fragments with the single ones; all that tie with the last one do, too, so their
    number may be larger, by less than those that tie. A graph adds, to a fragment, its number of ways to grow it from
    one that stayed, by `ratio` times the share of partitions of as many vertices that have it as a piece, as Bell
    numbers estimate it; the log-weights are of these sums, to sum to 1.
    """
    near, _ = with_neighbors(graphs)
    total = near.select("graph_id", "n_same", F.size("colors").alias("all"))
    occurrences = written(single_vertices(near), "occurrences")
    counts = occurrences.groupBy("graph_id", "fragment").agg(F.count(F.lit(1)).alias("ways"))

    def judged(counts: DataFrame) -> DataFrame:
        c = counts.join(total.hint("merge"), "graph_id").withColumn("size", size_of("fragment"))
        share = ln_bell(F.col("size")) + ln_bell(F.col("all") - F.col("size")) - ln_bell(F.col("all"))
        share = F.when(F.col("size") < F.col("all"), share).otherwise(0.0) if ratio else F.lit(0.0)
        return c.groupBy("fragment", "size").agg(F.sum("n_same").alias("n_graphs"), F.sum(F.col("n_same") * F.exp(F.ln("ways") + share)).alias("mass"))

    found = written(judged(counts), "fragments")
    room = n_fragments - found.count()
    if room < 0:
        raise ValueError(f"more than {n_fragments} single vertices")
    for size in range(2, max_size + 1):
        growing = occurrences.join(found.where(F.col("size") == size - 1), "fragment", "left_semi")
        more = written(extensions(growing, near), "extensions")
        made = written(steps_of(more.select("parent", "op").distinct()), "steps")
        level = judged(more.join(made, ["parent", "op"]).groupBy("graph_id", "fragment").agg(F.count(F.lit(1)).alias("ways")))
        both = written(found.where("size > 1").unionByName(level.where(F.col("n_graphs") >= min_graphs)), "fragments")
        least = both.orderBy(F.desc("n_graphs")).limit(room).agg(F.min("n_graphs")).first()[0]
        kept = both.where("1 = 0") if least is None else both.where(F.col("n_graphs") >= least)  # all that tie with the last
        found = written(found.where("size = 1").unionByName(kept), "fragments")
        if found.where(F.col("size") == size).isEmpty():
            break
        occurrences = written(grown(more, made), "occurrences")
    return shares_of_counts(found, "mass", "lweight").select("fragment", "size", "n_graphs", "lweight")


def _chain(text: str) -> list[dict]:
    """The steps to a fragment from a single vertex, each by its last vertex that isn't a cut, for all equal operations.

    Operations that automorphisms of the parent bring to one another lead to the same fragment; each has its places.
    """
    rows = []
    colors, bonds = parse_bonded(text)
    while len(colors) > 1:
        n = len(colors)
        gone = next(v for v in reversed(range(n)) if _connected([w for w in range(n) if w != v], bonds))
        rest = [v for v in range(n) if v != gone]
        at = {v: k for k, v in enumerate(rest)}
        small = [(at[a], at[b], c) for a, b, c in bonds if gone not in (a, b)]
        order, _, moves = bonded_search([colors[v] for v in rest], small)
        place = {rest[v]: k for k, v in enumerate(order)}
        parent = bonded_text([colors[v] for v in rest], small, order)
        # the automorphisms in the numbers of the parent's form
        named = [tuple(order.index(g[v]) for v in order) for g in moves]
        links = [(place[a if b == gone else b], c) for a, b, c in bonds if gone in (a, b)]
        start = (tuple(sorted(links)), tuple(place.get(v, n - 1) for v in range(n)))
        seen, open_ = {start[0]: start[1]}, [start]
        while open_:
            now, places = open_.pop()
            for g in named:
                moved = tuple(sorted((g[i], c) for i, c in now))
                if moved not in seen:
                    seen[moved] = tuple(g[p] if p < n - 1 else p for p in places)
                    open_.append((moved, seen[moved]))
        rows += [{"parent": parent, "op": _op_text(colors[gone], list(now)), "fragment": text, "places": list(places)} for now, places in sorted(seen.items())]
        text, (colors, bonds) = parent, parse_bonded(parent)
    return rows


def _connected(vertices: list[int], bonds: list[tuple[int, int, int]]) -> bool:
    reached, open_ = {vertices[0]}, [vertices[0]]
    while open_:
        v = open_.pop()
        for a, b, _ in bonds:
            for x, y in ((a, b), (b, a)):
                if x == v and y in vertices and y not in reached:
                    reached.add(y)
                    open_.append(y)
    return len(reached) == len(vertices)


def tree_of(fragments: DataFrame) -> DataFrame:
    """The steps from single vertices to each of the fragments (canonical forms), with those on the way.

    A fragment has one parent, what is left without its last vertex that isn't a cut, and a step for each of the
    operations on it that come to the same.
    """

    def kernel(r):
        yield from _chain(r["fragment"])

    return fragments.select("fragment").distinct().mapInArrow(each(_STEP_FIELDS, kernel), STEPS).distinct()


def locate(graphs: DataFrame, tree: DataFrame, pins: DataFrame) -> DataFrame:
    """graph_id, fragment, maps and n_disjoint of the fragments in `pins` that the graphs have.

    `tree` is that of `tree_of` (or the steps of `mine`, for the graphs they came from). It is walked by joins from single
    vertices: what it doesn't know is left, every other connected set is kept once, and nothing is canonised. A step
    for each size of the tree; pins and tree are dictionaries, and whether they are broadcast is Spark's choice by size.
    """
    (near, members), tree, pins = with_neighbors(graphs), written(tree, "tree"), written(pins.select("fragment").distinct(), "pins")
    largest = pins.agg(F.max(size_of("fragment"))).first()[0] or 0
    parents = tree.select(F.col("parent").alias("fragment")).distinct()
    occurrences, out = single_vertices(near), None
    for size in range(1, largest + 1):
        occurrences = written(occurrences.join(parents.unionByName(pins).distinct(), "fragment", "left_semi"), "occurrences")
        out = occurrences if out is None else out.unionByName(occurrences)
        if size < largest:
            growing = occurrences.join(parents, "fragment", "left_semi")
            occurrences = grown(extensions(growing, near), tree).select("graph_id", "fragment", "m")
    out = single_vertices(near).where("1 = 0") if out is None else out
    found = by_graph(out.join(pins, "fragment", "left_semi")).withColumnRenamed("graph_id", "first")
    return members.select("graph_id", "first").join(found.hint("merge"), "first").drop("first")
