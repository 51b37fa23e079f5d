"""Graph operators as joins and aggregations to a fixed point; each round is cut in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.lineage import cut, stored

Keep = Callable[[DataFrame], DataFrame]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that it reaches, in either direction.

    Alternating large-star and small-star steps: each keeps the components and moves links nearer to the smallest
    node, until every link is one to it. Loops and rows with a null end are no links. Rounds grow with the logarithm
    of the longest path; a round shuffles the links, no group of them is ever gathered. The smallest neighbours are stored tables of a row a node, so
    that adaptive execution splits the links of a node that very many have.
    """
    links = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    links = cut(links)
    while True:
        # of a node without a smaller neighbour, so of every star's centre, the links stay as they are: it has no row in least
        now, least = _mark(links), stored(links.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")))
        large = stored(links.join(least, F.col("v") == F.col("of"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        if now == _mark(large) and now[0] == least.count():
            break  # each link goes to a node without a smaller neighbour, and a node has one link: all are stars
        least = stored(large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("of")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut(small.select("e.*").where("u > v").distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _with(nodes: DataFrame, by: list, c: str) -> DataFrame:
    """nodes (..., node) as rows that a link's end c can be joined to."""
    return nodes.select(*by, F.col("node").alias(c))


def _trimmed(links: DataFrame, by: list) -> DataFrame:
    """Links whose start has a way in and whose end a way out; the others are on no cycle."""
    ends, starts = links.select(*by, F.col("v").alias("u")).distinct(), links.select(*by, F.col("u").alias("v")).distinct()
    return links.join(ends, [*by, "u"], "left_semi").join(starts, [*by, "v"], "left_semi").select(*by, "u", "v")


def _spliced(links: DataFrame, turn: int, by: list, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(links, gone): nodes with one way in and one out are taken out of their chains, no two neighbours at once; gone has (x, a, b), its neighbours."""
    into = links.groupBy(*by, F.col("v").alias("x")).agg(F.first("u").alias("a"), F.count("*").alias("_in"))
    out = links.groupBy(*by, F.col("u").alias("x")).agg(F.first("v").alias("b"), F.count("*").alias("_out"))
    thin = into.join(out, [*by, "x"]).where("_in = 1 and _out = 1 and x <> a and x <> b").select(*by, "x", "a", "b")
    draw = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    rival = lambda c: thin.join(thin.select(*by, F.col("x").alias(c)), [*by, c], "left_semi").where(draw(c) >= draw("x")).select(*by, "x")
    gone = keep(thin.join(rival("a").union(rival("b")).distinct(), [*by, "x"], "left_anti"))
    nodes = gone.select(*by, F.col("x").alias("node"))
    left = links.join(_with(nodes, by, "u"), [*by, "u"], "left_anti").join(_with(nodes, by, "v"), [*by, "v"], "left_anti").select(*by, "u", "v")
    return left.union(gone.select(*by, F.col("a").alias("u"), F.col("b").alias("v"))).distinct(), gone


def _least_before(links: DataFrame, nodes: DataFrame, by: list, keep: Keep) -> DataFrame:
    """(node, label): the smallest node that reaches each node along links, itself included.

    `via` is a node that reaches it too; looking at its label and going on to its via doubles the steps on a chain.
    """
    state, before, now = keep(nodes.select(*by, "node", F.col("node").alias("label"), F.col("node").alias("via"))), None, 1
    while before != now:
        came = links.join(state.withColumnRenamed("node", "u"), [*by, "u"]).groupBy(*by, F.col("v").alias("node")).agg(F.min(F.struct("label", F.col("u").alias("via"))).alias("c"))
        far = state.select(*by, F.col("node").alias("via"), F.col("label").alias("_label"), F.col("via").alias("_next"))
        step = state.join(far, [*by, "via"]).join(came, [*by, "node"], "left")
        label = F.least("label", "_label", F.col("c.label"))
        via = F.when(F.col("c.label") <= F.least("label", "_label"), F.col("c.via")).otherwise(F.col("_next"))
        state = keep(step.select(*by, "node", label.alias("label"), via.alias("via")))
        before, now = now, tuple(state.agg(F.count("*"), F.sum(F.xxhash64(*by, "node", "label").cast("decimal(38,0)"))).first())
    return state.select(*by, "node", "label")


def cycle_members(edges: DataFrame, u: str, v: str, by: Sequence[str] = (), keep: Keep = cut) -> DataFrame:
    """(node, component) for each node on a directed cycle, loops included; component is the smallest node of its cycle's.

    First nodes without a way in or out go, and nodes with one of each are taken out of their chains, a third of a chain a
    round, so that long chains take few rounds. What is left is coloured by the smallest node that reaches each node; of a colour, the
    nodes that reach that smallest one are a component, and the rest is coloured again. Nothing but links and one row a node is ever made.
    Rounds of colouring grow with the longest path that isn't a chain, at worst.

    by: columns of edges, within whose values nodes are told apart; they come before node. keep computes a table once, rows with equal `by` staying where they are.
    """
    by = list(by)
    links = keep(edges.select(*by, F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null").distinct())
    loops = links.where("u = v").select(*by, F.col("u").alias("node"))
    links, gone, turn, size = links.where("u <> v"), [], 0, None
    while True:
        links = keep(_trimmed(links, by))
        left = links.count()
        if not left or size is not None and left > 0.9 * size:
            break
        spliced, taken = _spliced(links, turn, by, keep)
        spliced, size, turn = keep(spliced), left, turn + 1
        # a chain that led back to its start is a loop now: a cycle that its node stands for
        gone.append((taken, spliced.where("u = v").select(*by, F.col("u").alias("node"))))
        links = spliced.where("u <> v")
    if not gone:
        return loops.withColumn("component", F.col("node"))  # nothing but loops
    found = keep(links.where("false").select(*by, F.col("u").alias("node"), F.col("u").alias("label")))
    while left:
        nodes = links.select(*by, F.explode(F.array("u", "v")).alias("node")).distinct()
        colour = _least_before(links, nodes, by, keep)
        a, b = (colour.select(*by, F.col("node").alias(x), F.col("label").alias(f"_{x}l")) for x in "uv")
        within = keep(links.join(a, [*by, "u"]).join(b, [*by, "v"]).where("_ul = _vl").select(*by, "u", "v"))
        back = _least_before(within.select(*by, F.col("v").alias("u"), F.col("u").alias("v")), nodes, by, keep).withColumnRenamed("label", "reaches")
        members = keep(colour.join(back, [*by, "node"]).where("reaches = label").select(*by, "node", "label"))
        some = members.groupBy(*by, "label").count().where("count > 1").select(*by, "label")
        found = keep(found.union(members.join(some, [*by, "label"], "left_semi").select(*by, "node", "label")))
        links = within.join(_with(members, by, "u"), [*by, "u"], "left_anti").join(_with(members, by, "v"), [*by, "v"], "left_anti").select(*by, "u", "v")
        links = keep(_trimmed(links, by))
        left = links.count()
    alone = lambda nodes: nodes.join(found.select(*by, "node"), [*by, "node"], "left_anti").select(*by, "node", F.col("node").alias("label"))
    # nodes taken out come back where both of their neighbours are in one component, the last ones first
    for taken, turned in reversed(gone):
        found = keep(found.union(alone(turned)))
        a, b = (found.select(*by, F.col("node").alias(x), F.col("label").alias(f"_{x}")) for x in "ab")
        found = keep(found.union(taken.join(a, [*by, "a"]).join(b, [*by, "b"]).where("_a = _b").select(*by, "x", "_a")))
    found = keep(found.union(alone(loops)))
    least = found.groupBy(*by, "label").agg(F.min("node").alias("component"))
    return found.join(least, [*by, "label"]).select(*by, "node", "component")
