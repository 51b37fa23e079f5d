"""Operators against brute force, and their edge cases."""

import random

from pyspark.sql import functions as F

from quire.functions.text import chinese_number, decoded, folded, free_suffix, indent_em, lenient_int, list_marker, note_number, relative, resolve
from quire.operators import changes, graph, matching, ordered, report


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.select(column(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_chinese_numbers(spark):
    assert values(spark, chinese_number, ["一", "十", "十二", "二十", "三十五", "一百零八", "两百", "零", "", "x", None, "百"]) == [1, 10, 12, 20, 35, 108, 200, None, None, None, None, 100]


def test_markers(spark):
    cases = {
        "1. x": ("ol", "num", 1), "12、项": ("ol", "num", 12), "１２． x": ("ol", "num", 12), "1.5": None, "3)": ("ol", "num", 3), "①　x": ("ol", "circ", 1), "⑳ x": ("ol", "circ", 20),
        "(3) x": ("ol", "paren", 3), "（十二）项": ("ol", "paren", 12), "三、项": ("ol", "cn", 3), "b) x": ("ol", "alpha", 2), "B. x": ("ol", "alpha", 2), "be. x": None,
        "• x": ("ul", "bullet", None), "•x": None, "- item": None, "-  item": ("ul", "dash", None), "- 项": ("ul", "dash", None), "": None, None: None, "2,000 x": None, "1234. x": None,
    }
    got = values(spark, list_marker, list(cases))
    assert [g and (g.family, g.kind, g.number) for g in got] == list(cases.values())


def test_note_numbers(spark):
    cases = ["[1] x", "【注12】x", "(007)", "3. x", "注4、x", "5", "x [1]", "", None]
    assert values(spark, note_number, cases) == [1, 12, 7, 3, 4, None, None, None, None]
    assert values(spark, lambda c: note_number(c, whole=True), ["[1]", " （２） ", "[1] x", "1.", None]) == [1, 2, None, None, None]


def test_lenient_numbers_and_indents(spark):
    assert values(spark, lenient_int, ["5", " +7 ", "-3", "５", "5.7", "x", "", None]) == [5, 7, -3, 5, None, None, None, None]
    assert values(spark, indent_em, ["margin-left: 2em", "padding-left:32px", "text-indent: 1.5rem", "color:red", None, "text-indent:1em; margin-left:3em"]) == [2.0, 2.0, 1.5, 0.0, 0.0, 3.0]


def test_paths(spark):
    assert values(spark, folded, ["a/../b/./c", "../../x", "", "/a//b"]) == ["b/c", "x", "", "a/b"]
    assert values(spark, decoded, ["a%20b+c", "%zz", "é%C3%A9"]) == ["a b+c", "%zz", "éé"]
    refs = ["b.x#f", "#f", "../z/q.x", "/r.x", "c%20d.x", "./e.x"]
    assert values(spark, lambda c: resolve(F.lit("a/k/doc.x"), c), refs) == ["a/k/b.x", "a/k/doc.x", "a/z/q.x", "r.x", "a/k/c d.x", "a/k/e.x"]
    targets = ["a/k/b.x", "a/k/doc.x", "a/z/q.x", "r.x", "a/k/n/m.x"]
    assert values(spark, lambda c: relative(F.lit("a/k/doc.x"), c, F.lit("f")), targets) == ["b.x#f", "#f", "../z/q.x#f", "../../r.x#f", "n/m.x#f"]
    df = spark.createDataFrame([(["n", "n-2"],), ([],), (["n"],)], "taken array<string>")
    assert [r[0] for r in df.select(free_suffix(F.col("taken"), F.lit("n"))).collect()] == ["n-3", "n", "n-2"]


def test_undo_is_a_stack(spark):
    rng = random.Random(2)
    rows = [(b, i, "undo" if rng.random() < 0.45 else "edit") for b in "abc" for i in range(60)]
    want = {}
    for b in "abc":
        stack = []
        for _, i, kind in (r for r in rows if r[0] == b):
            if kind == "edit":
                stack.append(i)
                want[b, i] = False
            elif stack:
                want[b, stack.pop()] = True
    log = spark.createDataFrame(rows, "book string, id int, kind string")
    got = changes.apply_undo(log, ["book"], "id", "kind")
    assert {(r.book, r.id): r.undone for r in got.where("kind = 'edit'").collect()} == want
    assert changes.last_active(got, ["book"], "id", F.expr("kind = 'edit' and not undone")).count() <= 3


def test_graphs(spark):
    rng = random.Random(4)
    for n, m in ((12, 14), (30, 25), (6, 0), (1, 1)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1)]
        reach = {a: {a} for a in range(n)}
        way = {a: {y for x, y in edges if x == a} for a in range(n)}
        for _ in range(n):
            for a in range(n):
                way[a] |= {z for y in list(way[a]) for z in way[y]}
                reach[a] |= {y for x, y in edges if x in reach[a]} | {x for x, y in edges if y in reach[a] and x is not None}
        df = spark.createDataFrame(edges, "a int, b int")
        cycles = {a: min(b for b in range(n) if b in way[a] and a in way[b]) for a in range(n) if a in way[a]}
        assert sorted(map(tuple, graph.cycle_members(df, "a", "b").collect())) == sorted(cycles.items())
        linked = {a: min(reach[a]) for a in range(n) if len(reach[a]) > 1}
        assert sorted(map(tuple, graph.connected_components(df, "a", "b").collect())) == sorted(linked.items())


def test_long_path_is_one_component(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.connected_components(df, "a", "b").collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def test_runs_and_bags(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x"), (5, "x")], "i int, k string").withColumn("g", F.lit(0))
    got = ordered.islands(df, ["g"], ["i"], ~F.col("k").eqNullSafe(F.col("lag_k")))
    assert sorted((r.i, r.run_length) for r in got.collect()) == [(1, 2), (2, 2), (4, 2), (5, 2)]
    before = spark.createDataFrame([("a", "p")] * 3 + [("a", None)] + [("b", "q")], "g string, t string")
    after = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "q")], "g string, t string")
    lost = {(r.g, r.t): r.lost for r in matching.bag_difference(before, after, ["g"], "t").collect()}
    assert lost == {("a", "p"): 2, ("a", None): 1}
    assert matching.bag_difference(before, before, ["g"], "t").count() == 0


def test_reorder_rejects_what_is_not_whole(spark):
    items = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 0)], "g string, t string, pos int")
    order = spark.createDataFrame([("a", "y", 0), ("a", "x", 1), ("b", "w", 0)], "g string, t string, pos int")
    moved, bad = changes.reorder(items, order, ["g"], "t", "pos")
    assert sorted(map(tuple, moved.collect())) == [("a", "x", 1), ("a", "y", 0), ("b", "z", 0)] and [r.g for r in bad.collect()] == ["b"]


def test_replace_and_new_only(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9)], "k string, v int")
    assert sorted(map(tuple, changes.replace_rows(old, new, ["k"]).collect())) == [("a", 9), ("b", 3)]
    assert changes.replace_rows(old, new.limit(0), ["k"], scope=new).count() == 1
    assert changes.new_only(new, old, ["k", "v"]).count() == 1


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([("b", "c2", "<x>"), ("b", "c1", 'a&"'), ("b", "c1", None)], "book string, check string, msg string")
    parts = report.html_report(found, "book", "check", ["msg"], ["msg"], rows=1).orderBy("check", "part").collect()
    assert [(r.check, r.part, r.n) for r in parts] == [("c1", 0, 2), ("c1", 1, 2), ("c2", 0, 1)]
    assert parts[0].html == "<h2>b: c1 (2)</h2><table><tr><th>msg</th></tr><tr><td></td></tr></table>"
    assert parts[1].html == "<table><tr><th>msg</th></tr><tr><td>a&amp;&quot;</td></tr></table>" and "&lt;x&gt;" in parts[2].html
    log = spark.createDataFrame([(i, "edit", i % 2) for i in range(5)], "id int, kind string, undone int")
    report.write_changes(log, f"file://{tmp_path}/csv", ["id", "kind", "undone"], "id", {"edit": "Edit"}, limit=3)
    rows = spark.read.csv(f"file://{tmp_path}/csv", header=True).collect()
    assert [(r.id, r.kind, r.undone) for r in rows] == [("2", "Edit", "no"), ("3", "Edit", "yes"), ("4", "Edit", "no")]


def test_cycles_of_chains(spark):
    ring = [(i, (i + 1) % 400) for i in range(400)]  # one long cycle
    tail = [(1000 + i, 1001 + i) for i in range(300)]  # a long way to nowhere
    eight = [(2000, 2001), (2001, 2002), (2002, 2000), (2002, 2003), (2003, 2004), (2004, 2002)]  # two cycles with one node in common
    bridge = [(399, 2000), (5, 1000)]
    loop = [(3000, 3000), (3001, 3000), (3000, 3002)]
    df = spark.createDataFrame(ring + tail + eight + bridge + loop, "a int, b int")
    rows = graph.cycle_members(df, "a", "b").collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got)
    assert got == {i: 0 for i in range(400)} | {i: 2000 for i in range(2000, 2005)} | {3000: 3000}


def reachable(edges):
    nodes = sorted({x for e in edges for x in e})
    way = {a: {b for x, b in edges if x == a} for a in nodes}
    for _ in nodes:
        way = {a: way[a].union(*[way[b] for b in way[a]]) for a in nodes}
    return sorted((a, min(b for b in nodes if b in way[a] and a in way[b])) for a in nodes if a in way[a])


def test_loops_within_cycles(spark):
    """A node with a loop is one row, whether chains take it out or not."""
    draw = random.Random(11)
    graphs = [[(3, 3), (1, 3), (3, 2), (2, 1)], [(1, 1), (2, 1), (1, 3), (3, 2)], [(5, 6), (6, 5), (6, 6), (6, 7), (7, 8), (8, 6), (5, 5)], [(9, 9), (9, 10), (10, 11)]]
    graphs += [[(draw.randrange(9), draw.randrange(9)) for _ in range(draw.randrange(4, 14))] for _ in range(12)]
    # side by side in one table: numbers far apart
    edges = [(a + 1000 * k, b + 1000 * k) for k, g in enumerate(graphs) for a, b in g]
    edges += [(a + 1000 * k + 30, b + 1000 * k + 30) for k, g in enumerate(graphs) for a, b in g]  # other numbers, another draw of who leaves a chain first
    want = sorted(r for k, g in enumerate(graphs) for shift in (1000 * k, 1000 * k + 30) for r in reachable([(a + shift, b + shift) for a, b in g]))
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, graph.cycle_members(df, "a", "b").collect())) == want


def test_a_star_of_links(spark):
    """The links of a centre, smallest or largest of its component, spread over tasks."""
    n = 3000
    star = spark.range(1, n).selectExpr("id AS a", "0 AS b").union(spark.range(n + 1, 2 * n).selectExpr(f"{2 * n} AS a", "id AS b"))
    got = {(r.node, r.component) for r in graph.connected_components(star, "a", "b").collect()}
    assert got == {(i, 0) for i in range(n)} | {(i, n + 1) for i in range(n + 1, 2 * n + 1)}
