"""Parent-child links to full hierarchies: routes from every root, depth, paths, descendants, and circles.

Links form a general graph: a node may have several parents, and there may be circles. Its nodes with exactly one parent form
trees that hang from the other nodes (roots without a parent, junctions with several). The work is split accordingly:

1. circles that no outside node leads into are exposed by pointer doubling and opened at their first node;
2. the trees get Euler tours, ranked in parallel: entry and exit of each node, hence depth, ancestors, descendants;
3. what is left is the much smaller graph between the tops of trees; routes over it are found by frontier steps, which take
   more and more links at once where the graph is deep; its circles by a search in one task if the graph is small enough, else
   by peeling what can't lie on one and then by colours. Marks on the tours turn both into results for all nodes.

Every step is a join on a key; no step collects a node's children or a tree in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.operators import local
from headwater.scratch import Scratch

#: Siblings are ordered within so many groups per parent, so that a parent with very many children isn't sorted by one task.
SIBLING_GROUPS = 64
#: Tour positions per block when marks are searched along a tour.
TOUR_BLOCK = 65_536
#: Rounds of single steps before steps are joined to longer ones, and how many times as many ways there may be to join them.
PLAIN_ROUNDS, WIDEST = 4, 16


def _edges(links: DataFrame, child: str, parent: str) -> DataFrame:
    return links.select(F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child is not null and parent is not null and child <> parent").distinct()


def _open_circles(scratch: Scratch, single: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Circles in which each node's only parent is on the circle itself.

    single: child, parent of all nodes with one parent; tops: node of all others. Returns the nodes on circles (node, first,
    size) and the first node of each circle as further tops.

    After k doublings each pointer leads to the ancestor 2^k links up, or to the top if that is nearer. What hasn't come to a
    top after as many links as there are such nodes lies on a circle or below one, and what such pointers lead to lies on it.
    """
    jump = scratch.save(
        single.join(tops.select(F.col("node").alias("parent"), F.lit(True).alias("done")), "parent", "left")
        .select(F.col("child").alias("node"), F.col("parent").alias("up"), F.least("child", "parent").alias("first"), F.coalesce("done", F.lit(False)).alias("done"))
        .filter("not done")
        .drop("done")
    )
    left, step = jump.count(), 1
    while left and step < 2 * left:
        nxt = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("first").alias("first2"))
        # A pointer to a node that is gone has reached a top, so it goes too.
        jump = scratch.replace(jump, jump.join(nxt, "up").select("node", F.col("up2").alias("up"), F.least("first", "first2").alias("first")))
        left, step = jump.count(), step * 2
    on = jump.select(F.col("up").alias("node")).distinct()
    circles = on.join(jump.select("node", "first"), "node")
    sizes = circles.groupBy("first").agg(F.count(F.lit(1)).cast("int").alias("size"))
    circles = scratch.save(circles.join(sizes, "first").select("node", "first", "size"))
    scratch.drop(jump)
    return circles, circles.filter("node = first").select("node")


def euler_tours(scratch: Scratch, forest: DataFrame, tops: DataFrame) -> DataFrame:
    """Euler tours of a forest by parallel list ranking.

    forest: child, parent with one row per child; tops: node without a parent here. Result: node, top, depth, entry, exit;
    entry < exit, and u is an ancestor of v just if top is the same and entry(u) <= entry(v) and exit(v) <= exit(u).

    Each node is an arc down (into it) and one up (out of it), each arc naming its successor. Doubling the successors gives
    each arc its number of arcs to the end of the tour, and the sum of +1 and -1 over them, which is the depth.
    """
    kids = forest.withColumn("grp", F.pmod(F.xxhash64("child"), F.lit(SIBLING_GROUPS)).cast("int"))
    in_group = Window.partitionBy("parent", "grp").orderBy("child")
    kids = kids.withColumn("sibling", F.lead("child").over(in_group))
    groups = kids.groupBy("parent", "grp").agg(F.min("child").alias("head"))
    over_groups = Window.partitionBy("parent").orderBy("grp")
    groups = groups.withColumn("next_head", F.lead("head").over(over_groups)).withColumn("is_first", F.row_number().over(over_groups) == 1)
    kids = kids.join(groups.select("parent", "grp", "next_head"), ["parent", "grp"]).select("child", "parent", F.coalesce("sibling", "next_head").alias("sibling"))
    first_kid = groups.filter("is_first").select(F.col("parent").alias("node"), F.col("head").alias("kid"))
    nodes = kids.select(F.col("child").alias("node"), "parent", "sibling").unionByName(tops.select("node").withColumn("parent", F.lit(None).cast("string")).withColumn("sibling", F.lit(None).cast("string")))
    nodes = nodes.join(first_kid, "node", "left")
    down = nodes.select("node", F.lit(0).alias("way"), F.coalesce("kid", "node").alias("to"), F.when(F.col("kid").isNotNull(), 0).otherwise(1).alias("to_way"), F.lit(1).alias("turn"))
    up = nodes.select("node", F.lit(1).alias("way"), F.coalesce("sibling", "parent").alias("to"), F.when(F.col("sibling").isNotNull(), 0).otherwise(1).alias("to_way"), F.lit(-1).alias("turn"))
    # steps: arcs from here to the arc pointed to; turn: their sum of +1 and -1, without that arc's; end: the last arc's node.
    arcs = down.unionByName(up).select("node", "way", "to", "to_way", F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("turn").cast("bigint"), F.when(F.col("to").isNull(), F.col("node")).alias("end"))
    arcs = scratch.save(arcs)
    while not arcs.filter("to is not null").isEmpty():
        open_, done = arcs.filter("to is not null"), arcs.filter("to is null")
        nxt = arcs.select(F.col("node").alias("to"), F.col("way").alias("to_way"), F.col("to").alias("to2"), F.col("to_way").alias("to_way2"), F.col("steps").alias("steps2"), F.col("turn").alias("turn2"), F.col("end").alias("end2"))
        doubled = open_.join(nxt, ["to", "to_way"]).select("node", "way", F.col("to2").alias("to"), F.col("to_way2").alias("to_way"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("turn") + F.col("turn2")).alias("turn"), F.col("end2").alias("end"))
        arcs = scratch.replace(arcs, done.unionByName(doubled))
    # From an arc to the end: down(v) has turn 1 + ... and the tour's sum is 0, so the depth of v is 0 - turn(down(v)).
    down = arcs.filter("way = 0").select("node", F.col("end").alias("top"), F.col("steps").alias("d_steps"), (-F.col("turn")).cast("int").alias("depth"))
    up = arcs.filter("way = 1").select("node", F.col("steps").alias("u_steps"))
    tours = down.join(up, "node").select("node", "top", "depth", (-F.col("d_steps")).alias("entry"), (-F.col("u_steps")).alias("exit"))
    tours = scratch.save(tours)
    scratch.drop(arcs)
    return tours


class _Steps:
    """Steps between tops, of which some become longer round by round: src, dst and the least ``way``.

    Joining each two of the longest steps gives those of twice as many links, so a way of n links is made of some log(n) steps. There
    may be more of the longer steps than of single ones, so they are joined only while the ways to do so are counted to be at
    most WIDEST times the first steps. Deep, narrow graphs then take a number of rounds logarithmic in their depth, shallow ones
    need none of it; a graph both deep and wide takes a round for every so many links.
    """

    def __init__(self, scratch: Scratch, steps: DataFrame, join: Callable[[Column, Column], Column], length: Callable[[Column], Column]):
        self.scratch, self.join, self.length, self.rounds, self.grows = scratch, join, length, 0, True
        self.table = self.longest = scratch.save(self._least(steps))
        self.first = self.table.count()

    def _least(self, steps: DataFrame) -> DataFrame:
        shortest = F.min(F.struct(self.length(F.col("way")).alias("n"), F.col("way").alias("way")))
        return steps.groupBy("src", "dst").agg(shortest.alias("b")).select("src", "dst", "b.way")

    def next(self) -> DataFrame:
        """The steps for the next round."""
        self.rounds += 1
        if self.rounds > PLAIN_ROUNDS and self.grows:
            into = self.longest.groupBy(F.col("dst").alias("via")).agg(F.count(F.lit(1)).alias("i"))
            out = self.longest.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("o"))
            ways = into.join(out, "via").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0]
            self.grows = 0 < ways <= WIDEST * self.first
            if self.grows:
                ahead = self.longest.select(F.col("src").alias("dst"), F.col("dst").alias("dst2"), F.col("way").alias("way2"))
                twice = self.longest.join(ahead, "dst").select("src", F.col("dst2").alias("dst"), self.join(F.col("way"), F.col("way2")).alias("way"))
                self.longest = self.scratch.save(self._least(twice))
                self.table = self.table.unionByName(self.longest)
        return self.table


def _frontier(scratch: Scratch, roots: DataFrame, steps: _Steps, none: Column) -> DataFrame:
    """The best way from each root to each top: root, top, way; from a root to itself it is ``none``. Only what a round has bettered
    is carried on."""
    best = scratch.save(roots.select(F.col("node").alias("root"), F.col("node").alias("top"), none.alias("way"), F.lit(True).alias("fresh")))
    while not best.filter("fresh").isEmpty():
        ahead = steps.next().select(F.col("src").alias("top"), F.col("dst"), F.col("way").alias("way2"))
        found = best.filter("fresh").join(ahead, "top").select("root", F.col("dst").alias("top"), steps.join(F.col("way"), F.col("way2")).alias("way"), F.lit(True).alias("fresh"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(found)
        least = F.min(F.struct(steps.length(F.col("way")).alias("n"), "way", "fresh"))
        best = scratch.replace(best, both.groupBy("root", "top").agg(least.alias("b")).select("root", "top", "b.way", "b.fresh"))
    return best.select("root", "top", "way")


def _routes(scratch: Scratch, roots: DataFrame, steps: DataFrame) -> DataFrame:
    """Fewest links from each root to each top: root, top, dist. steps: src, dst, weight between tops, weight at least 1."""
    graph = _Steps(scratch, steps.select("src", "dst", F.col("weight").alias("way")), lambda a, b: a + b, lambda a: a)
    return _frontier(scratch, roots, graph, F.lit(0)).withColumnRenamed("way", "dist")


def _tree_paths(scratch: Scratch, forest: DataFrame, tops: DataFrame) -> DataFrame:
    """Each node's path within its tree, by doubling: node, top, names (from the top to the node itself).

    After k rounds a node holds the nearest 2^k names above it; the rows written in all never exceed the result by more than the
    number of rounds.
    """
    no_top = F.lit(None).cast("string")
    paths = scratch.save(
        tops.select("node", no_top.alias("up"), F.col("node").alias("top"), F.array("node").alias("names"))
        .unionByName(forest.select(F.col("child").alias("node"), F.col("parent").alias("up"), no_top.alias("top"), F.array("child").alias("names")))
    )
    while not paths.filter("up is not null").isEmpty():
        above = paths.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("names").alias("names2"))
        longer = paths.filter("up is not null").join(above, "up").select("node", F.col("up2").alias("up"), F.col("top2").alias("top"), F.concat("names2", "names").alias("names"))
        paths = scratch.replace(paths, paths.filter("up is null").unionByName(longer))
    return paths.select("node", "top", "names")


def _top_paths(scratch: Scratch, roots: DataFrame, steps: DataFrame) -> DataFrame:
    """A path from each root to each top: root, top, before (the names from the root to the one above the top).

    steps: src, dst, leg (the names from src through its tree to the parent of dst). Of all paths with the fewest links the
    alphabetically first is kept; as those before one top have the same length, what comes first stays first with each leg.
    """
    graph = _Steps(scratch, steps.select("src", "dst", F.col("leg").alias("way")), lambda a, b: F.concat(a, b), F.size)
    return _frontier(scratch, roots, graph, F.array().cast("array<string>")).withColumnRenamed("way", "before")


def _peel(scratch: Scratch, steps: DataFrame) -> DataFrame:
    """Steps that can lie on a circle: rounds remove all nodes nothing leads to, or that lead nowhere."""
    steps = scratch.save(steps)
    left = steps.count()
    while left:
        inner = steps.select(F.col("src").alias("n")).distinct().join(steps.select(F.col("dst").alias("n")).distinct(), "n")
        steps = scratch.replace(steps, steps.join(inner.select(F.col("n").alias("src")), "src", "left_semi").join(inner.select(F.col("n").alias("dst")), "dst", "left_semi"))
        now = steps.count()
        if now == left:
            break
        left = now
    return steps


def _components(scratch: Scratch, steps: DataFrame) -> DataFrame:
    """Strongly connected components that hold a circle: top, comp.

    A graph of at most LOCAL_EDGES steps is searched by one task. In a larger one, each node takes the least name that reaches it as its colour; from the node that gave the colour, those of the same colour
    that can reach it form a component. Components are taken out and the rest is peeled and coloured again.
    """
    steps = scratch.save(steps.select("src", "dst").distinct())
    if steps.count() <= local.LOCAL_EDGES:
        return scratch.save(local.in_one_task(steps, local.circles, "top string, comp string"))
    steps = _peel(scratch, steps)
    found = None
    while not steps.isEmpty():
        color = scratch.save(steps.select(F.explode(F.array("src", "dst")).alias("top")).distinct().withColumn("color", F.col("top")).withColumn("fresh", F.lit(True)))
        while not color.filter("fresh").isEmpty():
            sent = color.filter("fresh").join(steps, F.col("top") == F.col("src")).groupBy(F.col("dst").alias("top")).agg(F.min("color").alias("got"))
            lower = F.col("got") < F.col("color")
            color = scratch.replace(color, color.join(sent, "top", "left").select("top", F.when(lower, F.col("got")).otherwise(F.col("color")).alias("color"), F.coalesce(lower, F.lit(False)).alias("fresh")))
        colors = color.select("top", "color")
        same = scratch.save(
            steps.join(colors.select(F.col("top").alias("src"), F.col("color").alias("c1")), "src").join(colors.select(F.col("top").alias("dst"), F.col("color").alias("c2")), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("color"))
        )
        # A colour's origin is in a circle only if something of the same colour leads back to it.
        back = scratch.save(same.filter("dst = color").select(F.col("dst").alias("top"), "color").distinct().withColumn("fresh", F.lit(True)))
        while not back.filter("fresh").isEmpty():
            f = back.filter("fresh").select(F.col("top").alias("dst"), "color")
            more = same.join(f, ["dst", "color"]).select(F.col("src").alias("top"), "color").distinct().join(back.select("top", "color"), ["top", "color"], "left_anti")
            back = scratch.replace(back, back.withColumn("fresh", F.lit(False)).unionByName(more.withColumn("fresh", F.lit(True))))
        got = scratch.save(back.select("top", F.col("color").alias("comp")))
        # Origins without a circle leave the graph as well, so each round removes at least every origin.
        gone = got.select("top").unionByName(colors.filter("top = color").select("top")).distinct()
        rest = steps.join(gone.select(F.col("top").alias("src")), "src", "left_anti").join(gone.select(F.col("top").alias("dst")), "dst", "left_anti")
        found = got if found is None else found.unionByName(got)
        new_steps = _peel(scratch, rest.select("src", "dst"))
        for old in (steps, color, same, back):
            scratch.drop(old)
        steps = new_steps
    return found if found is not None else scratch.spark.createDataFrame([], "top string, comp string")


def _marked_ancestors(tours: DataFrame, marks: DataFrame) -> DataFrame:
    """Nodes with a marked node in their subtree (themselves included), once for each label.

    marks: top, entry, label. A node has one just if the next mark at or behind its entry comes before its exit. The next mark is
    searched in blocks of the tour: in the node's own block, else the first of a later block.
    """
    near = tours.join(marks.select("top", "label").distinct(), "top").select("node", "top", "entry", "exit", "label", F.lit(None).cast("bigint").alias("mark"))
    rows = near.unionByName(marks.select(F.lit(None).cast("string").alias("node"), "top", "entry", F.lit(None).cast("bigint").alias("exit"), "label", F.col("entry").alias("mark")))
    rows = rows.withColumn("blk", F.floor(F.col("entry") / TOUR_BLOCK))
    first = rows.groupBy("top", "label", "blk").agg(F.min("mark").alias("m"))
    later = Window.partitionBy("top", "label").orderBy("blk").rowsBetween(1, Window.unboundedFollowing)
    first = first.select("top", "label", "blk", F.min("m").over(later).alias("later"))
    here = Window.partitionBy("top", "label", "blk").orderBy("entry").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("near", F.min("mark").over(here)).filter("node is not null").join(first, ["top", "label", "blk"])
    return rows.filter(F.coalesce("near", "later") <= F.col("exit")).select("node", "label").distinct()


class Hierarchy:
    """All that follows from the links of a table.

    links: child, parent (a child depends on its parent); nulls and links of a node to itself are ignored, repeated ones count
    once. nodes: further nodes without links. Names compare as they stand.

    tours: node, top, depth, entry, exit of the trees of single parents.
    steps: src, dst, weight, via: from a top through its tree to a junction below it.
    """

    def __init__(self, links: DataFrame, child: str = "child", parent: str = "parent", nodes: DataFrame | None = None):
        spark = links.sparkSession
        self.scratch = scratch = Scratch(spark, "hierarchy")
        self.edges = edges = scratch.save(_edges(links, child, parent))
        everyone = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
        if nodes is not None:
            everyone = everyone.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null"))
        degree = everyone.distinct().join(edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("only")), "node", "left")
        degree = scratch.save(degree.select("node", F.coalesce("n", F.lit(0)).alias("n"), "only"))
        self.roots = degree.filter("n = 0").select("node")
        tops = degree.filter("n <> 1").select("node")
        single = degree.filter("n = 1").select(F.col("node").alias("child"), F.col("only").alias("parent"))
        self.circles, opened = _open_circles(scratch, single, tops)
        forest = single.join(opened.select(F.col("node").alias("child")), "child", "left_anti")
        self.tours = euler_tours(scratch, forest, tops.unionByName(opened))
        self._forest, self._tops, self._trees = forest, tops.unionByName(opened), None
        # The links taken out where circles were opened; no root leads to them.
        self._opening = single.join(opened.select(F.col("node").alias("child")), "child", "left_semi")
        junction = degree.filter("n > 1").select(F.col("node").alias("child"))
        place = self.tours.select(F.col("node").alias("parent"), F.col("top").alias("src"), F.col("depth"), F.col("entry"))
        self.steps = scratch.save(edges.join(junction, "child").join(place, "parent").select("src", F.col("child").alias("dst"), (F.col("depth") + 1).alias("weight"), F.col("parent").alias("via"), "entry"))

    def routes(self) -> DataFrame:
        """Each node that a root leads to, with the fewest links from it: root, node, n_links. A root reaches itself with 0."""
        best = _routes(self.scratch, self.roots, self.steps)
        return self.tours.join(best, "top").select("root", "node", (F.col("dist") + F.col("depth")).cast("int").alias("n_links"))

    def cycles(self) -> DataFrame:
        """Each node on a circle, with the circle's alphabetically first node and size: node, first, size.

        Circles that share a node, so that each leads into the other, count as one.
        """
        comps = _components(self.scratch, self.steps)
        inside = self.steps.join(comps.select(F.col("top").alias("src"), "comp"), "src").join(comps.select(F.col("top").alias("dst"), F.col("comp").alias("comp2")), "dst").filter("comp = comp2")
        marked = _marked_ancestors(self.tours, inside.select(F.col("src").alias("top"), "entry", F.col("comp").alias("label")).distinct())
        whole = marked.unionByName(comps.select(F.col("top").alias("node"), F.col("comp").alias("label"))).distinct()
        sizes = whole.groupBy("label").agg(F.min("node").alias("first"), F.count(F.lit(1)).cast("int").alias("size"))
        return whole.join(sizes, "label").select("node", "first", "size").unionByName(self.circles)

    def _tree_paths(self) -> DataFrame:
        if self._trees is None:
            self._trees = _tree_paths(self.scratch, self._forest, self._tops)
        return self._trees

    def descendants(self) -> DataFrame:
        """All nodes that depend on a node, with the fewest links between: ancestor, node, distance.

        Nodes on a circle depend on themselves, at the circle's length. Within a tree the pairs are the names of the tree paths;
        all others lead through a step below the ancestor to a top that is, or leads to, the top of the node.
        """
        trees = self._tree_paths()
        named = trees.select("node", "top", F.size("names").alias("n"), F.posexplode("names").alias("i", "ancestor"))
        inside = named.filter("ancestor <> node").select("ancestor", "node", (F.col("n") - 1 - F.col("i")).alias("distance"))
        closing = self._opening.select(F.col("parent").alias("via"), F.col("child").alias("dst"))
        steps = self.scratch.save(self.steps.select("via", "dst").unionByName(closing).join(named.select(F.col("node").alias("via"), "top", "ancestor", (F.col("n") - F.col("i")).alias("weight")), "via"))
        between = _routes(self.scratch, steps.select(F.col("dst").alias("node")).distinct(), steps.filter("ancestor = top").select(F.col("top").alias("src"), "dst", "weight"))
        down = steps.join(between.select(F.col("root").alias("dst"), F.col("top").alias("to_top"), "dist"), "dst")
        down = down.groupBy("ancestor", F.col("top").alias("own_top"), F.col("to_top").alias("top")).agg(F.min(F.col("weight") + F.col("dist")).alias("weight"))
        # Below a node in its own tree the way through the tree is the shortest, and stands in inside.
        across = down.join(trees, "top").filter((F.col("own_top") != F.col("top")) | (F.col("ancestor") == F.col("node")) | ~F.array_contains("names", F.col("ancestor")))
        return inside.unionByName(across.select("ancestor", "node", (F.col("weight") + F.size("names") - 1).alias("distance")))

    def paths(self, separator: str = " > ") -> DataFrame:
        """A path to each node from every root that leads to it: root, node, n_links, path.

        It has the fewest links, as in routes, and is the alphabetically first of those.
        """
        trees = self._tree_paths()
        legs = self.steps.select("via", "dst").join(trees.select(F.col("node").alias("via"), F.col("top").alias("src"), F.col("names").alias("leg")), "via").select("src", "dst", "leg")
        before = _top_paths(self.scratch, self.roots, legs)
        whole = before.join(trees, "top").select("root", "node", F.concat("before", "names").alias("names"))
        return whole.select("root", "node", (F.size("names") - 1).alias("n_links"), F.array_join("names", separator).alias("path"))
