"""Dominators and what follows from them: frontiers, control dependence, loops, regions, reducibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.contraction import contract, meets
from graphloom.operators.lifting import is_ancestor, lift, shallow, spans, subtree_sizes, ways_up
from graphloom.operators.sequential import MAX_EDGES, adjacency, fits, immediate_dominators, in_one_task
from graphloom.operators.structural import UNLIMITED
from graphloom.operators.traversal import bfs
from graphloom.operators.trees import _shared, closure, root_paths
from graphloom.plans.tables import GrowingTable, drop_table, shuffled, write_table

VIRTUAL_EXIT = "__exit__"
#: Pairs, parallel ones too, up to which it is looked whether the distinct ones fit one task before the graph is made smaller.
MAX_DISTINCT = 4 * MAX_EDGES
#: Buckets of keys, and rows of one that a task groups at most.
BUCKETS, BUCKET_ROWS = 4096, 1 << 20


def dominator_tree(edges: DataFrame, entry: str, sequential: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """``id, parent``: the immediate dominator of each node that ``entry`` reaches, at any depth; null for the entry.

    With ``sequential`` (the default), a graph whose edges fit one task (checked) is walked there in almost linear time. Others are made smaller where that at least halves
    their edges (:func:`_inner`, :func:`_folded`), then numbered and
    contracted (see :mod:`graphloom.operators.contraction`): trees, chains and most flow graphs end in a few rounds, at any depth. What contraction leaves is walked in one task if it fits, else
    by rounds over the whole cluster (:func:`_by_rounds`). All ways give the same rows.
    """
    pairs = edges.where("src <> dst").select("src", "dst")
    # a table that is written is read again as it is
    return _tree_of(pairs if hasattr(edges, "_table_path") else write_table(pairs, "dom-edges"), entry, sequential, max_rounds)


def _alone(pairs: DataFrame, entry) -> DataFrame:
    kind = dict(pairs.dtypes)["src"]
    return pairs.sparkSession.createDataFrame([(entry, None)], f"id {kind}, parent {kind}")


def _tree_of(pairs: DataFrame, entry, sequential: bool, max_rounds: int) -> DataFrame:
    """:func:`dominator_tree` of ``pairs`` without self-loops; pairs may repeat."""
    n = pairs.count()
    if not n:
        return _alone(pairs, entry)
    if sequential and n <= MAX_DISTINCT and fits(distinct := write_table(pairs.distinct(), "dom-edges")):
        return _in_one_task(distinct, entry)
    inner = _inner(pairs)
    if inner.count() * 2 <= n:
        tree = write_table(_tree_of(inner, entry, sequential, max_rounds), "dom")
        if shallow(lift(tree)):
            # a leaf's dominator is where the ways of its sources meet
            leaves = meets(tree, pairs).join(shuffled(tree.select("id")), "id", "left_anti")
            return tree.unionByName(leaves)
        pairs = tree.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst")).unionByName(pairs.join(shuffled(tree.select(F.col("id").alias("dst"))), "dst", "left_anti").select("src", "dst"))
    else:
        drop_table(inner)
        folded = _folded(pairs, entry)
        if folded.count() * 2 <= n:
            return _tree_of(folded, entry, sequential, max_rounds)
        drop_table(folded)
    return _contracted(write_table(pairs.distinct(), "dom-edges"), entry, sequential, max_rounds)


def _inner(pairs: DataFrame) -> DataFrame:
    """``pairs`` but those into nodes without outgoing edges, which dominate nothing else."""
    sources = write_table(pairs.select(F.col("src").alias("dst")).distinct(), "dom-sources")
    return write_table(pairs.join(shuffled(sources), "dst", "left_semi").select("src", "dst"), "dom-edges")


def _folded(pairs: DataFrame, entry) -> DataFrame:
    """Fewer pairs with the same dominators: sources of a node that have one and the same single predecessor stand for that predecessor, as this is all that dominates them all."""
    pairs = pairs.where(F.col("dst") != F.lit(entry))
    single = pairs.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("up"), F.max("src").alias("other")).where("up = other").select("src", "up")
    own = pairs.join(shuffled(write_table(single, "dom-single")), "src", "left").withColumn("own", F.when(F.col("up").isNull(), F.col("src")))
    groups = own.groupBy("dst", "up", "own").agg(F.min("src").alias("lo"), F.max("src").alias("hi"))
    src = F.when(F.col("up").isNotNull() & (F.col("lo") != F.col("hi")), F.col("up")).otherwise(F.col("lo"))
    return write_table(groups.select(src.alias("src"), "dst").where("src <> dst"), "dom-edges")


def _contracted(pairs: DataFrame, entry, sequential: bool, max_rounds: int) -> DataFrame:
    """:func:`dominator_tree` of distinct ``pairs`` by contraction."""
    kind = dict(pairs.dtypes)["src"]
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).unionByName(pairs.sparkSession.createDataFrame([(entry,)], f"id {kind}"))
    ids = write_table(ends.distinct().withColumn("n", F.monotonically_increasing_id()), "dom-ids")
    at = ids.where(F.col("id") == entry).first()["n"]
    side = lambda c, n: shuffled(ids.select(F.col("id").alias(c), F.col("n").alias(n)))
    numbered = write_table(pairs.join(side("src", "s"), "src").join(side("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")), "dom-edges")
    drop_table(pairs)
    found, core = contract(numbered, at)
    if core is None:
        tree = found.unionByName(found.sparkSession.createDataFrame([(at, None)], "id long, parent long"))
    else:
        core = write_table(core, "dom-edges")
        tree = _in_one_task(core, at) if sequential and fits(core) else _by_rounds(core, at, max_rounds)
    own, up = (ids.select(F.col("n").alias(n), F.col("id").alias(c)) for n, c in (("id", "own"), ("parent", "up")))
    return tree.join(shuffled(own), "id").join(shuffled(up), "parent", "left").select(F.col("own").alias("id"), F.col("up").alias("parent"))


def _in_one_task(pairs: DataFrame, entry) -> DataFrame:
    """:func:`dominator_tree` of distinct ``pairs`` that fit one task."""
    kind = dict(pairs.dtypes)["src"]

    def walk(src, dst, ids):
        import pandas as pd

        place = {v: i for i, v in enumerate(ids)}
        if entry not in place:
            return
        found = immediate_dominators(adjacency(src, dst, len(ids)), adjacency(dst, src, len(ids)), place[entry])
        rows = [(ids[v], None if u == v else ids[u]) for v, u in enumerate(found) if u >= 0]
        for at in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[at : at + 100_000], columns=["id", "parent"], dtype=object)

    # an entry without edges is in no pair
    return in_one_task(pairs, walk, f"id {kind}, parent {kind}").unionByName(_alone(pairs, entry)).groupBy("id").agg(F.max("parent").alias("parent"))


def _by_rounds(pairs: DataFrame, entry, max_rounds: int) -> DataFrame:
    """:func:`dominator_tree` of distinct ``pairs`` by rounds over a tree that starts as the breadth-first tree.

    Each node's new parent is the deepest common ancestor of its predecessors, which is the common prefix of the least and the
    greatest of their root paths, so a round is one grouped min and max. Trees stay
    consistent, as root paths are built anew by pointer doubling. Ends when nothing moves.
    """
    kind = dict(pairs.dtypes)["src"]
    starts = pairs.sparkSession.createDataFrame([(entry, entry)], f"root {kind}, id {kind}")
    tree = write_table(bfs(pairs, starts, UNLIMITED).select("id", "parent"), "dom-tree")
    ids = tree.select("id")
    live = write_table(pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "dom-edges")
    drop_table(pairs)
    for _ in range(max_rounds):
        paths = root_paths(tree)
        met = live.join(paths.select(F.col("id").alias("src"), "path"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
        new = met.where(F.col("id") != entry).select("id", F.get("lo", _shared(F.col("lo"), F.col("hi")) - 1).alias("new"))
        moved = write_table(tree.join(new, "id", "left").select("id", F.coalesce("new", "parent").alias("parent"), F.col("parent").alias("old")), "dom-tree")
        done = moved.where("NOT parent <=> old").isEmpty()
        drop_table(paths)
        drop_table(tree)
        tree = moved.drop("old")
        tree._table_path = moved._table_path
        if done:
            return tree
    raise RuntimeError("dominators did not settle")


def dominators(edges: DataFrame, entry: str, sequential: bool = True) -> DataFrame:
    """``id, idom, path``: immediate dominators of what ``entry`` reaches, and all dominators in order; the entry's own is itself. See :func:`dominator_tree`."""
    tree = write_table(dominator_tree(edges, entry, sequential), "dom")
    return root_paths(tree).join(tree, "id").select("id", F.coalesce("parent", "id").alias("idom"), "path")


def post_dominators(edges: DataFrame, exit: str | None = None) -> DataFrame:
    """``id, idom, path`` on reversed edges from ``exit``, or from a virtual node after all nodes without outgoing edges, which the result leaves out (``idom`` is then null)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if exit is not None:
        return dominators(back, exit)
    ends = write_table(edges.select(F.col("dst").alias("id")).distinct().join(shuffled(edges.select(F.col("src").alias("id")).distinct()), "id", "left_anti"), "dom-ends")
    back = back.unionByName(ends.select(F.lit(VIRTUAL_EXIT).alias("src"), F.col("id").alias("dst")))
    found = dominators(back, VIRTUAL_EXIT)
    own = F.col("idom") != VIRTUAL_EXIT
    return found.where(F.col("id") != VIRTUAL_EXIT).select("id", F.when(own, F.col("idom")).alias("idom"), F.array_remove("path", VIRTUAL_EXIT).alias("path"))


def dominated_by(dom: DataFrame, node: str) -> DataFrame:
    return dom.where(F.array_contains("path", node)).select("id")


def dominates(dom: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, dominates`` for ``pairs`` (``a, b``)."""
    return pairs.join(dom.select(F.col("id").alias("b"), "path"), "b", "left").select("a", "b", F.coalesce(F.expr("array_contains(path, a)"), F.lit(False)).alias("dominates"))


def lowest_common_dominator(dom: DataFrame, nodes: list[str]) -> str | None:
    """The deepest node that dominates all of ``nodes``; None if one isn't reached."""
    row = dom.where(F.col("id").isin(*nodes)).agg(F.countDistinct("id"), F.min("path").alias("lo"), F.max("path").alias("hi")).select(
        F.col("count(DISTINCT id)").alias("n"), F.get("lo", _shared(F.col("lo"), F.col("hi")) - 1).alias("lcd")
    ).first()
    return row["lcd"] if row["n"] == len(set(nodes)) else None


def immediate(dom: DataFrame) -> DataFrame:
    """``id, parent`` of ``dom`` (``id, idom``), in which the entry's own dominator is itself or null."""
    return dom.select("id", F.when(F.col("idom") != F.col("id"), F.col("idom")).alias("parent"))


def _even(pairs: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` has many more of ``pairs`` than one task groups: counted by buckets, which are as many whatever the size."""
    sizes = pairs.groupBy(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return not sizes["all"] or sizes["most"] <= max(BUCKET_ROWS, 4 * sizes["all"] // BUCKETS)


def _between(dom: DataFrame, pairs: DataFrame, keys: DataFrame, key: str, node: str) -> DataFrame:
    """``key, id``: of each of ``pairs`` (``key, node``) whose key is in ``keys``, the dominators of ``node`` that don't strictly dominate ``key``.

    Shallow trees give each node's root path, so that pairs are shuffled once an end: by ``key`` last, as what lies there needs no further shuffle to be taken once, but first where one key has too many.
    """
    t = lift(immediate(dom))
    low = immediate(dom).join(shuffled(t.levels.withColumnRenamed("id", "parent")), "parent", "left").select(F.col("id").alias(key), (F.col("level") + 1).alias("low"))
    low = write_table(keys.join(shuffled(low), key, "left").select(key, F.coalesce("low", F.lit(0)).alias("low")), "dom-low")
    if not shallow(t):
        return ways_up(t, pairs.distinct().join(shuffled(low), key).select(key, F.col(node).alias("id"), "low"), key)
    sides = {node: root_paths(t.tree).withColumnRenamed("id", node), key: low}
    for end in (node, key) if _even(pairs, key) else (key, node):
        pairs = pairs.join(shuffled(sides[end]), end)
    return pairs.select(key, F.explode(F.expr("slice(path, int(low) + 1, size(path))")).alias("id")).distinct()


def dominance_frontier(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """``id, frontier``: where the dominance of ``id`` ends: it dominates a predecessor, but not strictly the node. Self-loops are skipped.

    ``dom`` needs ``id, idom`` alone: the nodes are those on the way from each predecessor up to the node's immediate dominator.
    """
    pairs = edges.where("src <> dst").select("src", "dst")
    return _between(dom, pairs, dom.select(F.col("id").alias("dst")), "dst", "src").select("id", F.col("dst").alias("frontier"))


def merge_points(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``id, degree``: nodes in some frontier, with their number of incoming edges (parallel ones too, self-loops not)."""
    n = edges.where("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return frontier.select(F.col("frontier").alias("id")).distinct().join(n, "id")


def control_dependence(edges: DataFrame, post: DataFrame) -> DataFrame:
    """``id, depends_on``: nodes whose execution a node of two or more outgoing edges decides: they post-dominate a successor, but not strictly the node."""
    branch = edges.groupBy("src").agg(F.count("*").alias("n")).where("n >= 2").select("src")
    return _between(post, edges.select("src", "dst"), branch, "src", "dst").select("id", F.col("src").alias("depends_on"))


def natural_loops(edges: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loops ``header, size, back_edges, parent, depth`` and their nodes ``header, id``.

    A back edge ends in a dominator of its source; a body is what reaches a back edge's source
    backwards without crossing the header, also from nodes that the entry doesn't reach. The parent is the smallest other loop whose body
    has the header (the least header of ties); depth counts from 1.
    """
    back = write_table(is_ancestor(lift(immediate(dom)), edges.select("src", "dst"), "dst", "src", "back").where("back").select(F.col("src").alias("tail"), F.col("dst").alias("header")), "loops-back")
    table = GrowingTable(back.select("header", F.col("header").alias("id")).unionByName(back.select("header", F.col("tail").alias("id"))).distinct(), "loops-body")
    frontier = table.read().where("id <> header")
    into = write_table(edges.select("src", F.col("dst").alias("id")).distinct(), "loops-edges")
    while not frontier.isEmpty():
        step = frontier.join(into, "id").select("header", F.col("src").alias("id")).distinct().join(table.read(), ["header", "id"], "left_anti")
        frontier = table.add(step)
    body = table.read()
    sizes = body.groupBy("header").agg(F.count("*").alias("size")).join(back.groupBy("header").agg(F.count("*").alias("back_edges")), "header")
    around = body.where("id <> header").select(F.col("id").alias("header"), F.col("header").alias("outer"))
    outer = around.join(sizes.select(F.col("header").alias("outer"), F.col("size").alias("outer_size")), "outer").join(sizes.select("header", F.col("size").alias("own")), "header").where("outer_size > own OR (outer_size = own AND outer < header)")
    nest = outer.groupBy("header").agg(F.min_by("outer", F.struct("outer_size", "outer")).alias("parent"))
    loops = write_table(sizes.join(nest, "header", "left"), "loops")
    depth = root_paths(loops.select(F.col("header").alias("id"), "parent")).select(F.col("id").alias("header"), F.size("path").alias("depth"))
    return loops.join(depth, "header"), body


def sese_regions(edges: DataFrame, dom: DataFrame, post: DataFrame, min_size: int = 1, max_size: int | None = None) -> DataFrame:
    """``entry, exit, size``: pairs of a node and its immediate post-dominator that it dominates, with the nodes between (dominated by the entry, post-dominated by the exit)."""
    ends = post.where("idom IS NOT NULL AND idom <> id").select(F.col("id").alias("entry"), F.col("idom").alias("exit"))
    ok = ends.join(dom.select(F.col("id").alias("exit"), "path"), "exit").where(F.expr("array_contains(path, entry)")).select("entry", "exit")
    down = closure(dom.select("id", "path")).select("id", F.col("ancestor").alias("entry"))
    up = closure(post.select("id", "path")).select("id", F.col("ancestor").alias("exit"))
    found = ok.join(down, "entry").join(up, ["id", "exit"]).groupBy("entry", "exit").agg(F.countDistinct("id").alias("size"))
    return found.where((F.col("size") >= min_size) & (F.col("size") <= max_size if max_size else F.lit(True)))


def edge_classes(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """``src, dst, class``: back if the target dominates the source, forward if the source dominates the target, else cross (also if an end isn't reached)."""
    t = lift(immediate(dom))
    pairs = edges.select("src", "dst")
    if shallow(t):
        side = lambda c, p: shuffled(spans(t).select(F.col("id").alias(c), F.col("lo").alias(f"{p}lo"), F.col("hi").alias(f"{p}hi")))
        joined = pairs.join(side("src", "s"), "src", "left").join(side("dst", "d"), "dst", "left")
        joined = joined.select("src", "dst", F.col("slo").between(F.col("dlo"), F.col("dhi")).alias("back"), F.col("dlo").between(F.col("slo"), F.col("shi")).alias("forward"))
    else:
        joined = is_ancestor(t, is_ancestor(t, pairs, "dst", "src", "back"), "src", "dst", "forward")
    return joined.select("src", "dst", F.when(F.col("back"), "back").when(F.col("forward"), "forward").otherwise("cross").alias("class"))


def reducibility(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """``is_reducible, back_edges, forward_edges, cross_edges, irreducible_nodes, score``.

    A graph is reducible if, without its back edges, what the entry reaches has no cycle; nodes that stay after
    peeling off those without incoming or outgoing edges are irreducible. The score is the share of the other nodes, to four places.
    """
    classes = write_table(edge_classes(edges, dom), "reducibility")
    ids = dom.select("id")
    # what leads nowhere goes first, which often leaves few edges to look at
    on = classes.where("class <> 'back'").select("src", "dst")
    left = on.join(shuffled(on.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst").distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    left = write_table(left, "reducibility")
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = write_table(kept.select("src", "dst"), "reducibility")
        m = kept.count()
        left = kept
        if m == n:
            break
        n = m
    stuck = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().count()
    total = max(ids.count(), 1)
    counts = classes.agg(*(F.count_if(F.col("class") == c).alias(f"{c}_edges") for c in ("back", "forward", "cross")))
    return counts.select(
        F.lit(stuck == 0).alias("is_reducible"), "back_edges", "forward_edges", "cross_edges", F.lit(stuck).cast("long").alias("irreducible_nodes"), F.lit(round(1 - stuck / total, 4)).alias("score")
    )


def critical_path(dom: DataFrame, target: str) -> DataFrame:
    """``at, id``: the dominators of ``target`` from the entry on: every way to it passes them."""
    return dom.where(F.col("id") == target).select(F.posexplode("path").alias("at", "id"))


def weighted_criticality(dom: DataFrame, ranks: DataFrame) -> DataFrame:
    """``id, dominated, dominance, centrality, criticality, quadrant, risk``.

    Dominance and centrality are the sizes of dominated subtrees and the ranks, scaled to 0..1
    (1 for a single node, .5 if all are equal); criticality is their product, quadrants are cut at .5, risk at .7, .4 and .2.
    """
    sub = subtree_sizes(lift(immediate(dom))).select("id", (F.col("size") - 1).alias("dominated"))
    both = sub.join(ranks.select("id", "rank"), "id", "left").na.fill(0.0, ["rank"])
    span = both.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("dominated", "rank") for f in (F.min, F.max)))
    scaled = lambda c: F.when(F.col("n") == 1, 1.0).when(F.col(f"max_{c}") == F.col(f"min_{c}"), 0.5).otherwise((F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}")))
    d, c = F.col("dominance"), F.col("centrality")
    quadrant = F.when((d >= 0.5) & (c >= 0.5), "critical").when(d >= 0.5, "gatekeeper").when(c >= 0.5, "hub").otherwise("leaf")
    k = F.col("criticality")
    return (
        both.crossJoin(F.broadcast(span)).select("id", "dominated", scaled("dominated").alias("dominance"), scaled("rank").alias("centrality"))
        .withColumn("criticality", d * c).withColumn("quadrant", quadrant)
        .withColumn("risk", F.when(k >= 0.7, "critical").when(k >= 0.4, "high").when(k >= 0.2, "medium").otherwise("low"))
    )
