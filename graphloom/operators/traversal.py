"""Breadth-first traversals as frontier loops over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sequential import adjacency, breadth_first, fits, in_one_task
from graphloom.operators.structural import UNLIMITED, clamp_depth
from graphloom.plans.tables import GrowingTable, write_table


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False, both: bool = False, until: str | None = None) -> DataFrame:
    """``root, id, depth, parent``: what each ``root`` of ``starts`` (``root, id``) reaches in at most ``max_depth`` steps (UNLIMITED: in any number).

    Each node is listed once a root, at its least depth, with the least
    parent of the level before; starts have depth 0 and a null parent. Edges of any
    number lead to a node once. A level is one join and one aggregation over the frontier
    alone, added to one table, so a lost executor costs one level and plans don't
    grow. With ``until``, the loop ends when that node is found.
    """
    pairs = edges.select("src", "dst")
    if reverse or both:
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = pairs.unionByName(turned) if both else turned
    first = starts.select("root", "id").distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast(dict(starts.dtypes)["id"])})
    table = GrowingTable(first, "bfs")
    frontier = table.read()
    depth, most = 0, clamp_depth(max_depth)
    while depth < most:
        depth += 1
        step = (
            frontier.select("root", F.col("id").alias("src"))
            .join(pairs, "src")
            .groupBy("root", F.col("dst").alias("id"))
            .agg(F.min("src").alias("parent"))
            .join(table.read().select("root", "id"), ["root", "id"], "left_anti")
            .select("root", "id", F.lit(depth).alias("depth"), "parent")
        )
        frontier = table.add(step)
        if frontier.isEmpty():
            break
        if until is not None and not frontier.where(F.col("id") == until).isEmpty():
            break
    return table.read()


def one_start(edges: DataFrame, id: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(id, id)], "root string, id string")


def known(nodes: DataFrame, *ids: str) -> None:
    """Raise KeyError unless all ``ids`` are nodes."""
    found = {r[0] for r in nodes.where(F.col("id").isin(*ids)).select("id").distinct().collect()}
    if missing := [i for i in ids if i not in found]:
        raise KeyError(f"no such node: {', '.join(missing)}")


def call_graph(g, id: str, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """``id, depth, parent`` of what ``id`` calls (or, in reverse, what calls it); each row but the start is a tree edge. An unknown id raises KeyError."""
    known(g.nodes, id)
    return bfs(g.of_type("calls"), one_start(g.edges, id), max_depth, reverse).drop("root")


def file_dependencies(g, file_path: str, max_depth: int | None = None) -> DataFrame:
    """``id, depth, parent`` over imports, from all nodes of a file."""
    starts = g.nodes.where(F.col("file_path") == file_path).select(F.col("file_path").alias("root"), "id")
    return bfs(g.of_type("imports"), starts, max_depth).drop("root")


def type_hierarchy(g, id: str, max_depth: int | None = None) -> DataFrame:
    """``id, depth, parent`` over implements and embeds, both ways. An unknown id raises KeyError."""
    known(g.nodes, id)
    return bfs(g.of_type("implements", "embeds"), one_start(g.edges, id), max_depth, both=True).drop("root")


def way_up(tree: DataFrame, id, length: int) -> DataFrame:
    """``id`` of a node and all its ancestors in ``tree`` (``id, parent``), of which there are ``length``: by jumps of powers of two, so that the jobs are as many as the length has binary digits."""
    jump = tree.where("parent IS NOT NULL").select("id", F.col("parent").alias("up"))
    jumps = [write_table(jump, "way")]
    for _ in range(max(0, length.bit_length() - 1)):
        last = jumps[-1]
        jumps.append(write_table(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "way"))
    found = tree.where(F.col("id") == id).select("id")
    for jump in reversed(jumps):
        found = found.join(jump, "id", "left").select(F.explode(F.array_compact(F.array("id", "up"))).alias("id"))
    return found.distinct()


def shortest_path(g, src: str, dst: str, max_depth: int = UNLIMITED, sequential: bool = True) -> tuple[int, list[str]]:
    """Length and nodes of a shortest directed path over all edge types; (-1, []) if there is none. Unknown ids raise KeyError.

    Of the paths of least length, that of the least parents from ``dst`` on. Level by level; with ``sequential`` (the default), a graph that fits one task (checked) is walked there, as deep ones take a job a level.
    """
    known(g.nodes, src, dst)
    if src == dst:
        return 0, [src]
    pairs = g.edges.select("src", "dst").distinct()
    if sequential and fits(pairs):

        def walk(a, b, ids):
            import pandas as pd

            place = {v: i for i, v in enumerate(ids)}
            if src not in place or dst not in place:
                return
            depth, parent = breadth_first(adjacency(a, b, len(ids)), place[src])
            if 0 <= depth[place[dst]] <= clamp_depth(max_depth):
                way = [place[dst]]
                while way[-1] != place[src]:
                    way.append(parent[way[-1]])
                yield pd.DataFrame({"at": range(len(way)), "id": [ids[i] for i in reversed(way)]})

        path = [r["id"] for r in in_one_task(pairs, walk, f"at long, id {dict(g.edges.dtypes)['src']}").orderBy("at").collect()]
        return (len(path) - 1, path) if path else (-1, [])
    seen = bfs(g.edges, one_start(g.edges, src), max_depth, until=dst)
    seen = write_table(seen.select("id", "parent", "depth"), "seen")
    last = seen.where(F.col("id") == dst).first()
    if last is None:
        return -1, []
    # as many rows as the path is long
    path = [r["id"] for r in way_up(seen, dst, last["depth"]).join(seen, "id").orderBy("depth").select("id").collect()]
    return len(path) - 1, path


def distances(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``src, dst, length`` for ``pairs`` (``src, dst``); -1 if ``dst`` isn't reached."""
    starts = pairs.select(F.col("src").alias("root"), F.col("src").alias("id")).distinct()
    seen = bfs(edges, starts, max_depth)
    return pairs.join(seen.select(F.col("root").alias("src"), F.col("id").alias("dst"), "depth"), ["src", "dst"], "left").select(
        "src", "dst", F.coalesce("depth", F.lit(-1)).cast("long").alias("length")
    )


def call_chain(g, id: str, max_depth: int | None = None) -> DataFrame:
    """``id, depth, chain``: the names of nodes from ``id`` to each node that it calls, along tree edges."""
    tree = call_graph(g, id, max_depth)
    chains = tree.where("depth = 0").select("id", "depth", F.array("id").alias("chain"))
    level = chains
    for d in range(1, int(tree.agg(F.max("depth")).first()[0] or 0) + 1):
        level = (
            tree.where(F.col("depth") == d)
            .join(level.select(F.col("id").alias("parent"), "chain"), "parent")
            .select("id", "depth", F.concat("chain", F.array("id")).alias("chain"))
        )
        chains = chains.unionByName(level)
    return chains
