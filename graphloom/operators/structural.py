"""Lookups, neighbour queries and package hierarchies over ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.graphs import CodeGraph

#: Limits of results and depths of user queries, and the greatest that they may ask for. UNLIMITED asks for everything.
DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000
DEFAULT_DEPTH, MAX_DEPTH = 10, 100
UNLIMITED = -(1 << 31)


def clamp_limit(limit: int | None) -> int:
    """The default for none or a limit below 1, and never more than the maximum; UNLIMITED has none."""
    if limit == UNLIMITED:
        return 1 << 62
    return DEFAULT_LIMIT if limit is None or limit <= 0 else min(limit, MAX_LIMIT)


def clamp_depth(depth: int | None) -> int:
    """The default for none or a negative depth, and never more than the maximum; 0 is a depth of its own, UNLIMITED has no bound."""
    if depth == UNLIMITED:
        return 1 << 62
    return DEFAULT_DEPTH if depth is None or depth < 0 else min(depth, MAX_DEPTH)


def in_package(package: Column, wanted: str) -> Column:
    """Whether a package is ``wanted`` or below it, cut at path boundaries; everything if ``wanted`` is empty."""
    if not wanted:
        return F.lit(True)
    edge = F.concat(F.lit("/"), package, F.lit("/"))
    return edge.contains(f"/{wanted.strip('/')}/")


def by_id(g: CodeGraph, id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == id)


def by_name(g: CodeGraph, name: str) -> DataFrame:
    return g.nodes.where(F.col("name") == name)


def by_kind(g: CodeGraph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind)


def edges_of_file(g: CodeGraph, file_path: str) -> DataFrame:
    return g.edges.where(F.col("file_path") == file_path)


def _first(found: DataFrame, order: list, limit: int | None) -> DataFrame:
    """The first rows of each ``dst`` in ``order``, and whether there were more (``truncated``)."""
    most = clamp_limit(limit)
    if limit == UNLIMITED:
        return found.withColumn("truncated", F.lit(False))
    ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where(F.col("rn") <= most + 1)
    more = F.max("rn").over(Window.partitionBy("dst")) > most
    return ranked.withColumn("truncated", more).where(F.col("rn") <= most).drop("rn")


def callers(g: CodeGraph, targets: DataFrame, limit: int | None = UNLIMITED) -> DataFrame:
    """``target, caller``: the source of each incoming call of ``targets`` (``id``), as often as it calls; with a limit, at most so many a target, in order of source and line, and ``truncated``.

    A target without callers, or that isn't in the graph, has no rows.
    """
    found = _first(g.of_type("calls").join(targets.select(F.col("id").alias("dst")), "dst"), ["src", "line"], limit)
    return found.select(F.col("dst").alias("target"), F.col("src").alias("caller"), *([] if limit == UNLIMITED else ["truncated"]))


def callees(g: CodeGraph, sources: DataFrame) -> DataFrame:
    """``source, callee``: distinct targets of outgoing calls."""
    return g.of_type("calls").join(sources.select(F.col("id").alias("src")), "src").select(F.col("src").alias("source"), F.col("dst").alias("callee")).distinct()


def callers_by_name(g: CodeGraph, name: str) -> DataFrame:
    return callers(g, by_name(g, name).select("id"))


def callers_with_inheritance(g: CodeGraph, target: str, parent_methods: DataFrame) -> DataFrame:
    """``caller, via``: callers of ``target`` and of the methods that it overrides (``id, distance``); a caller belongs to the nearest it calls."""
    own = g.nodes.sparkSession.createDataFrame([(target, 0)], "id string, distance int").unionByName(parent_methods.select("id", F.col("distance").cast("int")))
    return (
        g.of_type("calls").join(own, F.col("dst") == F.col("id"))
        .groupBy(F.col("src").alias("caller"))
        .agg(F.min_by("id", F.struct("distance", "id")).alias("via"))
    )


def implementations(g: CodeGraph, targets: DataFrame) -> DataFrame:
    """``target, implementation``: distinct sources of incoming implements and embeds edges."""
    return g.of_type("implements", "embeds").join(targets.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("target"), F.col("src").alias("implementation")).distinct()


def references(g: CodeGraph, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """``target, src, etype, file_path, line, truncated`` of incoming edges, references and implements first; at most ``limit`` a target (UNLIMITED: all), ``truncated`` where there are more."""
    found = g.edges.join(targets.select(F.col("id").alias("dst")), "dst").withColumn("late", (~F.col("etype").isin("references", "implements")).cast("int"))
    return _first(found, ["late", "src", "etype", "file_path", "line"], limit).select(F.col("dst").alias("target"), "src", "etype", "file_path", "line", "truncated")


def importers(g: CodeGraph, package: str) -> DataFrame:
    """Distinct files of nodes that import a node of ``package``."""
    into = g.nodes.where(F.col("package") == package).select(F.col("id").alias("dst"))
    return g.of_type("imports").join(into, "dst").join(g.nodes.select(F.col("id").alias("src"), F.col("file_path").alias("importer")), "src").select("importer").distinct()


def with_packages(g: CodeGraph) -> DataFrame:
    """Edges with the packages of both ends."""
    p = g.nodes.select("id", "package")
    return (
        g.edges.join(p.withColumnsRenamed({"id": "src", "package": "src_package"}), "src")
        .join(p.withColumnsRenamed({"id": "dst", "package": "dst_package"}), "dst")
    )


def package_dependencies(g: CodeGraph) -> DataFrame:
    """``src_package, dst_package, edges`` over cross-package edges: read one way it is what a package needs, the other way what needs it."""
    return with_packages(g).where("src_package <> dst_package").groupBy("src_package", "dst_package").agg(F.count("*").alias("edges"))


def edge_partition(g: CodeGraph) -> DataFrame:
    """``crossing, etype, edges``: edges within and across packages."""
    return with_packages(g).groupBy((F.col("src_package") != F.col("dst_package")).alias("crossing"), "etype").agg(F.count("*").alias("edges"))


def siblings(g: CodeGraph, id: str) -> DataFrame:
    """Nodes of the same file and kind as ``id``, without it."""
    own = by_id(g, id).select(F.col("file_path").alias("f"), F.col("kind").alias("k"))
    return g.nodes.join(own, (F.col("file_path") == F.col("f")) & (F.col("kind") == F.col("k"))).where(F.col("id") != id).drop("f", "k")


def roll_up(g: CodeGraph) -> DataFrame:
    """``package, file_path, symbols`` with sums for packages and the whole project (null)."""
    return g.nodes.rollup("package", "file_path").agg(F.count("*").alias("symbols"))


def drill_down(g: CodeGraph, package: str | None = None, file_path: str | None = None) -> DataFrame:
    """One level down: packages, files of a package, or symbols of a file."""
    if file_path is not None:
        return g.nodes.where(F.col("file_path") == file_path).select(F.lit("symbol").alias("level"), "id", F.lit(1).cast("long").alias("symbols"))
    if package is not None:
        return g.nodes.where(F.col("package") == package).groupBy(F.col("file_path").alias("id")).agg(F.count("*").alias("symbols")).select(F.lit("file").alias("level"), "id", "symbols")
    return g.nodes.groupBy(F.col("package").alias("id")).agg(F.count("*").alias("symbols")).select(F.lit("package").alias("level"), "id", "symbols")


def graph_stats(g: CodeGraph) -> DataFrame:
    """``what, value, n``: nodes by kind, edges by type, and totals."""
    n = g.nodes.groupBy(F.lit("kind").alias("what"), F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    e = g.edges.groupBy(F.lit("etype").alias("what"), F.col("etype").alias("value")).agg(F.count("*").alias("n"))
    return n.unionByName(e).unionByName(g.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("value"), "n")).unionByName(
        g.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("value"), "n")
    )


def dangling_edges(g: CodeGraph) -> DataFrame:
    """Edges with an end that is no node. Edges are shuffled once an end, and stream past hashed nodes, so none are sorted."""
    at = lambda c: g.nodes.select(F.col("id").alias(c)).distinct().withColumn(f"_{c}", F.lit(True)).hint("shuffle_hash")
    marked = g.edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return marked.where("_src IS NULL OR _dst IS NULL").select(*g.edges.columns)


def external_dependencies(g: CodeGraph, reached: DataFrame) -> DataFrame:
    """``id, package, depth, first_caller`` of external nodes next to ``reached`` (``id, depth``); the package is what comes before the last dot of the name."""
    ext = g.nodes.where("kind = 'external'").select(F.col("id").alias("dst"), "name")
    hit = g.edges.join(ext, "dst").join(reached.select(F.col("id").alias("src"), "depth"), "src")
    first = hit.groupBy("dst", "name").agg(F.min(F.struct((F.col("depth") + 1).alias("depth"), "src")).alias("m"))
    package = F.when(F.col("name").contains("."), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)).otherwise("")
    return first.select(F.col("dst").alias("id"), package.alias("package"), F.col("m.depth").alias("depth"), F.col("m.src").alias("first_caller"))


def package_overview(g: CodeGraph) -> DataFrame:
    """``package, symbols, exported, files, depends_on, dependents``: one row per package."""
    dep = package_dependencies(g)
    out = dep.groupBy(F.col("src_package").alias("package")).agg(F.count("*").alias("depends_on"))
    into = dep.groupBy(F.col("dst_package").alias("package")).agg(F.count("*").alias("dependents"))
    own = g.nodes.groupBy("package").agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"), F.countDistinct("file_path").alias("files"))
    return own.join(out, "package", "left").join(into, "package", "left").na.fill(0, ["depends_on", "dependents"])


# --- immutable edits ---------------------------------------------------------


def remove_file(g: CodeGraph, file_path: str) -> CodeGraph:
    """The graph without a file's nodes and without edges that touch them."""
    gone = g.nodes.where(F.col("file_path") == file_path).select(F.col("id").alias("gone"))
    edges = g.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return CodeGraph(g.nodes.where(F.coalesce(F.col("file_path"), F.lit("")) != file_path), edges)


def merge_graph(g: CodeGraph, new: CodeGraph) -> CodeGraph:
    """``g`` with the nodes of ``new``, which replace nodes of the same id, and with its edges."""
    kept = g.nodes.join(new.nodes.select(F.col("id").alias("fresh")), F.col("id") == F.col("fresh"), "left_anti")
    return CodeGraph(kept.unionByName(new.nodes), g.edges.unionByName(new.edges))
