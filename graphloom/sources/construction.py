"""From parsed files to a graph: symbol collection, reference resolution as joins, and typed edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.code import satisfied_interfaces
from graphloom.operators.trees import root_paths
from graphloom.plans.tables import write_table
from graphloom.sources import parsers
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph

CALLABLE = ("function", "method")
MAX_CALLS, MAX_EMBED_DEPTH = 1000, 20


def nodes_of(symbols: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Node rows of symbols, and of ``external`` ids."""
    n = symbols.select(*NODE_COLUMNS).dropDuplicates(["id"])
    if external is None:
        return n
    name = F.regexp_extract("id", r"^external:(.*)$", 1)
    e = external.select("id").distinct().select(
        "id", name.alias("name"), F.lit("external").alias("kind"), F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("").alias("package"),
        F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(True).alias("exported"), F.lit("").alias("language"),
    )
    return n.unionByName(e)


def _edges(df: DataFrame, etype: str) -> DataFrame:
    return df.select("src", "dst", F.lit(etype).alias("etype"), "file_path", F.col("line").cast("int").alias("line"))


def resolve_names(wanted: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``wanted`` (``key, file_path, name``) with ``dst``: the symbol of that name, of the same file if there is one, else the first by id."""
    s = symbols if kinds is None else symbols.where(F.col("kind").isin(*kinds))
    c = s.select(F.col("id").alias("dst"), "name", F.col("file_path").alias("at"))
    best = wanted.join(c, "name").groupBy("key").agg(F.min_by("dst", F.struct((F.col("at") != F.col("file_path")).cast("int"), "dst")).alias("dst"))
    return wanted.join(best, "key")


def inheritance(symbols: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``src, dst, etype, file_path, line``: implements edges to interfaces, embeds edges to structs and classes, for each named base (of the symbols ``own``, if given)."""
    bases = (symbols if own is None else own).select(F.col("id").alias("src"), "file_path", F.col("start_line").alias("line"), F.col("kind").alias("own"), F.explode("bases").alias("base"))
    w = bases.select("src", "file_path", "line", "own", F.element_at(F.split("base", r"\."), -1).alias("name")).withColumn("key", F.struct("src", "name"))
    r = resolve_names(w, symbols, ("class", "struct", "interface", "type")).where("src <> dst").join(symbols.select(F.col("id").alias("dst"), F.col("kind").alias("target")), "dst")
    implements = (F.col("target") == "interface") & (F.col("own") != "interface")
    return r.select("src", "dst", F.when(implements, "implements").otherwise("embeds").alias("etype"), "file_path", "line").distinct()


def method_sets(symbols: DataFrame) -> DataFrame:
    """``type, language, method``: methods by receiver name and package, with those of embedded types, to a depth of MAX_EMBED_DEPTH."""
    types = symbols.where("kind IN ('struct', 'class', 'interface', 'type')").select(F.col("id").alias("type"), "name", "package", "language", "bases", "kind")
    own = symbols.where("kind = 'method' AND receiver IS NOT NULL").select(F.col("name").alias("method"), F.col("receiver").alias("name"), "package", "language")
    direct = write_table(types.join(own, ["name", "package", "language"]).select("type", "language", "method").distinct(), "methods")
    up = types.select("type", "language", F.explode("bases").alias("name")).join(types.select(F.col("type").alias("base"), "name", "language"), ["name", "language"]).select("type", "base").distinct()
    up = write_table(up, "embeds")
    every = direct
    for _ in range(MAX_EMBED_DEPTH):
        got = up.join(every.withColumnRenamed("type", "base"), "base").select("type", "language", "method").distinct().join(every, ["type", "language", "method"], "left_anti")
        got = write_table(got, "methods")
        if got.isEmpty():
            break
        every = every.unionByName(got)
    return every


def implicit_implementations(symbols: DataFrame) -> DataFrame:
    """Implements edges from structs, classes and types to interfaces of the language all of whose methods they have; empty interfaces are left out."""
    m = write_table(method_sets(symbols), "methods")
    kinds = symbols.select(F.col("id").alias("type"), "kind")
    t = m.join(kinds, "type").where("kind <> 'interface'").select("type", "language", "method")
    i = m.join(kinds, "type").where("kind = 'interface'").select(F.col("type").alias("interface"), "language", "method")
    at = symbols.select(F.col("id").alias("type"), "file_path", F.col("start_line").alias("line"))
    return _edges(satisfied_interfaces(t, i).join(at, "type").select(F.col("type").alias("src"), F.col("interface").alias("dst"), "file_path", "line"), "implements")


def resolve_calls(symbols: DataFrame, imports: DataFrame, calls: DataFrame, max_calls: int | None = MAX_CALLS) -> DataFrame:
    """``src, dst, etype, file_path, line``: one edge for each call site, to a symbol or a placeholder ``external:<name>``.

    Candidates are ranked: methods of the caller's own type for this, self and super; for a receiver, methods of a type or functions of a file or package of that name (without regard to case);
    for a bare name, the same file, then names that the file imports, then the whole project. A method whose receiver fits nothing is
    taken only if the project has one of its name (any, for Go). Functions and methods go before others, then the least id.
    A call that resolves to its own caller leaves no edge. Aliases of imports stand for what they import. The first ``max_calls`` call sites of a caller count (None: all).
    """
    s = symbols.where("kind NOT IN ('field', 'key')").select(
        F.col("id").alias("dst"), F.col("name").alias("target"), F.col("file_path").alias("c_file"), F.col("package").alias("c_package"), F.col("kind").alias("c_kind"), F.col("receiver").alias("c_owner"), F.col("language").alias("c_language")
    )
    owner = symbols.select(F.col("id").alias("caller_id"), F.col("receiver").alias("own"), F.col("language").alias("language"))
    bases = symbols.where(F.size("bases") > 0).groupBy(F.col("name").alias("own")).agg(F.min_by("bases", "id").alias("own_bases"))
    w = Window.partitionBy("caller_id").orderBy("line", "target", "receiver")
    c = calls.withColumn("nth", F.row_number().over(w))
    if max_calls is not None:
        c = c.where(F.col("nth") <= max_calls)
    # names that an import renames: a function by its own name, a module by the end of its path
    renamed = imports.where("alias IS NOT NULL").groupBy("file_path", "alias").agg(F.min(F.when(F.size("names") == 1, F.get("names", F.lit(0)))).alias("real"), F.min("path").alias("module"))
    renamed = renamed.select("file_path", "alias", "real", F.regexp_extract(F.regexp_replace("module", r"\.\w{1,4}$", ""), r"([^/.]*)/?$", 1).alias("module"))
    c = c.join(renamed.select("file_path", F.col("alias").alias("target"), "real"), ["file_path", "target"], "left")
    c = c.withColumn("target", F.when(F.col("receiver").isNull(), F.coalesce("real", "target")).otherwise(F.col("target"))).drop("real")
    c = c.join(renamed.where("real IS NULL").select("file_path", F.col("alias").alias("receiver"), "module"), ["file_path", "receiver"], "left")
    c = c.withColumn("receiver", F.coalesce("module", "receiver")).drop("module")
    c = write_table(c.join(owner, "caller_id").join(bases, "own", "left").withColumn("last", F.element_at(F.split("receiver", r"\."), -1)), "calls")
    named = imports.where(F.size("names") > 0).select("file_path", F.explode("names").alias("target"), F.lit(True).alias("imported")).distinct()
    alone = s.where("c_kind IN ('method', 'property')").groupBy("target").agg(F.count("*").alias("n_methods"))
    j = c.join(s, "target").join(named, ["file_path", "target"], "left").join(alone, "target", "left")
    low = F.lower("last")
    mine = F.col("last").isin("this", "self", "cls")
    base_names = F.transform(F.coalesce("own_bases", F.array()), lambda b: F.element_at(F.split(b, r"\."), -1))
    stem = F.regexp_extract("c_file", r"([^/]*?)(\.[^/.]*)?$", 1)
    rank = (
        F.when(F.col("last").isNull() & (F.col("dst") == F.col("caller_id")), 9)
        .when(mine & (F.col("c_owner") == F.col("own")), 0)
        .when((F.col("last") == "super") | F.col("last").startswith("super("), F.when(F.array_contains(base_names, F.col("c_owner")), 0))
        .when(F.col("last").isNotNull() & (low == F.lower("c_owner")), F.when(F.col("file_path") == F.col("c_file"), 1).otherwise(2))
        .when(F.col("last").isNotNull() & F.col("c_owner").isNull() & ((low == F.lower(F.element_at(F.split("c_package", "/"), -1))) | (low == F.lower(stem))), 3)
        .when(F.col("last").isNotNull() & (F.col("c_kind") == "method") & ~mine & ((F.col("c_language") == "go") | (F.col("n_methods") == 1)), 6)
        .when(F.col("last").isNull() & F.col("target").rlike("^__.*__$") & (F.col("language") != "go"), None)
        .when(F.col("last").isNull() & (F.col("file_path") == F.col("c_file")) & F.col("c_owner").isNull(), 1)
        .when(F.col("last").isNull() & F.col("imported"), 2)
        .when(F.col("last").isNull() & F.col("c_owner").isNull(), 4)
    )
    ranked = j.withColumn("rank", rank).where("rank IS NOT NULL")
    best = ranked.groupBy("caller_id", "nth").agg(F.min_by("dst", F.struct("rank", (~F.col("c_kind").isin(*CALLABLE)).cast("int"), "dst")).alias("dst"))
    outside = F.concat(F.lit("external:"), F.when(F.col("receiver").isNotNull(), F.concat("receiver", F.lit("."), "target")).otherwise(F.col("target")))
    out = c.join(best, ["caller_id", "nth"], "left").withColumn("dst", F.coalesce("dst", outside)).withColumnRenamed("caller_id", "src")
    return _edges(out.where("src <> dst"), "calls")


def import_path() -> Column:
    """The path that an import's ``path`` asks for, without leading dots and known endings, with slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^(\.{1,2}/)+|^\.+", ""), r"\.(js|ts|tsx|jsx|css|html|sh)$", ""), r"(?<=\w)\.(?=\w)", "/")


def import_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports edges from a file's node to the files that a path names, by full path or by its end, else to a placeholder."""
    files = symbols.select("file_path").distinct().withColumn("stem", F.regexp_replace("file_path", r"(/__init__)?\.[^/.]*$", ""))
    w = imports.withColumn("wanted", import_path()).withColumn("tail", F.element_at(F.split("wanted", "/"), -1))
    t = files.select(F.col("file_path").alias("dst_file"), "stem", F.element_at(F.split("stem", "/"), -1).alias("tail"))
    hit = w.join(t, "tail").where("stem = wanted OR endswith(stem, concat('/', wanted))").where("dst_file <> file_path")
    best = hit.groupBy("file_path", "path").agg(F.min_by("dst_file", F.struct(F.length("stem"), "dst_file")).alias("dst_file"))
    dst = F.coalesce(F.concat(F.lit("file:"), F.col("dst_file")), F.concat(F.lit("external:"), F.col("path")))
    return _edges(imports.select("file_path", "path").distinct().join(best, ["file_path", "path"], "left").select(F.concat(F.lit("file:"), F.col("file_path")).alias("src"), dst.alias("dst"), "file_path", F.lit(1).alias("line")), "imports")


def type_edges(symbols: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Receives edges from methods (of the symbols ``own``, if given) to their receiver's type, and returns edges to the types that results name."""
    kinds = ("class", "struct", "interface", "type")
    m = (symbols if own is None else own).where(F.col("kind").isin(*CALLABLE))
    r = m.where("receiver IS NOT NULL").select(F.col("id").alias("src"), "file_path", F.col("start_line").alias("line"), F.col("receiver").alias("name")).withColumn("key", F.col("src"))
    v = m.where("returns IS NOT NULL").select(F.col("id").alias("src"), "file_path", F.col("start_line").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("returns", F.lit(r"[A-Za-z_]\w*"), 0))).alias("name")).withColumn("key", F.struct("src", "name"))
    return _edges(resolve_names(r, symbols, kinds), "receives").unionByName(_edges(resolve_names(v, symbols, kinds), "returns")).where("src <> dst")


def reference_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References edges of :func:`graphloom.sources.parsers.references`: at their own lines, one for a name and line. A type that the project doesn't have leaves none; a decorator's argument with a capital becomes a placeholder."""
    kinds = ("class", "struct", "interface", "type")
    w = refs.select("src", "file_path", "line", "name", "why").distinct().withColumn("key", F.struct("src", "name", "line", "why"))
    types = resolve_names(w.where("why <> 'decorator'"), symbols, kinds)
    args = w.where("why = 'decorator'")
    found = resolve_names(args, symbols)
    outside = args.join(found.select("key"), "key", "left_anti").where(F.col("name").rlike("^[A-Z]")).withColumn("dst", F.concat(F.lit("external:"), F.col("name")))
    every = types.select("src", "dst", "file_path", "line").unionByName(found.select("src", "dst", "file_path", "line")).unionByName(outside.select("src", "dst", "file_path", "line"))
    return _edges(every.where("src <> dst").distinct(), "references")


def defines_edges(symbols: DataFrame) -> DataFrame:
    return _edges(symbols.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), "file_path", F.col("start_line").alias("line")), "defines")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends fit their type: calls from what can be called, implements to interfaces, embeds from types. An end without a node passes."""
    k = nodes.select("id", "kind")
    e = edges.join(k.withColumnsRenamed({"id": "src", "kind": "sk"}), "src", "left").join(k.withColumnsRenamed({"id": "dst", "kind": "dk"}), "dst", "left")
    ok = (
        F.when(F.col("etype") == "calls", F.coalesce(F.col("sk").isin("function", "method", "external"), F.lit(True)) & F.coalesce(~F.col("dk").isin("package", "file", "import"), F.lit(True)))
        .when(F.col("etype") == "implements", F.coalesce(F.col("dk").isin("interface", "external"), F.lit(True)))
        .when(F.col("etype") == "embeds", F.coalesce(F.col("sk").isin("struct", "class", "interface", "type"), F.lit(True)))
        .otherwise(True)
    )
    return e.where(ok).select(*EDGE_COLUMNS)


@dataclass(frozen=True)
class Project:
    """What parsers found in a project's files, and the edges it resolves to, before those that don't fit are left out: what :func:`refresh` starts from."""

    files: DataFrame  # file_path
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    references: DataFrame
    edges: DataFrame  # with origin: the step that made an edge


def _parsed(files: DataFrame) -> dict[str, DataFrame]:
    found = parsers.symbols(files)
    bad = parsers.invalid_symbols(found).select("id")
    return {
        "files": files.select("file_path").distinct(), "symbols": write_table(write_table(found, "symbols").join(bad, "id", "left_anti"), "symbols"), "imports": write_table(parsers.imports(files), "imports"),
        "calls": write_table(parsers.call_sites(files), "call-sites"), "references": write_table(parsers.references(files), "references"),
    }


def _resolved(parsed: dict[str, DataFrame], max_calls: int | None, only: DataFrame | None = None) -> DataFrame:
    """The edges of all sources, or of those in ``only`` (``id``) and all implicit implementations."""
    symbols, few = parsed["symbols"], lambda d, c: d if only is None else d.join(only.withColumnRenamed("id", c), c, "left_semi")
    own = few(symbols, "id")
    imports = parsed["imports"] if only is None else few(parsed["imports"].withColumn("at", F.concat(F.lit("file:"), F.col("file_path"))), "at").drop("at")
    parts = {
        "calls": resolve_calls(symbols, parsed["imports"], few(parsed["calls"], "caller_id"), max_calls), "references": reference_edges(symbols, few(parsed["references"], "src")), "imports": import_edges(symbols, imports),
        "bases": inheritance(symbols, own), "implicit": implicit_implementations(symbols), "types": type_edges(symbols, own), "defines": few(defines_edges(symbols), "src"),
    }
    every = None
    for name, part in parts.items():
        part = part.withColumn("origin", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return write_table(every, "edges")


def parse_project(files: DataFrame, max_calls: int | None = MAX_CALLS) -> Project:
    """A project of ``files`` (``file_path, text``)."""
    parsed = _parsed(files)
    return Project(**parsed, edges=_resolved(parsed, max_calls))


_SHAPE = ["id", "name", "kind", "package", "file_path", "receiver", "language", "bases", "returns"]


def refresh(p: Project, changed: DataFrame, files: DataFrame, max_calls: int | None = MAX_CALLS) -> Project:
    """The project after a batch of ``changed`` files (``file_path``; added, edited and removed ones), of which ``files`` (``file_path, text``) are there: the same as parsing all anew.

    Only these are parsed. What is resolved anew is found by name: names of symbols that came, went or changed (not those of
    symbols whose bodies alone did) lead to the callers, referring symbols, subtypes and methods in other files that use them, and paths of
    files that came or went to the files that import them. All other edges stay. Implicit implementations are
    sets of methods over the whole project, and are taken anew from the symbols.
    """
    gone = changed.select("file_path").distinct()
    fresh = _parsed(files.join(gone, "file_path", "left_semi"))
    now = {}
    for name, new in fresh.items():
        now[name] = write_table(getattr(p, name).join(gone, "file_path", "left_anti").unionByName(new), name)
    before = p.symbols.join(gone, "file_path", "left_semi")
    shape = lambda d: d.select(*_SHAPE)
    moved = shape(before).exceptAll(shape(fresh["symbols"])).unionByName(shape(fresh["symbols"]).exceptAll(shape(before)))
    names = write_table(moved.select("name").distinct(), "moved-names")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    users = lambda d, key, name: d.join(names.select(F.col("name").alias(name)), name, "left_semi").select(F.col(key).alias("id"))
    alias = now["imports"].where("alias IS NOT NULL").select("file_path", F.col("alias").alias("target"), F.explode("names").alias("real"))
    methods = now["symbols"].select(F.col("id").alias("caller_id"), F.col("receiver").alias("own")).where("own IS NOT NULL")
    types = now["symbols"].where(F.col("kind").isin(*CALLABLE))
    stems = lambda d: d.select("file_path").distinct()
    came = stems(p.symbols).exceptAll(stems(now["symbols"])).unionByName(stems(now["symbols"]).exceptAll(stems(p.symbols)))
    tails = write_table(came.select(F.element_at(F.split(F.regexp_replace("file_path", r"(/__init__)?\.[^/.]*$", ""), "/"), -1).alias("tail")).distinct(), "moved-files")
    only = (
        before.select("id").unionByName(fresh["symbols"].select("id"))
        .unionByName(gone.select(F.concat(F.lit("file:"), F.col("file_path")).alias("id")))
        .unionByName(fresh["calls"].select(F.col("caller_id").alias("id"))).unionByName(fresh["references"].select(F.col("src").alias("id")))
        .unionByName(p.calls.join(gone, "file_path", "left_semi").select(F.col("caller_id").alias("id"))).unionByName(p.references.join(gone, "file_path", "left_semi").select(F.col("src").alias("id")))
        .unionByName(users(now["calls"], "caller_id", "target"))
        .unionByName(users(now["calls"].join(alias, ["file_path", "target"]), "caller_id", "real"))
        .unionByName(users(now["calls"].join(methods, "caller_id"), "caller_id", "own"))
        .unionByName(users(now["references"], "src", "name"))
        .unionByName(users(now["symbols"].select("id", F.explode("bases").alias("base")).withColumn("base", last("base")), "id", "base"))
        .unionByName(users(types, "id", "receiver"))
        .unionByName(users(types.where("returns IS NOT NULL").select("id", F.explode(F.regexp_extract_all("returns", F.lit(r"[A-Za-z_]\w*"), 0)).alias("word")), "id", "word"))
        .unionByName(now["imports"].withColumn("tail", last(F.regexp_replace(import_path(), "/", "."))).join(tails, "tail", "left_semi").select(F.concat(F.lit("file:"), F.col("file_path")).alias("id")))
    )
    only = write_table(only.distinct(), "moved-sources")
    kept = p.edges.where("origin <> 'implicit'").join(only.withColumnRenamed("id", "src"), "src", "left_anti")
    return Project(**now, edges=write_table(kept.unionByName(_resolved(now, max_calls, only)), "edges"))


def build_graph(files: DataFrame, max_calls: int | None = MAX_CALLS) -> CodeGraph:
    """The graph of ``files`` (``file_path, text``): symbols, files and external placeholders as nodes; calls, imports, implements, embeds, receives, returns, references and defines as edges. ``max_calls`` is of :func:`resolve_calls`."""
    return project_graph(parse_project(files, max_calls))


def project_graph(p: Project) -> CodeGraph:
    symbols, edges, files = p.symbols, p.edges.drop("origin"), p.files
    outside = edges.where("dst LIKE 'external:%'").select(F.col("dst").alias("id"))
    nodes = nodes_of(symbols, outside)
    package = F.when(F.col("file_path").contains("/"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)).otherwise("")
    file_nodes = files.select("file_path").distinct().select(
        F.concat(F.lit("file:"), F.col("file_path")).alias("id"), F.col("file_path").alias("name"), F.lit("file").alias("kind"), package.alias("package"), "file_path",
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("exported"), F.lit("").alias("language"),
    )
    nodes = write_table(nodes.unionByName(file_nodes), "nodes")
    return CodeGraph(nodes, write_table(valid_edges(edges, nodes), "edges"))


def super_chain(symbols: DataFrame) -> DataFrame:
    """``id, path``: a type with its first base, that one's first base, and so on, from the top down."""
    t = symbols.where("kind IN ('class', 'struct', 'interface')").select("id", "name", F.element_at(F.split(F.get("bases", F.lit(0)), r"\."), -1).alias("base"))
    first = t.groupBy("name").agg(F.min("id").alias("parent")).withColumnRenamed("name", "base")
    return root_paths(t.join(first, "base", "left").select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent")))


def retarget(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges whose placeholder target is replaced by what a definition table (``src, line, dst, target``) says."""
    d = definitions.select("src", "line", "dst", "target")
    return edges.join(d, ["src", "line", "dst"], "left").select("src", F.coalesce("target", "dst").alias("dst"), "etype", "file_path", "line")
