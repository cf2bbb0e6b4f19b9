"""Project files: walks, globs, manifests, snapshots, and the ingest and export of other formats."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.graphs import CodeGraph

#: What a project walk leaves out by default.
DEFAULT_EXCLUDES = ("vendor", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", "*_test.go", "*_test.py", "test_*.py", "conftest.py", "*.test.ts", "*.test.js", "*.spec.ts", "*.spec.js", "*.test.tsx", "*.test.jsx")


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: ``**`` spans directories, ``*`` and ``?`` don't, ``[...]`` and ``{a,b}`` choose. A glob without a slash fits at any depth."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            continue
        depth += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{'' if '/' in glob else '(?:.*/)?'}{out}$"


def glob_regex_column(glob: Column) -> Column:
    """:func:`glob_regex` for a column of globs with ``*``, ``**`` and ``?``."""
    safe = F.regexp_replace(glob, r"([.+^$()|\[\]{}\\])", r"\\$1")
    any_dir = F.replace(F.replace(safe, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    one = F.replace(F.replace(any_dir, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    full = F.replace(F.replace(one, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.concat(F.when(glob.contains("/"), "^").otherwise("^(?:.*/)?"), full, F.lit("$"))


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), excludes: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """``file_path, text, size, mtime_ms`` of the files below ``root``, relative to it. An exclude without a slash fits a file's or a directory's name at any depth."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    marker = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    path = F.substring_index(F.col("path"), marker, -1)
    out = f.select(path.alias("file_path"), F.decode("content", "utf-8").alias("text"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    if extensions:
        out = out.where(F.col("file_path").rlike(r"(" + "|".join(re.escape(e) for e in extensions) + r")$"))
    for g in excludes:
        whole = glob_regex(g)
        out = out.where(~F.col("file_path").rlike(whole if "/" in g else whole.removesuffix("$") + "(?:/|$)"))
    return out


def manifest(files: DataFrame) -> DataFrame:
    """``file_path, hash``: SHA-256 of each text."""
    return files.select("file_path", F.sha2(F.encode("text", "utf-8"), 256).alias("hash"))


def graph_hash(g: CodeGraph) -> DataFrame:
    """``hash``: one number for a graph, whatever the order of its rows."""
    n = g.nodes.agg(F.coalesce(F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0)).alias("n"))
    e = g.edges.agg(F.coalesce(F.sum(F.xxhash64("src", "dst", "etype").cast("decimal(38,0)")), F.lit(0)).alias("e"))
    return n.crossJoin(e).select(F.sha2(F.concat_ws("|", "n", "e"), 256).alias("hash"))


def save_snapshot(g: CodeGraph, root: str, snapshot_id: str) -> None:
    """Write a graph as one snapshot; edges are partitioned by type and sorted by source, so filters prune files and row groups."""
    g.nodes.write.mode("overwrite").parquet(f"{root}/nodes/snapshot_id={snapshot_id}")
    g.edges.sortWithinPartitions("src").write.mode("overwrite").partitionBy("etype").parquet(f"{root}/edges/snapshot_id={snapshot_id}")


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> CodeGraph:
    """A snapshot, by default the latest by id."""
    snapshot_id = snapshot_id or max(list_snapshots(spark, root))
    nodes = spark.read.parquet(f"{root}/nodes/snapshot_id={snapshot_id}")
    edges = spark.read.parquet(f"{root}/edges/snapshot_id={snapshot_id}")
    return CodeGraph(nodes, edges)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    at, fs = _fs(spark, f"{root}/nodes")
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(at) if "=" in s.getPath().getName())


def delete_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> None:
    for part in ("nodes", "edges"):
        at, fs = _fs(spark, f"{root}/{part}/snapshot_id={snapshot_id}")
        fs.delete(at, True)


# --- other formats -----------------------------------------------------------


def coverage_profile(lines: DataFrame) -> DataFrame:
    """``file_path, start_line, end_line, statements, hits`` of a Go cover profile's lines (``value``)."""
    p = r"^(\S+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$"
    g = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(g(1).alias("file_path"), *(g(i).cast("int").alias(n) for i, n in ((2, "start_line"), (3, "end_line"), (4, "statements"), (5, "hits"))))


def lcov_profile(texts: DataFrame) -> DataFrame:
    """``file_path, line, hits`` of LCOV texts (``text``)."""
    rec = texts.select(F.explode(F.split("text", "end_of_record")).alias("r"))
    path = F.regexp_extract("r", r"SF:([^\n]+)", 1)
    hits = F.regexp_extract_all("r", F.lit(r"DA:(\d+,\d+)"), 1)
    return rec.where(path != "").select(path.alias("file_path"), F.explode(hits).alias("h")).select("file_path", F.split("h", ",")[0].cast("int").alias("line"), F.split("h", ",")[1].cast("int").alias("hits"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """``file_path, old_start, old_lines, new_start, new_lines, added, removed`` of unified diffs (``text``)."""
    f = diffs.select(F.explode(F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=--- )")).alias("f")).where(F.col("f").contains("+++ "))
    path = F.regexp_extract("f", r"\n\+\+\+ (?:b/)?([^\t\n]+)", 1)
    h = f.select(path.alias("file_path"), F.explode(F.slice(F.split("f", r"\n(?=@@ )"), 2, 1_000_000)).alias("h"))
    p = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    n = lambda i, one=False: (F.coalesce(F.nullif(F.regexp_extract("h", p, i), F.lit("")), F.lit("1")) if one else F.regexp_extract("h", p, i)).cast("int")
    return h.select("file_path", n(1).alias("old_start"), n(2, True).alias("old_lines"), n(3).alias("new_start"), n(4, True).alias("new_lines"), F.regexp_count("h", F.lit(r"(?m)^\+")).alias("added"), F.regexp_count("h", F.lit(r"(?m)^-")).alias("removed"))


def changed_symbols(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose lines meet a hunk's new lines in the same file."""
    h = hunks.select("file_path", F.col("new_start").alias("a"), (F.col("new_start") + F.greatest(F.col("new_lines"), F.lit(1)) - 1).alias("b"))
    return nodes.join(h, "file_path").where("start_line <= b AND end_line >= a").select("id", "name", "file_path").distinct()


def grep(files: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """``file_path, line, text`` of lines that a pattern fits, with ``context`` lines around."""
    lines = files.select("file_path", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    hit = lines.where(F.col("text").rlike(pattern)).select("file_path", F.explode(F.sequence(F.col("at") - context, F.col("at") + context)).alias("at")).distinct()
    return lines.join(hit, ["file_path", "at"]).select("file_path", (F.col("at") + 1).alias("line"), "text")


def read_lines(files: DataFrame, path: str, start: int = 1, count: int = 2000) -> DataFrame:
    lines = files.where(F.col("file_path") == path).select(F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.where((F.col("at") >= start - 1) & (F.col("at") < start - 1 + count)).select((F.col("at") + 1).alias("line"), "text")


def tree(files: DataFrame) -> DataFrame:
    """``dir, files, size`` for each directory, all that is below it included."""
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(dirs).alias("dir"), F.length("text").alias("n")).groupBy("dir").agg(F.count("*").alias("files"), F.sum("n").alias("size"))


def find_files(files: DataFrame, *globs: str) -> DataFrame:
    """Files whose path one of ``globs`` fits."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | F.col("file_path").rlike(glob_regex(g))
    return files.where(hit)


def json_set(files: DataFrame, path: str, value: str) -> DataFrame:
    """``files`` with the value at ``path`` (``$.a.b``) of their JSON text set to the JSON ``value``; objects on the way are made; texts that aren't objects stay."""
    keys = path.removeprefix("$.").split(".")

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                root = json.loads(text or "")
            except ValueError:
                return text
            at = root
            for k in keys[:-1]:
                at = at.setdefault(k, {}) if isinstance(at, dict) else None
            if not isinstance(at, dict):
                return text
            at[keys[-1]] = json.loads(value)
            return json.dumps(root, ensure_ascii=False)

        return texts.map(one)

    return files.withColumn("text", put("text"))


def diff_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_path, change, at, text``: lines removed from and added to files (``file_path, text``), by the longest common runs of each file."""
    both = old.select("file_path", F.col("text").alias("a")).join(new.select("file_path", F.col("text").alias("b")), "file_path", "full").where("NOT a <=> b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, a, b in zip(pdf["file_path"], pdf["a"], pdf["b"], strict=True):
                x, y = (([] if t is None else t.split("\n")) for t in (a, b))
                for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, False).get_opcodes():
                    if tag != "equal":
                        rows += [(path, "removed", n + 1, x[n]) for n in range(i, j)] + [(path, "added", n + 1, y[n]) for n in range(k, m)]
            yield pd.DataFrame(rows, columns=["file_path", "change", "at", "text"])

    return both.mapInPandas(run, "file_path string, change string, at int, text string")


def json_path(files: DataFrame, path: str) -> DataFrame:
    return files.select("file_path", F.get_json_object("text", path).alias("value"))


def to_json_lines(g: CodeGraph) -> DataFrame:
    """``json``: one line for each node and edge; :func:`from_json_lines` reads them back."""
    n = g.nodes.select(F.to_json(F.struct(F.lit("node").alias("what"), F.struct("*").alias("row"))).alias("json"))
    return n.unionByName(g.edges.select(F.to_json(F.struct(F.lit("edge").alias("what"), F.struct("*").alias("row"))).alias("json")))


def from_json_lines(lines: DataFrame, node_schema: str, edge_schema: str) -> CodeGraph:
    def read(what: str, schema: str) -> DataFrame:
        return lines.where(F.get_json_object("json", "$.what") == what).select(F.from_json(F.get_json_object("json", "$.row"), schema).alias("r")).select("r.*")

    return CodeGraph(read("node", node_schema), read("edge", edge_schema))


def to_mermaid(g: CodeGraph) -> DataFrame:
    """``at, line`` of a Mermaid graph."""
    e = g.edges.select(F.concat(F.lit("  "), F.regexp_replace("src", r"\W", "_"), F.lit(" -->|"), F.col("etype"), F.lit("| "), F.regexp_replace("dst", r"\W", "_")).alias("line"))
    return g.nodes.sparkSession.createDataFrame([(0, "graph TD")], "at int, line string").unionByName(e.select(F.lit(1).alias("at"), "line"))


def to_dot(g: CodeGraph) -> DataFrame:
    """``at, line`` of a DOT graph."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    e = g.edges.select(F.lit(1).alias("at"), F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(' [label="'), F.col("etype"), F.lit('"];')).alias("line"))
    ends = g.nodes.sparkSession.createDataFrame([(0, "digraph {"), (2, "}")], "at int, line string")
    return ends.unionByName(e)


def to_html(g: CodeGraph, most: int = 2000) -> str:
    """A page that draws the graph by forces (with D3 from its public address): for graphs of at most ``most`` edges; a larger one raises ValueError."""
    edges = g.edges.select("src", "dst", "etype").limit(most + 1).collect()
    if len(edges) > most:
        raise ValueError(f"a page shows at most {most} edges")
    ids = sorted({x for e in edges for x in (e["src"], e["dst"])})
    data = json.dumps({"nodes": [{"id": i} for i in ids], "links": [{"source": e["src"], "target": e["dst"], "type": e["etype"]} for e in edges]}).replace("</", "<\\/")
    return (
        '<!DOCTYPE html><meta charset="utf-8"><svg width="1200" height="800"></svg><script src="https://d3js.org/d3.v7.min.js"></script><script>'
        f"const g={data},s=d3.select('svg'),l=s.selectAll('line').data(g.links).join('line').attr('stroke','#999'),n=s.selectAll('text').data(g.nodes).join('text').text(d=>d.id);"
        "d3.forceSimulation(g.nodes).force('l',d3.forceLink(g.links).id(d=>d.id)).force('c',d3.forceManyBody()).force('m',d3.forceCenter(600,400))"
        ".on('tick',()=>{l.attr('x1',d=>d.source.x).attr('y1',d=>d.source.y).attr('x2',d=>d.target.x).attr('y2',d=>d.target.y);n.attr('x',d=>d.x).attr('y',d=>d.y)});</script>"
    )


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """Write rows as CSV with a header or as JSON lines; nested columns become JSON in CSV."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_vectors(vectors: DataFrame, path: str, graph_hash: str) -> bool:
    """Write vectors for a graph unless that graph's are there; whether they were written."""
    spark = vectors.sparkSession
    at, fs = _fs(spark, f"{path}/graph_hash={graph_hash}/_SUCCESS")
    if fs.exists(at):
        return False
    vectors.write.mode("overwrite").parquet(f"{path}/graph_hash={graph_hash}")
    return True


def audit_report(events: DataFrame, period: str = "day") -> DataFrame:
    """``period, action, n`` of audit events (``ts, action``)."""
    return events.groupBy(F.date_trunc(period, "ts").alias("period"), "action").agg(F.count("*").alias("n"))
