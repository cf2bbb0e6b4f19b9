"""Work on a project around its graph: index batches, minimal context, change plans, type checks, lint policies, history, invariants, staged runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.sequential import adjacency, breadth_first, fits, in_one_task
from graphloom.operators.structural import UNLIMITED
from graphloom.operators.traversal import bfs, way_up
from graphloom.plans.tables import write_table
from graphloom.sources.graphs import CodeGraph

# --- index batches -----------------------------------------------------------


def add_batch(index: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with ``batch`` (columns of nodes, and ``at``, its order), and the rejects ``at, id, reason``.

    Rows without id or name, or that end before they start, are invalid; then ids that came earlier in the batch are
    duplicates; and only if there are none of these, ids that the index has. All or nothing: with any reject, the index stays as it is.
    """
    bad = (F.coalesce(F.col("id"), F.lit("")) == "") | (F.coalesce(F.col("name"), F.lit("")) == "") | F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(False))
    b = batch.withColumn("bad", bad).withColumn("nth", F.row_number().over(Window.partitionBy("id", "bad").orderBy("at")))
    own = b.select("at", "id", F.when(F.col("bad"), "invalid").when(F.col("nth") > 1, "repeated in the batch").alias("reason")).where("reason IS NOT NULL")
    if own.isEmpty():
        own = batch.join(index.select("id"), "id", "left_semi").select("at", "id", F.lit("in the index").alias("reason"))
    return (index.unionByName(batch.select(*index.columns)) if own.isEmpty() else index), own


# --- minimal context ---------------------------------------------------------

#: Tokens a character, characters a line, least tokens of a block, and the most types, interfaces and callees of a context.
TOKENS_PER_CHAR, CHARS_PER_LINE, MIN_TOKENS = 0.25, 50, 10
MAX_PARTS = {"type": 10, "interface": 5, "callee": 10}


def symbol_tokens(start: Column, end: Column, signature: Column) -> Column:
    """Tokens that a symbol's code takes, by its lines and signature."""
    lines = F.greatest(end - start + 1, F.lit(1))
    body = F.greatest(F.floor(lines * CHARS_PER_LINE * TOKENS_PER_CHAR), F.lit(MIN_TOKENS))
    return (body + F.floor(F.length(F.coalesce(signature, F.lit(""))) * TOKENS_PER_CHAR)).cast("long")


def minimal_context(g: CodeGraph, targets: DataFrame, budget: int = 4000) -> DataFrame:
    """``target, part, id, tokens, total``: what one needs to read with each of ``targets`` (``id``): itself, the types it refers to, the interfaces it implements and what it calls most, in this order.

    Each part is taken as long as it fits what is left of ``budget`` and its kind has room (MAX_PARTS); within a kind by number of edges, then id. Candidates of a target are few: its own neighbours.
    """
    signature = F.col("signature") if "signature" in g.nodes.columns else F.lit(None).cast("string")
    n = g.nodes.select("id", "kind", symbol_tokens(F.col("start_line"), F.col("end_line"), signature).alias("tokens"))
    t = targets.select(F.col("id").alias("target")).distinct()
    out = g.edges.join(t, F.col("src") == F.col("target")).groupBy("target", "etype", F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(n, "id").where("id <> target")
    part = (
        F.when(F.col("etype").isin("references", "returns", "receives", "parameters") & F.col("kind").isin("struct", "interface", "type", "class"), "type")
        .when(F.col("etype") == "implements", "interface").when(F.col("etype") == "calls", "callee")
    )
    found = out.withColumn("part", part).where("part IS NOT NULL").groupBy("target", "part", "id").agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens"))
    order = F.when(F.col("part") == "type", 1).when(F.col("part") == "interface", 2).otherwise(3)
    # a part that doesn't fit leaves room for later ones, so only the smallest that many rows could hold are dropped: those beyond budget alone
    listed = found.where(F.col("tokens") <= budget).groupBy("target").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), (-F.col("n")).alias("n"), "id", "part", "tokens"))).alias("items"))
    own = n.join(t, n["id"] == t["target"]).select("target", F.col("tokens").alias("own"))
    start = F.struct(F.col("own").alias("total"), F.lit(0).alias("type"), F.lit(0).alias("interface"), F.lit(0).alias("callee"), F.array(F.struct(F.lit("target").alias("part"), F.col("target").alias("id"), F.col("own").alias("tokens"), F.col("own").alias("total"))).alias("taken"))

    def take(s: Column, x: Column) -> Column:
        room = F.when(x["part"] == "type", s["type"] < MAX_PARTS["type"]).when(x["part"] == "interface", s["interface"] < MAX_PARTS["interface"]).otherwise(s["callee"] < MAX_PARTS["callee"])
        total = s["total"] + x["tokens"]
        more = lambda k: (s[k] + (x["part"] == k).cast("int")).alias(k)
        row = F.struct(x["part"].alias("part"), x["id"].alias("id"), x["tokens"].alias("tokens"), total.alias("total"))
        return F.when(room & (total <= budget), F.struct(total.alias("total"), more("type"), more("interface"), more("callee"), F.concat(s["taken"], F.array(row)).alias("taken"))).otherwise(s)

    empty = F.array().cast("array<struct<o:int,n:bigint,id:string,part:string,tokens:bigint>>")
    packed = own.join(listed, "target", "left").select("target", F.aggregate(F.coalesce("items", empty), start, take)["taken"].alias("taken"))
    return packed.select("target", F.explode("taken").alias("x")).select("target", "x.part", "x.id", "x.tokens", "x.total")


# --- packages ----------------------------------------------------------------


def shortest_cycle(dependencies: DataFrame, package: str, sequential: bool = False) -> list[str]:
    """The packages of a shortest cycle through ``package`` (``src_package, dst_package``), which comes first and last; empty if there is none. Of equal ones, that of the least packages."""
    e = dependencies.select(F.col("src_package").alias("src"), F.col("dst_package").alias("dst")).distinct()
    e = write_table(e, "dependencies")
    if sequential and fits(e):

        def walk(a, b, ids):
            import pandas as pd

            place = {v: i for i, v in enumerate(ids)}
            if package not in place:
                return
            own, near = place[package], adjacency(a, b, len(ids))
            depth, parent = breadth_first(near, own)
            last = min((v for v in range(len(ids)) if depth[v] >= 0 and own in near[v]), key=lambda v: (depth[v], v), default=None)
            if last is not None:
                way = [own, last]
                while way[-1] != own:
                    way.append(parent[way[-1]])
                yield pd.DataFrame({"at": range(len(way)), "id": [ids[i] for i in reversed(way)]})

        return [r["id"] for r in in_one_task(e, walk, "at long, id string").orderBy("at").collect()]
    seen = bfs(e, e.sparkSession.createDataFrame([(package, package)], "root string, id string"), UNLIMITED)
    seen = write_table(seen.select("id", "parent", "depth"), "seen")
    last = seen.join(e.where(F.col("dst") == package).select(F.col("src").alias("id")), "id").orderBy("depth", "id").first()
    if last is None:
        return []
    return [r["id"] for r in way_up(seen, last["id"], last["depth"]).join(seen, "id").orderBy("depth").select("id").collect()] + [package]


# --- type checks -------------------------------------------------------------


#: Builtin types whose values pass for others', and the numbers that a conversion turns into each other.
BUILTIN_FITS = {
    "int": ["int64", "int32"], "int64": ["int"], "int32": ["int"], "float64": ["float32"], "float32": ["float64"], "byte": ["uint8"], "rune": ["int32"],
}
NUMERIC = ["int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "float32", "float64"]
#: Types that take any value, and how sure each reason is.
ANYTHING = ["interface{}", "any"]
SURE = {"exact": 1.0, "anything": 0.95, "builtin": 0.95, "interface": 0.9, "dereference": 0.7, "address": 0.6, "none": 0.8}


def type_compatibility(pairs: DataFrame, satisfied: DataFrame) -> DataFrame:
    """``source, target, compatible, reason, confidence, conversions`` of ``pairs`` (``source, target``).

    The first reason that holds: names that are equal but for space around them (exact), a target that takes anything, builtin types that
    pass for each other, an interface that the source satisfies (``type, interface``, from implements edges), a pointer for its value
    (dereference) or a value for its pointer (address). Else none, with ``conversions``: what a programmer may write. Slices are
    compatible if their names are equal. A null or empty name gives the reason invalid and a null confidence.
    """
    p = pairs.withColumns({"s": F.trim("source"), "t": F.trim("target")})
    ok = satisfied.select(F.trim("type").alias("s"), F.trim("interface").alias("t"), F.lit(True).alias("fits")).distinct()
    s, t = F.col("s"), F.col("t")
    builtin = F.concat_ws(">", s, t).isin(*(f"{a}>{b}" for a, fits in BUILTIN_FITS.items() for b in fits))
    reason = (
        F.when(F.coalesce(F.col("source"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("target"), F.lit("")).eqNullSafe(""), "invalid")
        .when(s == t, "exact").when(t.isin(*ANYTHING), "anything").when(builtin, "builtin").when(F.col("fits"), "interface")
        .when(s == F.concat(F.lit("*"), t), "dereference").when(t == F.concat(F.lit("*"), s), "address").otherwise("none")
    )
    ways = [
        (s.isin(*NUMERIC) & t.isin(*NUMERIC), F.concat(t, F.lit("(value)"))),
        (s.isin("[]byte", "[]rune") & (t == "string"), F.lit("string(value)")),
        ((s == "string") & t.isin("[]byte", "[]rune"), F.concat(t, F.lit("(value)"))),
        (~s.startswith("*") & t.startswith("*"), F.lit("&value (if addressable)")),
        (s.startswith("*") & ~t.startswith("*"), F.lit("*value (dereference)")),
    ]
    found = F.filter(F.array(*(F.when(on, way) for on, way in ways)), lambda x: x.isNotNull())
    sure = F.create_map(*(F.lit(x) for kv in SURE.items() for x in kv))
    return p.join(ok, ["s", "t"], "left").withColumn("reason", reason).select(
        "source", "target", (~F.col("reason").isin("none", "invalid")).alias("compatible"), "reason", F.try_element_at(sure, F.col("reason")).alias("confidence"),
        F.when(F.col("reason") == "none", found).otherwise(F.array().cast("array<string>")).alias("conversions"),
    )


def missing_methods(types: DataFrame, interfaces: DataFrame, pairs: DataFrame) -> DataFrame:
    """``type, interface, satisfied, missing`` of ``pairs`` (``type, interface``): the methods (``type, method`` and ``interface, method``) that the type lacks; an interface without methods is satisfied."""
    need = pairs.distinct().join(interfaces.select("interface", "method").distinct(), "interface", "left")
    have = types.select("type", "method", F.lit(True).alias("has")).distinct()
    lack = need.join(have, ["type", "method"], "left").groupBy("type", "interface").agg(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("method")))).alias("missing"))
    return lack.select("type", "interface", (F.size("missing") == 0).alias("satisfied"), "missing")


# --- change plans ------------------------------------------------------------


def change_plan(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """``file_path, step, symbols, callers``: files to edit for ``changes`` (``id``) in order: first those of the changed symbols, then those that call them, each with the symbols and call sites that it has."""
    own = g.nodes.join(changes.select("id").distinct(), "id", "left_semi").groupBy("file_path").agg(F.count("*").alias("symbols"))
    at = g.nodes.select(F.col("id").alias("src"), "file_path")
    calls = g.of_type("calls").select("src", "dst").join(changes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").join(at, "src").groupBy("file_path").agg(F.count("*").alias("callers"))
    both = own.join(calls, "file_path", "full").na.fill(0, ["symbols", "callers"])
    return both.select("file_path", F.when(F.col("symbols") > 0, 1).otherwise(2).alias("step"), "symbols", "callers")


def invalid_changes(g: CodeGraph, changes: DataFrame) -> DataFrame:
    """``id, reason`` of ``changes`` (``id, change``) that can't be made: of symbols that aren't there, or with two different changes for one."""
    gone = changes.join(g.nodes.select("id"), "id", "left_anti").select("id", F.lit("no such symbol").alias("reason")).distinct()
    twice = changes.groupBy("id").agg(F.countDistinct("change").alias("n")).where("n > 1").select("id", F.lit("conflicting changes").alias("reason"))
    return gone.unionByName(twice)


# --- lint policies -----------------------------------------------------------


def apply_policy(issues: DataFrame, policy: DataFrame | None) -> DataFrame:
    """``issues`` (``rule, ...``) with ``level``: that of ``policy`` (``pattern, level``; error, warning, info or ignore), the longest pattern that is the rule or, ending in ``*``, begins it; ignored issues go, others without a pattern and all without a policy are warnings."""
    if policy is None:
        return issues.withColumn("level", F.lit("warning"))
    p = F.broadcast(policy.select("pattern", F.col("level").alias("found")))
    rules = issues.select("rule").distinct()
    hit = rules.join(p, (F.col("rule") == F.col("pattern")) | (F.col("pattern").endswith("*") & F.col("rule").startswith(F.regexp_replace("pattern", r"\*$", ""))))
    best = hit.groupBy("rule").agg(F.max_by("found", F.struct(F.length("pattern"), "pattern")).alias("found"))
    return issues.join(best, "rule", "left").withColumn("level", F.coalesce("found", F.lit("warning"))).where("level <> 'ignore'").drop("found")


# --- history -----------------------------------------------------------------


def history(events: DataFrame, symbol_id: str, since_ms: int, until_ms: int) -> DataFrame:
    """A symbol's events (``symbol_id, timestamp_ms, ...``) from ``since_ms`` to ``until_ms``, both included."""
    return events.where((F.col("symbol_id") == symbol_id) & F.col("timestamp_ms").between(since_ms, until_ms))


def recent_events(events: DataFrame, limit: int, by_symbol: bool = False) -> DataFrame:
    """The latest ``limit`` events of all, or of each symbol; ties by symbol, then by the other columns."""
    order = [F.desc("timestamp_ms"), "symbol_id", *(f"`{c}`" for c in events.columns if c not in ("timestamp_ms", "symbol_id"))]
    if not by_symbol:
        return events.orderBy(*order).limit(limit)
    w = Window.partitionBy("symbol_id").orderBy(*order)
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")


def history_stats(events: DataFrame) -> DataFrame:
    """``events, symbols, oldest, newest``."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("symbol_id").alias("symbols"), F.min("timestamp_ms").alias("oldest"), F.max("timestamp_ms").alias("newest"))


def retained(events: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Events of the last ``days`` days."""
    return events.where(F.col("timestamp_ms") >= now_ms - days * 86_400_000)


# --- invariants --------------------------------------------------------------


def holds_unique(*keys: str) -> Column:
    """Aggregate: no two rows have the same ``keys``."""
    return F.count("*") == F.countDistinct(F.struct(*keys))


def holds_bounded(x: str, low: float, high: float) -> Column:
    return F.coalesce(F.bool_and(F.col(x).between(low, high)), F.lit(True))


def holds_sum(parts: str, total: float, tolerance: float = 1e-9) -> Column:
    return F.abs(F.coalesce(F.sum(parts), F.lit(0.0)) - total) <= tolerance


def holds_distribution(x: str, tolerance: float = 1e-9) -> Column:
    """Aggregate: shares of 0 to 1 that add up to 1."""
    return holds_bounded(x, -tolerance, 1 + tolerance) & holds_sum(x, 1.0, tolerance)


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def check(df: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """``property, holds`` of aggregates over ``df``, in one pass."""
    one = df.agg(*(c.alias(n) for n, c in properties.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.col(n).alias("holds")) for n in properties))).alias("x")).select("x.property", "x.holds")


def steps_back(df: DataFrame, by: str, order: list[str], x: str) -> DataFrame:
    """``by, n``: how often ``x`` falls from one row to the next; none where it is monotonic."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("before", F.lag(x).over(w)).groupBy(by).agg(F.count_if(F.col(x) < F.col("before")).alias("n")).where("n > 0")


# --- staged runs and kept results --------------------------------------------


def run_stages(spark: SparkSession, stages: list[tuple[str, list[str], Callable[..., DataFrame]]], root: str, attempts: int = 3) -> dict[str, DataFrame]:
    """Run ``(name, inputs, function of their tables)`` in the order of their needs, each result a table under ``root``.

    A stage whose table is complete isn't run again, so a run that failed goes on where it stopped; a stage that
    fails is tried ``attempts`` times. A need that no stage gives, or a cycle, raises ValueError.
    """
    done: dict[str, DataFrame] = {}
    todo = list(stages)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while todo:
        ready = [s for s in todo if all(i in done for i in s[1])]
        if not ready:
            raise ValueError("stages that can't run: " + ", ".join(s[0] for s in todo))
        for name, inputs, make in ready:
            at = f"{root}/{name}"
            for left in range(attempts - 1, -1, -1):
                if fs.exists(path(f"{at}/_SUCCESS")):
                    break
                try:
                    make(*(done[i] for i in inputs)).write.mode("overwrite").parquet(at)
                except Exception:
                    if not left:
                        raise
            done[name] = spark.read.parquet(at)
        todo = [s for s in todo if s[0] not in done]
    return done


def kept(spark: SparkSession, root: str, name: str, generation: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result that is made once for each ``generation`` of a graph (its hash) and read from then on; other generations stay until their folders are deleted."""
    return run_stages(spark, [("result", [], make)], f"{root}/{name}/{generation}")["result"]


def hot_symbols(accesses: DataFrame, top: int) -> DataFrame:
    """``id, n``: the symbols asked for most (``id``), whose results are worth making ahead; ties by id."""
    return accesses.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(top)


# --- library documents -------------------------------------------------------


def search_library(docs: DataFrame, text: str, library: str | None = None, limit: int = 10) -> DataFrame:
    """``doc_id, score, rank`` of ``docs`` (``doc_id, library, text``) for a text, within one library if asked: BM25 over the documents searched."""
    from graphloom.functions.search import bm25_top

    own = docs if library is None else docs.where(F.col("library") == library)
    asked = docs.sparkSession.createDataFrame([("q", text)], "query_id string, text string")
    return bm25_top(own.select("doc_id", "text"), asked, limit).select("doc_id", "score", "rank")


