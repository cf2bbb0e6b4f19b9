"""Symbol search, query terms, BM25, packing and memory scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.tables import write_table

#: The order of importance of symbol kinds.
KIND_PENALTY = {"function": 0, "method": 0, "type": 1, "interface": 1, "struct": 1, "variable": 2, "constant": 2, "field": 3, "parameter": 3}
OTHER_KIND = 5
TEST_PENALTY, UNEXPORTED_PENALTY, UNDERSCORE_PENALTY, DEPTH_PENALTY = 50_000, 20_000, 10_000, 1000
BASE = 100_000


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(r"(_test\.go|_test\.py|(^|/)test_[^/]*\.py|(^|/)conftest\.py|\.(test|spec)\.[jt]sx?)$|(^|/)(test|tests|__tests__)/")


def context_penalty(name: Column, file_path: Column, exported: Column) -> Column:
    depth = F.length(file_path) - F.length(F.replace(file_path, F.lit("/"), F.lit("")))
    return (
        F.when(is_test_file(file_path), TEST_PENALTY).otherwise(0)
        + F.when(exported, 0).otherwise(UNEXPORTED_PENALTY)
        + F.when(name.startswith("_"), UNDERSCORE_PENALTY).otherwise(0)
        + F.greatest(depth - 2, F.lit(0)) * DEPTH_PENALTY
    )


def fuzzy_search(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """``id, name, match, score`` of symbols that match ``text`` without regard to case: the lower the score the better.

    A match is exact, else a prefix, a word of a camel-cased or otherwise divided name, a substring, or
    within an edit distance of a third of the text's length (2 at least). An exact match scores
    its context alone; others their class, context, position, difference in length and kind. Ties by id.
    """
    low, q = F.lower("name"), text.lower()
    word = F.regexp_instr("name", F.lit(rf"(?:^|[^A-Za-z0-9]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))(?i:{_quote(text)})(?=$|[^a-z])"))
    at = F.instr(low, q) - 1
    near = F.levenshtein(low, F.lit(q), max(2, len(q) // 3))
    match = (
        F.when(low == q, "exact").when(low.startswith(q), "prefix").when(word > 0, "word").when(at >= 0, "substring").when(near >= 0, "fuzzy")
    )
    base = F.when(match == "prefix", 1).when(match == "word", 2).when(match == "substring", 3).otherwise(4)
    position = F.when(match.isin("word", "substring") & (at > 0), F.least(F.lit(99), F.floor(at * 100 / F.length("name")))).otherwise(0)
    length = F.least(F.lit(99), F.abs(F.length("name") - len(text)))
    kind = F.lit(OTHER_KIND)
    for k, v in KIND_PENALTY.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    context = context_penalty(F.col("name"), F.col("file_path"), F.col("exported"))
    score = F.when(match == "exact", context).otherwise(base * BASE + context + position * 100 + length * 10 + kind)
    found = nodes.where(match.isNotNull()).select("id", "name", match.alias("match"), score.cast("long").alias("score"))
    return found if limit is None else found.orderBy("score", "id").limit(limit)


def _quote(text: str) -> str:
    import re

    return re.escape(text)


STOP_TERMS = ("a", "an", "and", "are", "does", "do", "find", "for", "from", "get", "how", "in", "is", "list", "of", "on", "show", "that", "the", "this", "to", "what", "where", "which", "who", "with")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of an array ``value`` that is worked out once, however often ``body`` names it."""
    return F.flatten(F.transform(F.array(value), body))


def query_terms(text: Column) -> Column:
    """Distinct terms of a query, in order: quoted strings, paths and their last part, names whole and in parts, and adjacent pairs."""
    quoted = F.regexp_extract_all(text, F.lit(r"[\"'`]([^\"'`]+)[\"'`]"), 1)
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./]+"), 0), lambda w: F.length(w) > 1)
    words = F.transform(words, lambda w: F.btrim(w, F.lit("./")))
    stop = F.array(*map(F.lit, STOP_TERMS))
    content = F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)) & (w != ""))

    def terms(c: Column) -> Column:
        tails = F.filter(F.transform(c, lambda w: F.when(w.contains("/"), F.substring_index(w, "/", -1))), lambda w: w.isNotNull())
        parts = F.flatten(F.transform(c, lambda w: F.split(F.regexp_replace(w, r"([a-z0-9])([A-Z])", "$1 $2"), r"[\s_./]+")))
        pairs = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.element_at(c, i + 1), w))
        return F.concat(c, tails, parts, pairs)

    lowered = F.transform(F.concat(quoted, _let(content, terms)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(lowered, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def word_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _bm25_raw(docs: DataFrame, queries: DataFrame, k1: float, b: float) -> DataFrame:
    """``query_id, doc_id, raw``: the scores of :func:`bm25` before they are scaled.

    Documents are cut into terms once. What meets each document is the table of asked terms, which grows with the queries alone; a document's
    terms stay together, so they are summed before the shuffle.
    """
    own = docs.select("doc_id", F.array_distinct(word_terms(F.col("text"))).alias("terms")).select("doc_id", F.size("terms").alias("len"), "terms")
    own = write_table(own, "bm25-terms")
    size = own.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    post = own.select("doc_id", "len", F.explode("terms").alias("term"))
    asked = queries.select("query_id", F.explode(F.array_distinct(word_terms(F.col("text")))).alias("term"))
    df = post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarity = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * (k1 + 1)
    terms = write_table(asked.join(df, "term").crossJoin(F.broadcast(size)).select("query_id", "term", rarity.alias("rarity"), "mean"), "bm25-asked")
    weight = F.col("rarity") / (1 + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return post.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("raw"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score``: BM25 of ``docs`` (``doc_id, text``) for ``queries`` (``query_id, text``) that share a term.

    Term frequency is 0 or 1, a document's length its number of distinct terms, the inverse document frequency
    ln((N + 1) / (df + 1)) + 1; the best score of a query is scaled to 1. Statistics are of all documents.
    """
    # pairs are many more than documents: once they are summed they are written, and not shuffled again to meet the best of their query
    raw = write_table(_bm25_raw(docs, queries, k1, b), "bm25-raw")
    best = write_table(raw.groupBy("query_id").agg(F.max("raw").alias("best")), "bm25-best")
    return raw.join(best, "query_id").select("query_id", "doc_id", (F.col("raw") / F.col("best")).alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score, rank``: the best ``k`` of :func:`bm25` for each query, ties by id, exactly. Each task keeps its own best ``k`` of a query before they meet."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 9)), "doc_id")
    best = write_table(_bm25_raw(docs, queries, k1, b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "bm25-best")
    top = best.where("rank = 1").select("query_id", F.col("raw").alias("top"))
    return best.join(top, "query_id").select("query_id", "doc_id", (F.col("raw") / F.col("top")).alias("score"), "rank")


def ucb1(rewards: DataFrame, c: float = 2.0**0.5) -> DataFrame:
    """``arm, plays, mean, score`` of ``rewards`` (``arm, reward``): mean plus ``c`` times sqrt(ln(all plays) / plays)."""
    per = rewards.groupBy("arm").agg(F.count("*").alias("plays"), F.avg("reward").alias("mean"))
    total = rewards.agg(F.count("*").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("arm", "plays", "mean", (F.col("mean") + c * F.sqrt(F.log("total") / F.col("plays"))).alias("score"))


def packing_score(match: Column, depth: Column, kind: Column) -> Column:
    """.4 by the kind of match (exact 1, prefix .95, word .8, substring .6), .3 by nearness, .3 by kind."""
    m = F.when(match == "exact", 1.0).when(match == "prefix", 0.95).when(match == "word", 0.8).when(match == "substring", 0.6).otherwise(0.0)
    k = F.when(kind.isin("function", "method"), 1.0).when(kind.isin("interface", "struct", "type", "class"), 0.8).otherwise(0.5)
    return 0.4 * m + 0.3 / (depth + 1) + 0.3 * k


def estimate_tokens(text: Column) -> Column:
    """A token for every four characters or part of four."""
    return F.ceil(F.length(text) / 4)


def pack_greedy(items: DataFrame, budget: int, buffer: float = 0.1) -> DataFrame:
    """``query_id, id, tokens, used``: items (``query_id, id, score, tokens``) taken by falling score, skipping those that don't fit ``budget`` less the buffer. One query's items are one task."""
    room = int(budget * (1 - buffer))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = 0, []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            if used + r.tokens <= room:
                used += r.tokens
                rows.append((r.query_id, r.id, r.tokens, used))
        return pd.DataFrame(rows, columns=["query_id", "id", "tokens", "used"])

    # of items of one size no more can be taken than fit alone: the rest is left out before the items meet
    sized = items.where((F.col("tokens") > 0) & (F.col("tokens") <= room))
    few = sized.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "tokens").orderBy(F.desc("score"), "id")))
    few = few.where((F.col("__rn") <= max(room, 0)) & (F.col("__rn") * F.col("tokens") <= room)).drop("__rn")
    items = few.unionByName(items.where("tokens <= 0"))
    t = dict(items.dtypes)
    return items.groupBy("query_id").applyInPandas(pack, f"query_id {t['query_id']}, id {t['id']}, tokens long, used long")


def memory_score(confidence: Column, age_days: Column, relevance: Column, boost: Column) -> Column:
    """(.3 confidence + .2 exp(-days / 30) + .5 relevance) times the scope's boost."""
    return (0.3 * confidence + 0.2 * F.exp(-age_days / 30) + 0.5 * relevance) * boost


def memory_feedback(memories: DataFrame, feedback: DataFrame) -> DataFrame:
    """``id, confidence`` after ``feedback`` (``id, validations, contradictions``): +.1 each to 1 at most, -.3 each; at .1 or less a memory goes."""
    j = memories.join(feedback, "id", "left").na.fill(0, ["validations", "contradictions"])
    new = F.least(F.lit(1.0), F.col("confidence") + 0.1 * F.col("validations")) - 0.3 * F.col("contradictions")
    return j.select("id", F.round(new, 9).alias("confidence")).where("confidence > 0.1")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
