"""Search and similarity queries over parts, documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import search
from graphloom.operators import similarity as sim
from graphloom.operators import vector_index
from graphloom.registry import query
from graphloom.sources.graphs import SESSION_SQL, SUPPLY_SQL, session_graph, supply_graph


@query(
    "fuzzy_prefix_search",
    f"""WITH {SUPPLY_SQL}, q AS (SELECT *, lower(name) AS low FROM nodes WHERE kind <> 'struct')
SELECT id, name, CASE WHEN low = 'supplier' THEN 'exact' ELSE 'prefix' END AS match,
  (100000 + CASE WHEN exported THEN 0 ELSE 20000 END + least(99, abs(length(name) - 8)) * 10 + CASE kind WHEN 'function' THEN 0 WHEN 'interface' THEN 1 ELSE 5 END)::BIGINT AS score
FROM q WHERE starts_with(low, 'supplier')""",
)
def fuzzy_prefix_search(spark, d):
    g = supply_graph(spark, d)
    return search.fuzzy_search(g.nodes.where("kind <> 'struct'"), "supplier").where("match IN ('exact', 'prefix')")


@query(
    "fuzzy_search_top",
    f"""WITH {SUPPLY_SQL}, q AS (SELECT *, lower(name) AS low, strpos(lower(name), 'order12') - 1 AS loc FROM nodes),
m AS (SELECT *, CASE WHEN low = 'order12' THEN 'exact' WHEN starts_with(low, 'order12') THEN 'prefix' WHEN loc >= 0 THEN 'substring' WHEN levenshtein(low, 'order12') <= 2 THEN 'fuzzy' END AS match FROM q),
c AS (SELECT *, CASE WHEN exported THEN 0 ELSE 20000 END AS context FROM m WHERE match IS NOT NULL)
SELECT id, name, match, (CASE WHEN match = 'exact' THEN context ELSE CASE match WHEN 'prefix' THEN 1 WHEN 'substring' THEN 3 ELSE 4 END * 100000 + context
  + CASE WHEN match = 'substring' AND loc > 0 THEN least(99, loc * 100 // length(name)) ELSE 0 END * 100 + least(99, abs(length(name) - 7)) * 10 + CASE kind WHEN 'function' THEN 0 WHEN 'interface' THEN 1 WHEN 'struct' THEN 1 ELSE 5 END END)::BIGINT AS score
FROM c ORDER BY score, id LIMIT 50""",
)
def fuzzy_search_top(spark, d):
    return search.fuzzy_search(supply_graph(spark, d).nodes, "Order12", 50)


_TERMS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query(
    "bm25_benchmark",
    f"""WITH own AS (SELECT doc_id, list_distinct({_TERMS}) AS terms FROM documents), size AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM own),
post AS (SELECT doc_id, len(terms) AS l, unnest(terms) AS term FROM own), asked AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT query_id, doc_id, sum((ln((n + 1) / (df + 1)) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / mean))) AS raw FROM asked JOIN post USING (term) JOIN df USING (term), size GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM raw""",
)
def bm25_benchmark(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(docs, asked).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "bm25_top",
    f"""WITH own AS (SELECT doc_id, list_distinct({_TERMS}) AS terms FROM documents), size AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM own),
post AS (SELECT doc_id, len(terms) AS l, unnest(terms) AS term FROM own), asked AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT query_id, doc_id, sum((ln((n + 1) / (df + 1)) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * l / mean))) AS raw FROM asked JOIN post USING (term) JOIN df USING (term), size GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM raw QUALIFY rank <= 10""",
)
def bm25_top(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_top(docs, asked, 10).withColumn("score", F.round("score", 6))


@query(
    "ucb1_event_types",
    """WITH p AS (SELECT event_type AS arm, count(*) AS plays, avg(value) AS mean FROM events GROUP BY event_type), t AS (SELECT count(*) AS n FROM events)
SELECT arm, plays, round(mean, 6) AS mean, round(mean + sqrt(2) * sqrt(ln(n) / plays), 6) AS score FROM p, t""",
)
def ucb1_event_types(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("arm"), F.col("value").alias("reward"))
    return search.ucb1(e).select("arm", "plays", F.round("mean", 6).alias("mean"), F.round("score", 6).alias("score"))


@query(
    "cosine_to_first_vector",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), z AS (SELECT e AS q FROM v WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM v, z""",
)
def cosine_to_first_vector(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(sim.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query(
    "nearest_vectors",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (
SELECT a.id AS query, b.id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rn FROM p)
SELECT query, id, round(s, 6) AS similarity FROM r WHERE rn <= 10""",
)
def nearest_vectors(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return sim.nearest(v, v.where("id % 100 = 0"), 10).select("query", "id", F.round("similarity", 6).alias("similarity"))


_FILTERED_SQL = """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (
SELECT a.id AS query, b.id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0 AND b.label < 4),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rn FROM p)
SELECT query, id, round(s, 6) AS similarity FROM r WHERE rn <= 10"""


def _indexed(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, vector_index.build_index(v)


@query("vector_index_exact", _FILTERED_SQL)
def vector_index_exact(spark, d):
    """The ten nearest vectors of some labels, by an index whose cells are ruled out by their reach."""
    v, index = _indexed(spark, d)
    return vector_index.search(index, v.where("id % 100 = 0"), 10, where=F.col("label") < 4, exact=True).select("query", "id", F.round("similarity", 6).alias("similarity"))


@query("vector_index_search")
def vector_index_search(spark, d):
    """The ten nearest vectors from as many cells as reach a measured recall of .95."""
    v, index = _indexed(spark, d)
    probes, _ = vector_index.choose_probes(index, v, 0.95)
    return vector_index.search(index, v.where("id % 100 = 0"), 10, probes)


@query(
    "part_name_jaccard",
    """WITH p AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand) AS first, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 9) AS similarity FROM p x JOIN p y ON x.first = y.id WHERE x.id <> y.id""",
)
def part_name_jaccard(spark, d):
    """Each part with the first of its brand."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), "p_brand", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    first = p.groupBy("p_brand").agg(F.min_by(F.struct("id", "w"), "id").alias("f"))
    return p.join(first, "p_brand").where("id <> f.id").select(F.col("id").alias("a"), F.col("f.id").alias("b"), F.round(sim.jaccard(F.col("w"), F.col("f.w")), 9).alias("similarity"))


@query("clone_pairs")
def clone_pairs(spark, d):
    return sim.clones(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))


_SHINGLES = "list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))"


@query(
    "similar_documents",
    rf"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, {_SHINGLES} AS g FROM t WHERE len(w) > 0),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s), m AS (SELECT a.doc_id AS query, b.doc_id AS id, a.n AS x, b.n AS y, count(*) AS shared FROM p a JOIN p b USING (gram) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)
SELECT query, id, round(shared / (x + y - shared), 9) AS similarity FROM m WHERE shared >= 0.8 * (x + y - shared) - 1e-9""",
)
def similar_documents(spark, d):
    """Documents whose id is divisible by 100, against all."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return sim.similar_texts(t, t.where("id % 100 = 0")).withColumn("similarity", F.round("similarity", 9))


@query("color_histogram_sessions")
def color_histogram_sessions(spark, d):
    g = session_graph(spark, d)
    return sim.color_histogram(sim.color_refinement(g.nodes.select("id", F.col("name").alias("label")), g.edges, None))


@query(
    "motif_triangles",
    f"""WITH {SESSION_SQL}, e AS (SELECT DISTINCT src, dst FROM edges)
SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst""",
)
def motif_triangles(spark, d):
    return sim.motif(session_graph(spark, d).edges, [("x", "y"), ("y", "z"), ("z", "x")])


@query("query_terms_conversations")
def query_terms_conversations(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", search.query_terms(F.col("text")).alias("terms"))


@query(
    "memory_scores",
    """SELECT event_id, round(0.3 * least(value / 100, 1) + 0.2 * exp(-(date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 86400.0) / 30) + 0.5 * (user_id % 10) / 10.0, 9) AS score FROM events""",
)
def memory_scores(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    age = (F.lit("2024-01-31").cast("timestamp").cast("long") - F.date_trunc("second", "ts").cast("long")) / 86400.0
    return e.select("event_id", F.round(search.memory_score(F.least(F.col("value") / 100, F.lit(1)), age, F.pmod("user_id", F.lit(10)) / 10.0, F.lit(1.0)), 9).alias("score"))


@query("packed_context")
def packed_context(spark, d):
    g = supply_graph(spark, d)
    hits = search.fuzzy_search(g.nodes, "Customer#00").join(g.nodes.select("id", "kind"), "id")
    items = hits.select(F.lit("q").alias("query_id"), "id", search.packing_score(F.col("match"), F.lit(0), F.col("kind")).alias("score"), search.estimate_tokens(F.col("name")).alias("tokens"))
    return search.pack_greedy(items, 100)
