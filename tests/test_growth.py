"""Plans whose cost must grow no faster than their input, and results that stay the same."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import search
from graphloom.operators import analytics, code, dyadic, explore, impact, project, similarity, structural
from graphloom.sources.graphs import EDGE_COLUMNS, NODE_COLUMNS, CodeGraph


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_query_terms_are_worked_out_once(spark):
    """The words of a text were cut anew for each use of them, and for each pair."""
    text = " ".join(f"pkg{i}/camelCase{i}" for i in range(3000))
    terms = spark.createDataFrame([(text,), ("a/",), (None,)], "t string").select(search.query_terms(F.col("t")).alias("terms"))
    assert optimized(terms).count("regexp_extract_all") == 2
    long, short, none = (x["terms"] for x in terms.collect())
    assert {"pkg7/camelcase7", "camelcase7", "pkg7", "camel", "case7", "pkg7/camelcase7 pkg8/camelcase8"} <= set(long) and short == [] and none is None
    assert sum(" " in w for w in long) == 2999


def test_best_of_search_joins_documents_with_questions_alone(spark, monkeypatch):
    """Candidates were joined with all postings by document, a table that Spark took for small."""
    plans = []
    write = search.write_table
    monkeypatch.setattr(search, "write_table", lambda df, *a: plans.append(optimized(df)) or write(df, *a))
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} the") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the w1 w2"), (2, "w5")], "query_id long, text string")
    assert search.bm25_top(docs, asked, 3).count() == 6
    assert plans and not any(re.search(r"Join .*doc_id", p) for p in plans)


def test_scores_are_not_shuffled_again_to_be_scaled(spark):
    """Pairs, of which there are many more than documents, were dealt by query to meet its best score."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} the") for i in range(50)], "doc_id long, text string")
    found = search.bm25(docs, spark.createDataFrame([(1, "the w1 w2"), (2, "w5")], "query_id long, text string"))
    assert "hashpartitioning(query_id" not in physical(found)
    rows = found.collect()
    assert len(rows) == 57 and {q: max(r["score"] for r in rows if r["query_id"] == q) for q in (1, 2)} == {1: 1.0, 2: 1.0}


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_never_broadcast(spark):
    """Ranges fall into dozens of nodes each, which Spark doesn't see in the size of their table."""
    v = spark.createDataFrame([(p, p % 5) for p in range(40)], "pos long, value long")
    r = spark.createDataFrame([(3, 20), (0, 39), (25, 24)], "lo long, hi long")
    u = spark.createDataFrame([(0, 9, 2), (5, 30, 1)], "lo long, hi long, delta long")
    nodes, lazy = dyadic.dyadic_nodes(v, 6), dyadic.lazy_updates(u, 6)
    found = [dyadic.updated_sums(nodes, lazy, r, 6), dyadic.range_aggregate(nodes, r, 6), dyadic.updated_values(v, lazy, 6)]
    assert not any("BroadcastHashJoin" in physical(x) for x in found)
    now = {p: p % 5 + 2 * (p < 10) + (5 <= p <= 30) for p in range(40)}
    want = {(lo, hi): (max(0, hi - lo + 1), sum(now[p] for p in range(lo, hi + 1)) if lo <= hi else None) for lo, hi in [(3, 20), (0, 39), (25, 24)]}
    assert {(x["lo"], x["hi"]): (x["n"], x["sum"]) for x in found[0].collect()} == want


def small_graph(spark):
    nodes = spark.createDataFrame([(i, i, "function", p, p + "/f.go", 1, 1, True, "go") for i, p in [("a", "x"), ("b", "y"), ("c", "z"), ("d", "x")]], ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, ["string"] * 5 + ["int", "int", "boolean", "string"], strict=True)))
    edges = spark.createDataFrame([(a, b, "calls", "", 1) for a, b in [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "gone"), ("lost", "b"), (None, "b")]], ", ".join(f"{c} {t}" for c, t in zip(EDGE_COLUMNS, ["string"] * 4 + ["int"], strict=True)))
    return CodeGraph(nodes, edges)


def seen_by(monkeypatch, module, name, at=0):
    """Plans of the edges that ``module`` gives its loop."""
    plans, loop = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: plans.append(optimized(a[at])) or loop(*a, **k))
    return plans


def test_cycle_takes_dependencies_once(spark, monkeypatch):
    """Each step worked out the dependencies of packages from all edges anew."""
    plans = seen_by(monkeypatch, project, "bfs")
    assert project.shortest_cycle(structural.package_dependencies(small_graph(spark)), "x") == ["x", "y", "z", "x"]
    assert plans and not any("Join" in p for p in plans)


def test_package_blast_takes_dependencies_once(spark, monkeypatch):
    plans = seen_by(monkeypatch, explore, "bfs")
    found = explore.package_blast(structural.package_dependencies(small_graph(spark)), "x")
    assert {(r["package"], r["depth"]) for r in found.collect()} == {("z", 1), ("y", 2)}
    assert plans and not any("Join" in p for p in plans)


def test_circular_packages_take_dependencies_once(spark, monkeypatch):
    plans = seen_by(monkeypatch, impact, "strongly_connected")
    assert [tuple(r) for r in impact.circular_dependencies(small_graph(spark), "package").collect()] == [("x", 3, "warning")]
    assert plans and not any("Join" in p for p in plans)


def test_community_summary_folds_edges_once(spark):
    g = small_graph(spark)
    found = analytics.community_summary(g, g.nodes.select("id", F.col("package").alias("community")))
    assert {(r["community"], r["internal"], r["external"]) for r in found.collect()} == {("x", 1, 2), ("y", 0, 2), ("z", 0, 2)}
    assert "src" not in optimized(found)


def test_satisfied_interfaces_by_definition(spark):
    """Every pair of a type and an interface that share a method was counted, once a method."""
    r = random.Random(3)
    types = [(f"t{r.randrange(9)}", r.choice(["go", "ts"]), f"m{r.randrange(6)}") for _ in range(70)] + [("i1", "go", "m1"), ("t0", None, "m1"), ("t1", "go", None)]
    faces = [(f"i{r.randrange(8)}", r.choice(["go", "ts"]), f"m{r.randrange(6)}") for _ in range(18)] + [("i1", "go", "m1"), ("none", "go", "m99"), ("null", "go", None), ("null", "go", "m1")]
    found = code.satisfied_interfaces(spark.createDataFrame(types, "type string, language string, method string"), spark.createDataFrame(faces, "interface string, language string, method string"))
    has = {(t, k, m) for t, k, m in types if k and m}
    want = set()
    for i in {f[0] for f in faces}:
        needs = {m for f, _, m in faces if f == i}
        want |= {(t, i) for t in {x[0] for x in types} if t != i and all(any(f == i and n == m and (t, k, m) in has for f, k, n in faces) for m in needs)}
    assert sorted((r["type"], r["interface"]) for r in found.collect()) == sorted(want) and len(want) > 3
    assert "count(distinct" not in optimized(found)


def test_dangling_edges_are_shuffled_once_an_end(spark):
    """Edges were shuffled or joined three times, and sorted."""
    g = small_graph(spark)
    found = structural.dangling_edges(g)
    assert len(re.findall(r"ShuffledHashJoin|SortMergeJoin|BroadcastHashJoin", physical(found))) == 2 == physical(found).count("ShuffledHashJoin")
    want = [("a", "gone"), ("lost", "b"), (None, "b")]
    assert found.columns == g.edges.columns and sorted(((x["src"], x["dst"]) for x in found.collect()), key=str) == sorted(want, key=str)


def test_ranks_without_cycles_need_two_passes_over_edges(spark, monkeypatch):
    """Each iteration joined all edges anew, though walks end after two of them."""
    written, write = [], analytics.write_table
    monkeypatch.setattr(analytics, "write_table", lambda df, name, *a: written.append(name) or write(df, name, *a))
    r = random.Random(5)
    ids = [f"{k}{i}" for k in "cop" for i in range(12)]
    pairs = [(f"c{r.randrange(12)}", f"o{i}") for i in range(12)] + [(f"o{r.randrange(12)}", f"p{r.randrange(12)}") for _ in range(40)]
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([*pairs, ("o1", "gone"), ("lost", "p1")], "src string, dst string")
    for most in (0, 2, 7, 100):
        got = {x["id"]: x["rank"] for x in analytics.pagerank(CodeGraph(nodes, edges), max_iterations=most, tolerance=1e-6).collect()}
        rank, out = dict.fromkeys(ids, 1 / len(ids)), {}
        every = [*pairs, ("o1", "gone"), ("lost", "p1")]
        for a, _ in every:
            out[a] = out.get(a, 0) + 1
        for _ in range(most):
            sunk = sum(v for k, v in rank.items() if k not in out)
            new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * sunk / len(ids))
            for a, b in every:
                if a in rank and b in new:
                    new[b] += 0.85 * rank[a] / out[a]
            moved, rank = max(abs(new[i] - rank[i]) for i in ids), new
            if moved < 1e-6:
                break
        assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
    assert "pagerank-links" not in written and "pagerank" not in written


def near_texts(spark):
    r = random.Random(2)
    words = [[f"w{r.randrange(60)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(60):
        own = list(words[i % 6])
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            own[r.randrange(60)] = f"v{r.randrange(9)}"
        texts.append((i, "\n".join(" ".join(own[j : j + 10]) for j in range(0, 60, 10))))
    rows = [*texts, (90, None), (91, ""), (92, "\n" * 9), (93, texts[0][1].upper())]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b and sets[a] and sets[b]}
    return spark.createDataFrame(rows, "id long, text string"), sets, {p: s for p, s in alike.items() if s >= 0.8}


def written_types(monkeypatch):
    """Types of the columns that similarity writes."""
    found, write = [], similarity.write_table
    monkeypatch.setattr(similarity, "write_table", lambda df, *a: found.extend(t for _, t in df.dtypes) or write(df, *a))
    return found


def test_clones_shuffle_no_shingles(spark, monkeypatch):
    """Sets of shingles, several times as long as their texts, were written twice and shuffled for each pair."""
    types = written_types(monkeypatch)
    df, sets, alike = near_texts(spark)
    found = similarity.clones(df)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    lead = set(first.values())
    want = {(a, b): s for (a, b), s in alike.items() if a < b and a in lead and b in lead} | {(first[frozenset(s)], i): 1.0 for i, s in sets.items() if s and first[frozenset(s)] != i}
    assert {(x["a"], x["b"]): x["similarity"] for x in found.where("similarity >= 0.8").collect()} == want and len(want) > 20
    assert types and not {"array<string>", "string"} & set(types)
    assert "grams" not in optimized(found) and "signature" not in optimized(found)


def written_rows(monkeypatch):
    """Numbers of rows that similarity writes."""
    found, write = [], similarity.write_table

    def counted(df, *a):
        out = write(df, *a)
        found.append(out.count())
        return out

    monkeypatch.setattr(similarity, "write_table", counted)
    return found


def family(n):
    """Texts of which any two share about a third of their shingles, and brute force's similarities."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(f"x{i}y{k}" if k in at else w + ("\n" if k % 20 == 0 else "") for k, w in enumerate(base)) for i in range(n) for at in [set(r.sample(range(120), 5))]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    return texts, {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a != b}


def test_clones_write_no_pair_that_is_none(spark, monkeypatch):
    """Each pair that shared a band was written and shuffled with both its texts: a family of m texts cost m * m texts, alike or not."""
    rows = written_rows(monkeypatch)
    texts, alike = family(60)
    some = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert sum(s >= 0.6 for s in alike.values()) < 300 < sum(0.3 < s < 0.6 for s in alike.values())
    found = similarity.clones(some, 0.5)
    assert {(x["a"], x["b"]): x["similarity"] for x in found.where("similarity >= 0.5").collect()} == {p: s for p, s in alike.items() if s >= 0.5 and p[0] < p[1]}
    rows.clear()
    similarity.clones(some)
    assert max(rows) <= 60 * 6


def test_blocks_of_a_component_meet(spark, monkeypatch):
    """Components of many blocks give the pairs of brute force, one way round."""
    monkeypatch.setattr(similarity, "BLOCK_RUNS", 4000)
    texts, alike = family(40)
    some = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = similarity.clones(some, 0.4).collect()
    assert len(found) == len({(x["a"], x["b"]) for x in found})
    assert {(x["a"], x["b"]): x["similarity"] for x in found} == {p: s for p, s in alike.items() if s >= 0.4 and p[0] < p[1]}
    close = {(x["query"], x["id"]): x["similarity"] for x in similarity.similar_texts(some, some.where("id % 4 = 0"), 0.4).collect()}
    assert close == {p: s for p, s in alike.items() if s >= 0.4 and p[0] % 4 == 0} and len(close) > 50


def test_word_runs_are_the_shingles(spark):
    """Hashed runs are as many as the shingles, of odd texts too."""
    odd = ["", " ", None, "a", "a b c d", "a b c d e", "A\tb\x0bc\nd\re\x0cf", "a\u00a0b c\u2003d e f g", "ÄÖ ß İ x y z Ä", "a a a a a a a a", "b a a a a a a", " a  b "]
    df = spark.createDataFrame(list(enumerate(odd)), "id int, text string")
    want = {x["id"]: x["n"] for x in df.select("id", F.size(similarity.token_shingles(F.col("text"), 5)).alias("n")).collect()}
    got = similarity.sketched(df, 5, 8, 4).collect()
    assert {x["id"]: x["size"] for x in got} == want and all(len(x["bands"]) == (4 if x["size"] else 0) for x in got)
    assert len({x["key"] for x in got}) == len(odd) - 2


def test_similar_texts_write_no_shingles(spark, monkeypatch):
    """Sets of shingles as strings, several times as long as their texts, were written and shuffled, and hashed 128 times by expressions."""
    types = written_types(monkeypatch)
    df, sets, alike = near_texts(spark)
    found = similarity.similar_texts(df, df.where("id % 3 = 0"))
    pairs = {(x["query"], x["id"]): x["similarity"] for x in found.collect()}
    same = {(a, b): 1.0 for a in sets for b in sets if a != b and sets[a] and sets[a] == sets[b]}
    want = {p: s for (a, b), s in (alike | same).items() for p in ((a, b), (b, a)) if p[0] % 3 == 0}
    assert pairs == want and len(want) > 10
    assert types and not {"array<string>", "string"} & set(types)


def test_texts_in_many_parts_are_not_dealt_anew(spark):
    """All texts were shuffled before they were cut, however many files they came in."""
    few, many = (spark.range(0, 100, 1, n).select("id", F.lit("a b").alias("text")) for n in (1, 64))
    assert "RepartitionByExpression" in optimized(similarity.dealt(few)) and "Repartition" not in optimized(similarity.dealt(many))
