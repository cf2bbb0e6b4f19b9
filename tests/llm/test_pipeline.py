"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import decontam, ngram_join
from graphloom.llm.common import every
from graphloom.plans.tables import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = write_table(stage(spark, docs, sf), name)
        assert out.columns == COLUMNS
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        docs = out
    assert kept["quality_rules"] >= kept["ngram_join"] >= kept["decontamination"] == kept["mixing"]
    assert 0.5 * before < len(kept["quality_rules"]) < before
    found = ngram_join.ngram_jaccard_join(docs.dropDuplicates(["doc_id"]))
    assert found.where("class_id <> doc_id").isEmpty()
    hit = decontam.find_contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert hit.where("n_hit > 0 AND 20 * n_hit >= n_words").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_odd_rows(spark, sf):
    """Nulls everywhere, repeated ids and rows, empty and long texts, and columns whose names clash with those inside."""
    from pyspark.sql import functions as F
    from tests_llm_helpers import make_text

    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").first()["text"]
    base = make_text(40, 90)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (2, make_text(41, 90), "en", "b"), (None, make_text(42, 90), "en", "a"), (3, None, "en", "a"), (4, "", None, "a"),
        (5, make_text(43, 30_000), "fr", "b"), (6, item + " " + make_text(47, 60), "en", "b"), (7, make_text(44, 2000) + " " + item + " " + make_text(45, 2000), "en", "b"), (8, "same " * 80, "en", "a"), (9, make_text(46, 90) + "\n\tx", "de", ""),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("__x", "__row", "mark", "in_0", "__block", "row", "gone", "key", "tokens", "a.b", "x`y", "mix_tokens", "mix_pos", "c0"):
        docs = docs.withColumn(name, F.lit(1))  # a stage gives them back as they are
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = write_table(stage(spark, docs, sf), name)
        assert out.columns == docs.columns, name
        assert all(v == 1 for r in out.select(*every(out)[5:]).collect() for v in r), name
        docs = out
        kept.append(sorted((r["doc_id"] or 0, r["text"][:20]) for r in out.select("doc_id", "text").distinct().collect()))
    good = [0, 1, 2, 5, 6, 7, 9]
    assert [i for i, _ in kept[0]] == sorted([*good, 2]) and [i for i, _ in kept[1]] == good
    assert [i for i, _ in kept[2]] == [0, 1, 2, 5, 7, 9] == [i for i, _ in kept[3]]
    cut = docs.where("doc_id = 7").first()
    assert item[:60] not in cut["text"] and cut["n_chars"] == len(cut["text"])
    digest = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert digest.count() == docs.count()


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs, sf).collect()


def test_many_rows_of_one(spark):
    """A row that stands thousands of times in a class with a near copy is compared once."""
    from tests_llm_helpers import make_text

    base = make_text(60, 80)
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(base.split()))
    rows = [(1, base)] * 3000 + [(2, near)] * 2 + [(3, make_text(61, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_join(docs).groupBy("doc_id", "class_id", "n_copies", "n_links").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3000, 1, 3000), (2, 1, 2, 1, 2), (3, 3, 1, 0, 1)]
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [1, 3]
