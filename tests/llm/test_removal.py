"""Removal of benchmark passages from texts that stay."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import decontam
from tests_llm_helpers import make_text


def test_remove_spans(spark):
    item = make_text(50_001, 60).split()[:40]
    rest = [w for w in make_text(3, 4000).split() if w not in item][:2000]
    docs = [
        (1, " ".join(rest[:900]) + ' "' + " ".join(item).upper() + '".\n\nNext ' + " ".join(rest[900:])),
        (2, " ".join(item + rest)),
        (3, " ".join(rest + item)),
        (4, " ".join(item + rest[:100])),  # covered by more than a twentieth
        (5, " ".join(rest[:500] + item[:20] + item + item[20:] + rest[500:])),  # what the cuts join is a passage again or over the share
        (6, " ".join(rest)),
        (7, " ".join(rest[:500] + ["Qq", "zz"] + rest[500:])),  # a short item stays
        (8, None),
        (9, "\u00e9 " + " ".join(rest[:950]) + " \u00e8 " + " ".join(item) + " \u00fc"),
    ]
    d = spark.createDataFrame([(i, t, i * 10) for i, t in docs], "doc_id long, text string, other int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "qq zz"), (3, "")], "item_id long, text string")
    want = {i: t for i, t in docs if i != 4}
    want[1] = " ".join(rest[:900]) + ' "".\n\nNext ' + " ".join(rest[900:])
    want[2] = want[3] = " ".join(rest)
    want[5] = " ".join(rest)
    want[9] = "\u00e9 " + " ".join(rest[:950]) + " \u00e8 \u00fc"
    for block in (5, 10_000):
        out = decontam.remove_spans(d, bench, block_words=block)
        assert out.columns == d.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert {i: (r["text"] or "").rstrip() for i, r in got.items()} == {i: (t or "").rstrip() for i, t in want.items()}
        assert got[8]["text"] is None and all(r["other"] == 10 * i for i, r in got.items())
        left = decontam.find_contamination(out, bench).where("n_hit > 0").collect()
        assert [(r["doc_id"], r["n_hit"]) for r in left] == [(7, 2)]
    assert decontam.remove_spans(d, bench.limit(0)).count() == d.count()


def test_stage_leaves_no_window(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    long = " ".join(make_text(3, 3000).split()[:2000]) + " "
    passage = max((r["text"] for r in bench.collect()), key=lambda t: len(t.split()))
    one = docs.limit(1).collect()[0].asDict() | {"text": long + " ".join(passage.split()[:40]), "doc_id": 10**9}
    docs = docs.unionByName(spark.createDataFrame([tuple(one[c] for c in docs.columns)], docs.schema))
    out = corpus_pipeline.decontaminate(spark, docs, sf)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()}
    assert decontam.find_contamination(out, bench).where("exists(spans, s -> s[1] - s[0] > 12)").isEmpty()
    assert out.where("n_chars <> length(text)").isEmpty() and not out.where(f"doc_id = {10**9}").isEmpty()
