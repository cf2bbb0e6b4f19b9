"""Operators over small tables: against brute force, and on nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontam, html_extract, line_dedup, mixing, ngram_join, pii_crf, quality_mil, quality_rules, queries, token_orc, url_filter
from graphloom.llm.common import WORD_TABLE, shingles
from tests_llm_helpers import brute_groups, make_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `__spans` string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    base = make_text(3, 120)
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n "), (7, "one two"), (7, "one two"), (8, "one two"),
        (None, base + " tail"), (9, "a\nb\nc\nd\n" + make_text(4, 60)), (10, "x\na\nb\nc\ny"), (11, "long " * 50_000), (12, make_text(9, 80)),
    ]
    return spark.createDataFrame([(i, t, None if i == 12 else "en", None if i == 4 else "s1", 0, "k", "s", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (9, 1), (9, None), (None, 1), (99, 0), (12, 1)], "doc_id long, quality int")


def test_join_against_brute_force(spark):
    rows = []
    for g in range(6):
        base = make_text(g, 80).split()
        for k in range(8):
            w = list(base)
            for j in range(k // 2):
                w[(j * 17 + k * 5) % len(w)] = f"new{k}{j}"
            rows.append((g * 10 + k, " ".join(w)))
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, groups, copies = brute_groups(rows)
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert {i: r["class_id"] for i, r in got.items()} == groups
    assert {i: r["copy_id"] for i, r in got.items()} == copies


def test_join_in_blocks_finds_the_same(spark, monkeypatch):
    rows = [(i, " ".join(w if j != i % 40 else f"v{i}" for j, w in enumerate(make_text(1, 60).split()))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.ngram_jaccard_join(df).collect()}
    links, groups, _ = brute_groups(rows)
    assert got == {i: (links[i], groups[i]) for i in links}


def test_join_edges(docs, nothing):
    got = collections.defaultdict(list)
    for r in ngram_join.ngram_jaccard_join(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == docs.count()
    assert got[1][0]["class_id"] == got[2][0]["class_id"] == got[3][0]["class_id"] == 1 and got[3][0]["copy_id"] == 3
    assert [r["class_id"] for r in got[4] + got[5] + got[6]] == [4, 5, 6]
    assert {r["class_id"] for r in got[7] + got[8]} == {7} and got[7][0]["n_copies"] == 3
    assert not ngram_join.ngram_jaccard_join(nothing).collect()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(7) == 1 and 2 not in ids and 3 not in ids and 8 not in ids and {1, 4, 5, 6} <= set(ids)


def test_rules(docs, nothing, labels):
    out = quality_rules.quality_rules(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # so few labels certify nothing
    good = quality_rules.keep_good(docs, labels)
    assert good.columns == docs.columns and {1, 2, 3, 9, 12} <= {r["doc_id"] for r in good.collect()}
    assert not quality_rules.keep_good(nothing, labels).collect()
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == docs.count()


def test_rules_reject_what_labels_support(spark):
    good = [(i, make_text(i, 60), "en") for i in range(3000)]
    bad = [(5000 + i, " ".join(w + "###" for w in make_text(i, 60).split()), "en") for i in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    lab = d.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    out = quality_rules.quality_rules(d, lab).groupBy((F.col("doc_id") < 5000).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    shares = {r["good"]: r["kept"] for r in out}
    assert shares[True] == 1.0 and shares[False] == 0.0


def test_kept_against_brute_force(spark):
    """The whole verdict by definition: halves, chosen and certified cutoffs, and each document's own shares."""
    import random

    r, rows, lab = random.Random(3), [], []
    for i in range(4000):
        w = make_text(i, 55).split()
        if i % 10 == 0:
            w = [x + "##" if r.random() < 0.3 + 0.7 * (i % 20 == 0) else x for x in w]
        rows.append((i, " ".join(w), r.choice(["en", "fr", None])))
        lab.append((i, int(i % 10 > 0)))
    rows += rows[:7] * 30  # repeated rows count once
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter((x["doc_id"], x["kept"]) for x in quality_rules.quality_rules(d, spark.createDataFrame(lab, "doc_id long, quality int")).collect())
    half = {x[0]: x[1] for x in d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2))).collect()}
    shares, stats = {}, {}
    for i, t, lang in rows:
        s = dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"], quality_rules.text_stats(t.encode()), strict=True))
        stats[i] = ("other" if lang is None else lang, s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"])
        shares[i] = {"symbol_share": s["n_symbols"] / s["word_chars"], "dup_line_share": s["n_dup_lines"] / s["n_lines"], "repeat_share": s["n_repeat_words"] / s["n_words"], "upper_share": s["n_upper"] / s["word_chars"]}
    cut, chosen = {}, {}
    own = lambda s, q, h: [i for i, k in lab if k == q and half[i] == h and stats[i] == (s, False)]
    for s in ("de", "en", "es", "fr", "other"):
        for rule in quality_rules.RULES:
            best = 0.0
            good, bad = own(s, 1, 0), own(s, 0, 0)
            for c in quality_rules.GRID:
                fp, tp = (sum(shares[i][rule] > c for i in x) / max(1, len(x)) for x in (good, bad))
                if good and bad and fp <= 0.02 and tp - 10 * fp > best + 1e-12:
                    best, chosen[s, rule] = tp - 10 * fp, c
    for (s, rule), last in chosen.items():
        good = own(s, 1, 1)
        for c in quality_rules.GRID:
            fp = sum(shares[i][rule] > c for i in good)
            if c < last or quality_rules.binomial_tail(fp, len(good), 0.02 / sum(x == s for x, _ in chosen)) > 0.05 / len(chosen):
                break
            cut[s, rule] = c
    want = collections.Counter((i, not stats[i][1] and not any(s == stats[i][0] and shares[i][rule] > c for (s, rule), c in cut.items())) for i, _, _ in rows)
    assert got == want and cut and any(not k for _, k in got)


def test_decontamination(spark, docs, nothing):
    item = " ".join(make_text(3, 120).split()[10:40])
    bench = spark.createDataFrame([(1, item), (2, "one TWO"), (3, None), (4, ""), (None, "x"), (5, item)], "item_id long, text string")
    rows = collections.defaultdict(list)
    for r in decontam.find_contamination(docs, bench).collect():
        rows[r["doc_id"]].append(r)
    assert rows[1][0]["n_hit"] == 30 and rows[1][0]["items"] == ["1", "5"] and rows[1][0]["spans"] == [[10, 40]]
    assert rows[7][0]["n_hit"] == 2 and len(rows[7]) == 2 and rows[4][0]["n_words"] == rows[5][0]["n_words"] == 0
    assert rows[11][0]["n_words"] == 50_000
    small = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.find_contamination(docs.where("doc_id <> 7"), bench, block_words=5).collect()}
    assert small == {i: (r[0]["n_hit"], r[0]["items"]) for i, r in rows.items() if i is not None and i != 7}
    for block, d in ((5, docs), (10_000, docs), (5, docs.withColumn("__row", F.lit(1)).withColumn("row", F.lit(2)))):
        kept = decontam.keep_clean(d, bench, block_words=block)
        assert kept.columns == d.columns
        assert decontam.remove_spans(d, bench, block_words=block).columns == d.columns
        kept = kept.select(docs.columns)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [4, 5, 6, 9, 10, 11, 12]
    assert decontam.keep_clean(docs, bench.limit(0)).count() == docs.count()
    assert not decontam.find_contamination(nothing, bench).collect()


def test_line_dedup(docs, nothing):
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect() if r["doc_id"] != 7}
    assert rows[10]["text"] == "x\ny" and rows[10]["n_removed"] == 3 and rows[9]["n_removed"] == 0
    assert rows[2]["text"] == "" and rows[2]["n_removed"] == 1 and rows[1]["n_removed"] == 0
    assert rows[4]["text"] == "" and rows[6]["text"] == "   \n " and rows[8]["n_removed"] == 1
    assert rows[None]["n_removed"] == 0
    assert not line_dedup.line_dedup(nothing).collect()


def test_tokens_round_trip(spark, docs, nothing, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_orc.write_tokens(docs, queries.tokenizer_path(), path)
    rows = token_orc.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == docs.count()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    for r in token_orc.token_digest(token_orc.read_tokens(spark, path)).collect():
        own = [x for x in rows if x["start"] == r["start"] and x["n_tokens"] == r["n_tokens"]][0]
        assert r["ids_crc32"] == zlib.crc32(np.array(own["ids"], "<u4").tobytes())
    assert [len(r["ids"]) for r in token_orc.find_document(spark, path, 7).collect()] == [3, 3]
    assert not token_orc.tokenize_to_orc(nothing, queries.tokenizer_path()).collect()


def test_mixing(spark, docs, nothing):
    rows = [(i, "big" if i < 400 else "small" if i < 440 else None, "a b c d") for i in range(460)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(d, max_repeats=2.0).collect()
    n = collections.Counter(r["doc_id"] for r in out)
    assert set(n) == set(range(460)) and max(n.values()) == 2
    by = collections.Counter(r["mix_source"] for r in out)
    # the smallest source is used twice over; weights are powers of the shares
    assert by["big"] == 400 and by[""] == 40 and 40 <= by["small"] <= 80
    assert all(0 <= r["mix_pos"] < 1 for r in out)
    again = mixing.mix_sources(d, max_repeats=2.0).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    half = mixing.mix_sources(d, max_repeats=None, target_entropy=None, budget=4 * 230.0).collect()
    assert abs(collections.Counter(r["mix_source"] for r in half)["big"] - 200) <= 1
    edge = mixing.mix_sources(docs)
    assert {r["doc_id"] for r in edge.collect()} == {r["doc_id"] for r in docs.collect()}
    assert [c for c in edge.columns if not c.startswith("mix_")] == docs.columns
    assert not mixing.mix_sources(nothing).collect()


def test_entropy_target(spark):
    d = spark.createDataFrame([(900,), (90,), (10,)], "tokens long")
    e, total, _ = mixing.temperature(d, target_entropy=0.9)
    w = [t**e / total for t in (900, 90, 10)]
    assert -sum(x * np.log(x) for x in w) == pytest.approx(0.9, abs=1e-6) and 0 < e < 1


def test_url_filter(spark):
    urls = ["https://A.example.ORG/es/1?x", "http://example.org/en/12", "https://x.com/fr/a", "x.com/de/", None, "http://y.com/de/#", "ftp://org", "http://org/", "http://", "a://b.org?q=/es/", "https://m.spam-farm.example.com/en/1"]
    p = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.rule_table(spark, queries.URL_ALLOW, queries.URL_BLOCK)
    method = url_filter.rule_table(spark, [], queries.URL_BLOCK_LIST)
    rows = url_filter.filter_urls(p, rules, method).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 12
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("com/fr/", "allow")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("y.com", "/de/", "com/de/", "block") and got[6] == ("org", "", None, "allow")
    assert got[7][2:] == ("org/", "allow") and got[8] == ("", "", None, "allow") and got[9] == ("b.org", "", None, "allow")
    assert got[10][2:] == (None, "block")
    assert url_filter.filter_urls(p, rules.limit(0)).where("verdict = 'allow'").count() == 12
    assert not url_filter.filter_urls(p.limit(0), rules).collect()


def test_url_filter_with_many_rules_and_long_urls(spark, monkeypatch):
    """Rules beyond the size that is sent to every executor join by shuffle, with equal results."""
    hosts = spark.range(400).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.net/a")).alias("rule"), F.lit("block").alias("verdict"))
    urls = [(i, f"https://www.h{i}.example.net/{'a' if i % 2 else 'b'}{'x' * (i % 7)}") for i in range(500)] + [(900, "http://" + "s." * 3000 + "h1.example.net/a" + "y" * 100_000), (901, "http://" + "." * 50 + "/"), (None, None)]
    p = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("full", F.lit("clash"))
    want = {i: "block" if u and (i == 900 or i < 400 and i % 2) else "allow" for i, u in urls}
    for most in (1_000_000, 10):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(p, hosts).collect()} == want


def test_classifier(spark, docs, nothing, labels, sf):
    out = quality_mil.quality_scores(docs, labels)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert not quality_mil.quality_scores(nothing, labels).collect()
    assert {r["score"] for r in quality_mil.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_classifier_bounds_and_ties(spark):
    """Repeated rows of a labelled id don't weigh more, bytes are bounded, equal texts have equal scores."""
    rows = [(i, make_text(i, 40) if i % 2 else "## " * 30 + str(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    many = d.unionByName(d.where("doc_id IN (1, 2, 3)")).unionByName(d.where("doc_id = 1")).withColumn("quality", F.lit("clash"))
    once = {r["doc_id"]: r["score"] for r in quality_mil.quality_scores(d, lab).collect()}
    got = quality_mil.quality_scores(many, lab).collect()
    assert len(got) == 44 and all(r["score"] == once[r["doc_id"]] for r in got)
    small = quality_mil.train(d, lab, max_bytes=5 * 4 * quality_mil.N_FEATURES)
    assert set(small.p) == {"W", "b", "V", "U", "w", "c", "d"}
    same = quality_mil.quality_scores(d.select("doc_id", F.lit("one text").alias("text")), lab).select("score").distinct()
    assert same.count() == 1


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    scored = queries.op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_personal_data(docs, nothing):
    rows = pii_crf.find_personal_data(docs).collect()
    assert len(rows) == docs.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if not r["spans"])
    assert not pii_crf.find_personal_data(nothing).collect()


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", "<article><p>a"), (1, "u", "<article><p>a"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_extract.extract_pages(p).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]


def test_minhash_recall(spark):
    r = np.random.default_rng(2)
    mul, add = ngram_join._seeds(470)
    miss = 0
    for _ in range(60):
        a = r.integers(0, 1 << 63, 400).astype(np.uint64)
        b = np.concatenate([a[:356], r.integers(0, 1 << 63, 44).astype(np.uint64)])
        x, y = (ngram_join.minhash(np.unique(s), mul, add).reshape(47, 10) for s in (a, b))
        miss += not (x == y).all(axis=1).any()
    assert miss <= 2  # similarity .80: 1 in 200


def test_shingle_kernel_on_documents(spark, sf):
    t = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert len(shingles([x.encode().translate(WORD_TABLE) for x in t])) == len(t)


@pytest.fixture(scope="module")
def repeated_ids(spark):
    """Rows of one id with equal and with different texts, copies and near copies under other ids, nulls and clashing names."""
    a, d = make_text(21, 80), make_text(22, 80)
    near = " ".join(w if i != 40 else "changed" for i, w in enumerate(a.split()))
    rows = [
        (1, a), (5, a), (5, near), (5, make_text(23, 80)), (7, make_text(24, 80)), (7, d), (7, d), (7, d), (9, d), (None, d), (None, make_text(25, 80)),
        (None, make_text(25, 80)), (3, None), (3, ""), (3, ""), (4, near + " "), (2, make_text(26, 3)), (2, make_text(26, 3)),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `mark` string, `__x` string, `__row` string, gone int"
    return spark.createDataFrame([(i, t, "en", "s", k, "m", f"x{k}", "r", 1) for k, (i, t) in enumerate(rows)], schema)


def brute_keep_one(rows):
    """By definition: classes of distinct (id, text) rows linked by equal or similar shingle sets; one row of each class, all without words."""

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    left = list(dict.fromkeys(r for r in rows if grams(r[1])))
    kept = [r for r in rows if not grams(r[1])]
    while left:
        group = [left.pop()]
        for r in group:
            g = grams(r[1])
            near = [x for x in left if len(g & grams(x[1])) >= 0.8 * len(g | grams(x[1]))]
            group += near
            left = [x for x in left if x not in near]
        low = min(((r[0] is None, r[0] or 0) for r in group))
        kept.append([r for r in group if (r[0] is None, r[0] or 0) == low])
    return kept


def test_keep_one_row_of_each_class(repeated_ids):
    rows = [(r["doc_id"], r["text"]) for r in repeated_ids.collect()]
    out = ngram_join.keep_one(repeated_ids)
    assert out.columns == repeated_ids.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = brute_keep_one(rows)
    assert len(got) == len(want)
    for w in want:
        options = w if isinstance(w, list) else [w]
        hit = next(g for g in got if g in options)
        got.remove(hit)
    assert not got


def test_sets_of_one_short_key_are_told_apart(spark, monkeypatch):
    rows = [(i, make_text(30 + i // 2, 60)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    features = ngram_join._features

    def clash(n, bands, r):
        run = features(n, bands, r)

        def same_key(batches):
            import pyarrow as pa

            for b in run(batches):
                at = b.schema.get_field_index("key")
                yield b.set_column(at, "key", pa.array([77] * len(b), pa.int64()))

        return same_key

    monkeypatch.setattr(ngram_join, "_features", clash)
    got = {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert got == {i: (i - i % 2, 2) for i in range(12)}


def brute_line_dedup(rows, order):
    """By definition, over rows in ``order``; rows without an id have no windows."""
    seen, out = set(), []
    for i in order:
        doc_id, text = rows[i]
        lines = (text or "").split("\n")
        kept = [(x.strip(" \t\r\f\v"), k) for k, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        gone = set()
        for k in range(max(1, len(kept) - 2)) if kept and doc_id is not None else ():
            w = kept[k : k + 3]
            key = tuple(x for x, _ in w)
            if key in seen:
                gone |= set(range(w[0][1], w[-1][1] + 1))
            seen.add(key)
        out.append((doc_id, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(r.randint(0, 60), "\n".join(r.choice(["a", "b", "c ", " d", "", "e"]) for _ in range(r.randint(0, 9)))) for _ in range(60)]
    rows = list(dict(rows).items())  # one row an id: the order is that of the ids
    rows += [(None, "a\nb\nc"), (None, "a\nb\nc"), (70, None), (71, ""), (72, "a\nb\nc"), (73, "x\ny\nz\n"), (73, "x\ny\nz\n"), (73, "x\ny\nz\n"), (74, " \nonly\n"), (74, " \nonly\n"), (75, "q\n" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("clash")).withColumn("h1", F.lit(1))
    got = sorted((tuple(x) for x in line_dedup.line_dedup(df).collect()), key=repr)
    assert got == brute_line_dedup(rows, sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)))


def test_line_dedup_of_one_id_with_several_texts(spark):
    rows = [(1, "a\nb\nc"), (2, "p\nq\nr\ns"), (2, "a\nb\nc\nz"), (2, "z\nu\nv"), (3, "z\nu\nv")]
    got = sorted(tuple(x) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3, 0, "a\nb\nc"), (2, 3, 0, "z\nu\nv"), (2, 4, 0, "p\nq\nr\ns"), (2, 4, 3, "z"), (3, 3, 3, "")]


def brute_mixture(rows, max_repeats, budget, blocks, seed, place):
    """Uses of each row by definition: exponents on a fine grid, passes one after another, block by block in the order of the turns."""
    import math

    size = collections.Counter()
    for _, src, n in rows:
        size[src] += n
    live = {s: t for s, t in size.items() if t}
    whole = lambda e: max(live.values()) ** (1 - e) * sum(t**e for t in live.values())
    share = lambda e, s: live[s] ** e / sum(t**e for t in live.values())
    repeats = lambda e: max((budget or whole(e)) * share(e, s) / live[s] for s in live)
    e = next(k / 100_000 for k in range(100_001) if repeats(k / 100_000) <= max_repeats * (1 + 1e-6))
    uses = collections.Counter()
    for s in size:
        own = [(i, n) for i, src, n in rows if src == s]
        want = (budget or whole(e)) * share(e, s) if s in live else 0
        passes = math.floor(want / live[s] + 1e-4) if s in live else 1
        for i, _ in own:
            uses[i] += passes
        rest = want - passes * size[s] if s in live else 0
        used, turns = 0, sorted({(place["turn", place[i] % blocks, passes], place[i] % blocks) for i, _ in own})
        for _, block in turns:
            for p in sorted({place[i] for i, _ in own if place[i] % blocks == block}):
                if used < rest - 1e-4 * max(1, size[s]):
                    for i, n in own:
                        if place[i] == p:
                            uses[i] += 1
                    used += sum(n for i, n in own if place[i] == p)
    return +uses, e


@pytest.mark.parametrize("max_repeats,budget", [(1.5, None), (2.5, None), (3.0, 700.0), (1.0, 300.0)])
def test_mixing_against_brute_force(spark, max_repeats, budget):
    rows = [(i, "big" if i < 60 else "mid" if i < 90 else "small" if i < 100 else "tie", (i * 7) % 5 + 1) for i in range(110)] + [(200, "void", 0), (200, "void", 0)]
    d = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, s, n in rows], "doc_id long, source string, text string")
    place = {r[0]: r[1] for r in d.select("doc_id", F.xxhash64("doc_id", F.lit(17))).collect()}
    turns = spark.range(8).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("e"))
    place |= {("turn", r["b"], r["e"]): r["t"] for r in turns.select("b", "e", F.xxhash64("b", "e", F.lit(17)).alias("t")).collect()}
    out = mixing.mix_sources(d, max_repeats=max_repeats, budget=budget, blocks=8).collect()
    uses, e = brute_mixture(rows, max_repeats, budget, 8, 17, place)
    got = collections.Counter(r["doc_id"] for r in out)
    got[200] //= 2  # two rows
    uses[200] //= 2
    assert got == uses
    assert max(uses.values()) <= np.ceil(max_repeats)


def test_mixing_limit_holds_with_a_budget(spark):
    d = spark.createDataFrame([(i, "a" if i < 90 else "b", "x y z") for i in range(100)], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="max_repeats"):
        mixing.mix_sources(d, max_repeats=1.5, budget=3000)
    out = collections.Counter(r["doc_id"] for r in mixing.mix_sources(d, max_repeats=1.5, budget=330).collect())
    assert max(out.values()) <= 2 and abs(sum(out.values()) - 110) <= 2
    odd = d.withColumn("__x", F.col("doc_id")).withColumn("in_0", F.lit("i")).withColumn("tokens", F.lit(1))
    assert mixing.mix_sources(odd).select(odd.columns).where("`__x` <> doc_id").isEmpty()
