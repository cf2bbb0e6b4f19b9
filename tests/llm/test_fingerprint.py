"""Additive fingerprints against a plain version of their lanes, order and edits."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import fingerprint, queries
from tests_llm_helpers import make_text

SCHEMA = "doc_id long, text string, lang string, key string, kind string, `a.b` string, copies int"


def document_key(i, t):
    return hashlib.sha256(f"{'null' if i is None else f'={i}'}\n{t}".encode()).digest()


def edits(rows):
    """The edited text of each document, by definition."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, -(d[0] or 0), document_key(*d)))
    out = {}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        k = len(d[1]) // 3
        out[d] = (d[1][: len(d[1]) - k] + after[1][:k], after)
    return out


def exact_lanes(text):
    lanes = [0] * fingerprint.EXACT_LANES
    for p in text.split("\n"):
        sha = hashlib.sha512(p.encode()).hexdigest()
        for i in range(len(lanes)):
            lanes[i] = (lanes[i] + int(sha[8 * i : 8 * i + 8], 16)) % 2**32
    return lanes


def shingle_counts(text):
    c = collections.Counter()
    for line in text.split("\n"):
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in line)
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
        for k in range(max(1, len(w) - 4) if w else 0):
            c[tuple(w[k : k + 5])] += 1
    return c


def dice(a, b):
    size = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
    return 2 * sum(v * b[k] for k, v in a.items()) / size if size else 0.0


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = [None, "", " \n\t", "one", "One two", "\n".join(make_text(i, 40) for i in range(6)), "\n".join(make_text(i, 40) for i in reversed(range(6))), "é漢😀\n" + make_text(3, 60), "same line\n" * 40_000]
    out = [(i, t) for i, t in enumerate(texts)] + [(i, "\n".join(make_text(r.randint(0, 99), r.randint(1, 30)) for _ in range(r.randint(1, 9)))) for i in range(100, 160)]
    return out + [(None, "no id, once"), (None, "no id, again"), (5, "another text of five"), (101, out[40][1]), *[(3, "one")] * 4]


def test_against_plain_version(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "k", "x", "y", 1) for i, t in rows], SCHEMA)
    out = fingerprint.edited_fingerprints(df)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = out.collect()
    want = edits(rows)
    by_edit = collections.defaultdict(list)
    for (i, t), (e, after) in want.items():
        by_edit[i, len(t), hashlib.sha256(e.encode()).hexdigest()].append((t, e, after))
    copies = collections.Counter((i, len(t or ""), hashlib.sha256(want[i, t or ""][0].encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == copies
    errors = []
    for r in got:
        (t, e, after), = by_edit[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        for text, found in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert [int(found[8 * i : 8 * i + 8], 16) for i in range(fingerprint.EXACT_LANES)] == exact_lanes(text)
        for a, b, near in ((t, e, r["near_edited"]), (t, after[1], r["near_next"])):
            assert 0 <= near <= 1 and (near == 1 or a.split("\n") != b.split("\n"))
            if exact_lanes(a) != exact_lanes(b):
                errors.append(near - dice(shingle_counts(a), shingle_counts(b)))
    assert max(map(abs, errors)) < 0.5 and sum(x * x for x in errors) / len(errors) < 0.01
    prints = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert prints[5, len(rows[5][1])] == prints[6, len(rows[6][1])]  # the same paragraphs in another order
    assert not fingerprint.edited_fingerprints(df.limit(0)).collect()
    lone = fingerprint.edited_fingerprints(df.where("doc_id = 7")).collect()[0]
    assert lone["near_next"] == 1.0


def test_lanes_add_up(spark):
    """Insertion and deletion of paragraphs on fingerprints equals those of the texts."""
    parts = [make_text(i, 12) for i in range(8)]
    texts = {"a": "\n".join(parts[:5]), "b": "\n".join(parts[5:]), "ab": "\n".join([*parts[5:], *parts[:5]])}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    s = {r["id"]: r for r in fingerprint.sum_fingerprints(df, "id").collect()}
    lanes = spark.createDataFrame([(s["a"]["exact"], s["a"]["like"], s["b"]["exact"], s["b"]["like"])], "e long, x long, f long, y long".replace(" long", " array<long>"))
    both = lanes.select(fingerprint.combined(F.col("e"), F.col("f"), fingerprint.EXACT_BITS).alias("e"), fingerprint.combined(F.col("x"), F.col("y"), fingerprint.LIKE_BITS).alias("x"), "f", "y").cache()
    r = both.collect()[0]
    assert list(r["e"]) == list(s["ab"]["exact"]) and list(r["x"]) == list(s["ab"]["like"])
    back = both.select(fingerprint.combined(F.col("e"), F.col("f"), fingerprint.EXACT_BITS, -1).alias("e"), fingerprint.combined(F.col("x"), F.col("y"), fingerprint.LIKE_BITS, -1).alias("x")).collect()[0]
    assert list(back["e"]) == list(s["a"]["exact"]) and list(back["x"]) == list(s["a"]["like"])
    assert spark.createDataFrame([("a", "x"), ("a", "y")], "id string, text string").transform(lambda d: fingerprint.sum_fingerprints(d, "id")).collect()[0]["exact"] == exact_lanes("x\ny")


def test_order_over_ranges(spark):
    ids = [None, *range(-500, 2500, 3)]
    df = spark.createDataFrame([(document_key(i, ""), i) for i in ids], "key binary, doc_id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {bytes(r["key"]): bytes(r["next_key"]) for r in fingerprint.following(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = [document_key(i, "") for i in [*sorted(ids[1:], reverse=True), None]]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_query_has_no_python(spark, sf):
    df = queries.QUERIES["op12_fingerprints"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = df.collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)
    assert {hashlib.sha256(e.encode()).hexdigest() for e, _ in edits(list(texts.items())).values()} == {r["edited_sha256"] for r in rows}
