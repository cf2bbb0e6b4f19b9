"""Fill-in-middle against a plain version, and the automaton byte by byte."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import fill_middle, queries
from tests_llm_helpers import make_text

SCHEMA = "doc_id long, text string, lang string, output string, form string, `a.b` string, n int"


def plain_version(doc_id, text, seed="1"):
    t = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def random_text(r):
    return "".join(r.choice(["<", "P", "S", "M", ">", "<P", "<<", "é", "漢", "😀", "a", "\n", "\0", "P>", "́"]) for _ in range(r.randint(0, 40)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [None, "", "<", "<P", "x<P>y", "<M>", "<S", "P>", "\0", "é", "<<P>>", make_text(1, 50), "漢字" * 70_000, "a<S" + "b" * 300_000 + ">"]
    texts += [random_text(r) for _ in range(600)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, "no id"), (7, "same id"), (8, "same row"), (8, "same row"), (-5, "negative <P"), *((i, make_text(i, 30)) for i in range(5000, 5300))]


def test_against_plain_version(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "o", "f", "x", 3) for i, t in rows], SCHEMA)
    got = fill_middle.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    text = fill_middle.restored(got["output"], got["form"])
    found = got.select("*", text.alias("back")).collect()
    assert collections.Counter(tuple(r)[:6] for r in found) == collections.Counter((i, *plain_version(i, t)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["back"]) for r in found) == collections.Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert not fill_middle.fill_in_middle(df.limit(0)).collect()


def test_parameters(spark):
    df = spark.createDataFrame([(str(i), make_text(i, 9)) for i in range(40)], "name string, body string")
    made = fill_middle.fill_in_middle(df, "name", "body", seed="s", plain=0, spm=100, sentinels=("[a]", "[bb]", "|"))
    got = made.select("*", fill_middle.restored(made["output"], made["form"], ("[a]", "[bb]", "|")).alias("back")).collect()
    assert all(r["form"] == "spm" and r["output"].startswith("[bb]") and r["back"] == make_text(int(r["doc_id"]), 9) for r in got)
    with pytest.raises(ValueError, match="sentinels"):
        fill_middle.fill_in_middle(df, "name", "body", sentinels=("<P>", "<P>", "<M>"))


@pytest.mark.parametrize("sentinels", [fill_middle.SENTINELS, ("aa", "aab", "ba"), ("<|p|>", "<|s|>", "<|m|>")])
def test_automaton_against_one_byte_at_a_time(sentinels, monkeypatch):
    monkeypatch.setattr(fill_middle, "SCAN_BYTES", 7)
    dfa = fill_middle.Automaton(sentinels)
    r = random.Random(2)
    for _ in range(300):
        t = random_text(r) + "".join(r.choice(["a", "b", *sentinels]) for _ in range(r.randint(0, 9)))
        b = t.encode()
        emitted = dfa.scan(np.frombuffer(b, np.uint8))
        state, one = 0, []
        for c in b:
            k = dfa.classes[c]
            one.append(dfa.emit[state, k])
            state = dfa.step[state, k]
        assert emitted.tolist() == one
        assert fill_middle.count(emitted, fill_middle.UNIT) == len(t)
        assert fill_middle.count(emitted, fill_middle.SENTINEL) == sum(any(b[: i + 1].endswith(s.encode()) for s in sentinels) for i in range(len(b)))
        for k in range(len(t) + 1):
            assert fill_middle.cut_at(emitted, k) == len(t[:k].encode())


def test_query_reads_the_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_fill_in_middle"](spark, sf).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(docs)
    for r in got:
        n, form, a, m, out = plain_version(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, m, sha(out), sha(docs[r["doc_id"]] or ""))
