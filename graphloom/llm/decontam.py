"""Benchmark decontamination with a generalised suffix automaton over normalised words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_TABLE, every, map_batches, slices, text_bytes, unused, worker_state
from graphloom.plans.tables import write_table

#: Words of benchmark items in one automaton; more items make more automata.
BLOCK_WORDS = 150_000


class SuffixAutomaton:
    """The generalised suffix automaton of sequences of integers, with the items that contain each state's strings."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owners: list[set[int]] = [set()]
        self.whole: list[tuple[int, list[int]] | None] = [None]

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        self.whole.append(None)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of ``q`` that are at most one longer than ``p``."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, item: list[int]) -> None:
        last = 0
        for c in item:
            last = self._extend(last, c)

    def own(self, number: int, item: list[int]) -> None:
        """Note that ``item``, added before, is item ``number``: after all were added."""
        state = 0
        for c in item:
            state = self.next[state][c]
            s = state
            while s > 0 and number not in self.owners[s]:
                self.owners[s].add(number)
                s = self.link[s]
        if 0 < len(item) < self.window:
            self.whole[state] = (len(item), [*(self.whole[state] or (0, []))[1], number])

    def finish(self) -> None:
        """For each state: the state of its suffixes of ``window`` words, and the nearest suffix that is a whole short item."""
        n = len(self.link)
        self.full = [-1] * n
        self.short = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.full[s] = s if self.length[up] < self.window else self.full[up]
            self.short[s] = s if self.whole[s] else self.short[up] if up > 0 else -1
        for s in range(n):
            if self.full[s] != s:
                self.owners[s] = set()

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, Iterable[int]]]:
        """``(start, end, items)`` for each place where a window or a whole short item ends."""
        state = length = 0
        nxt, link, lens, full, short = self.next, self.link, self.length, self.full, self.short
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                length = lens[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            if length >= self.window and full[state] >= 0:
                yield i + 1 - self.window, i + 1, self.owners[full[state]]
            s = short[state]
            while s > 0:
                n, items = self.whole[s]
                if length >= n:
                    yield i + 1 - n, i + 1, items
                s = short[link[s]] if link[s] > 0 else -1


class Matcher:
    """A block of items: word numbers, automaton and the pairs of neighbours that runs are made of."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t.translate(WORD_TABLE).split()] for _, t in items]
        self.automaton = SuffixAutomaton(window)
        for c in coded:
            self.automaton.add(c)
        for i, c in enumerate(coded):
            self.automaton.own(i, c)
        self.automaton.finish()
        self.least = min([window, *(len(c) for c in coded if c)])
        pairs = {(a << 32) | b for c in coded for a, b in zip(c, c[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """Stretches of words in which every neighbouring pair is in some item: a window lies within one."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        pair = (ids[:-1] << 32) | ids[1:]
        both = known[:-1] & known[1:]
        ok = np.zeros(len(pair), bool)
        at = np.flatnonzero(both)
        if len(at) and len(self.pairs):
            place = np.searchsorted(self.pairs, pair[at])
            ok[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == pair[at]
        if self.least > 1:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
            for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                if hi + 1 - lo >= self.least:
                    yield lo, hi + 1, ids[lo : hi + 1].tolist()
        else:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
            for lo, hi in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                yield lo, hi, ids[lo:hi].tolist()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged half-open spans of hit words, and the numbers of the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for at, _, run in self.runs(words) if len(words) >= self.least else ():
            for a, b, owners in self.automaton.scan(run):
                items.update(owners)
                a, b = a + at, b + at
                while spans and a <= spans[-1][1]:
                    a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                    spans.pop()
                spans.append((a, b))
        return spans, items


def _matcher(key: bytes, items: list[tuple[str, bytes]], window: int) -> Matcher:
    return worker_state("decontam", key, lambda: Matcher(items, window))


def _scan(items, window: int, first: bool):
    key = hashlib.sha256(repr((items, window)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, window)
        for b in slices(batches):
            totals, spans, found = [], [], []
            old_spans, old_items = ([None] * len(b),) * 2 if first else (b.column("__spans").to_pylist(), b.column("__items").to_pylist())
            for t, s, i in zip(text_bytes(b.column("__text")), old_spans, old_items, strict=True):
                words = t.translate(WORD_TABLE).split()
                new, numbers = matcher.match(words)
                totals.append(len(words))
                merged: list[list[int]] = []
                for a, z in sorted([*map(tuple, s or ()), *new]):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                spans.append(merged)
                found.append([*(i or ()), *(matcher.ids[x] for x in numbers)])
            cols = {n: b.column(n) for n in b.schema.names if n not in ("__spans", "__items", "__words")}
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), pa.array(totals, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))],
                names=[*cols, "__words", "__spans", "__items"],
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items with words, in blocks of about ``limit`` words; an item of more is alone."""
    block: list[tuple[str, bytes]] = []
    size = 0
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    for r in items.toLocalIterator():
        text = b" ".join(r["t"].encode("utf-8", "replace").translate(WORD_TABLE).split())
        words = text.count(b" ") + 1 if text else 0
        if block and size + words > limit:
            yield block
            block, size = [], 0
        if words:
            block.append((r["i"], text))
            size += words
    if block:
        yield block


def _clean(items, window: int, text_at: str, share: tuple[int, int]):
    key = hashlib.sha256(repr((items, window)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, window)
        for b in slices(batches):
            keep = []
            for t in text_bytes(b.column(text_at)):
                words = t.translate(WORD_TABLE).split()
                hit = sum(z - a for a, z in matcher.match(words)[0])
                keep.append(not hit or share[1] * hit < share[0] * len(words))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: tuple[int, int] = (1, 20),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the rows of which words are hit, and at least ``share`` of them, as in :func:`find_contamination`.

    All other rows stay as they are, in all columns. A benchmark of one block is
    matched row by row without a shuffle; with more blocks, hits add up
    over blocks and rows are told apart by a number that the written copy fixes.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return map_batches(docs, _clean(first, window, text_col, share), docs.schema)
    row, gone = unused(docs, "row", "gone")
    held = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    found = find_contamination(held, benchmark, row, text_col, item_col, item_text_col, window, block_words=block_words)
    bad = found.where((F.col("n_hit") > 0) & (share[1] * F.col("n_hit") >= share[0] * F.col("n_words"))).select(F.col("doc_id").alias(gone))
    return held.join(bad, F.col(row) == F.col(gone), "left_anti").drop(row)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without these half-open ranges of its words; of two spaces around a gap one stays."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_TABLE))]
    out, at = [], 0
    for a, z in spans:
        start, end = places[a][0], places[z - 1][1]
        out.append(text[at:start])
        at = end + (text[end : end + 1] == b" " and text[start - 1 : start] in (b" ", b""))
    return b"".join([*out, text[at:]])


def _cut(text: bytes, matcher: Matcher, max_words: int, share: tuple[int, int]) -> bytes | None:
    """``text`` without spans of more than ``max_words`` words, or None if hits cover ``share`` of it; what a cut joins is matched again."""
    while True:
        words = text.translate(WORD_TABLE).split()
        spans = matcher.match(words)[0]
        hit = sum(z - a for a, z in spans)
        if hit and share[1] * hit >= share[0] * len(words):
            return None
        long = [s for s in spans if s[1] - s[0] > max_words]
        if not long:
            return text
        text = _without(text, long)


def _remove(items, window: int, text_at: str, max_words: int, share: tuple[int, int]):
    key = hashlib.sha256(repr((items, window)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, items, window)
        for b in slices(batches):
            at = b.schema.get_field_index(text_at)
            old = text_bytes(b.column(at))
            new = [_cut(t, matcher, max_words, share) for t in old]
            if any(x is not None and x != t for x, t in zip(new, old, strict=True)):
                texts = [y if x is None or x == t else x.decode() for x, t, y in zip(new, old, b.column(at).to_pylist(), strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.filter(pa.array([x is not None for x in new], pa.bool_()))

    return run


def _remove_noted(text_at: str, spans_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index(text_at)
            texts = [_without(t, s).decode() for t, s in zip(text_bytes(b.column(at)), b.column(spans_at).to_pylist(), strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).drop_columns([spans_at])

    return run


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_words: int = 12,
    share: tuple[int, int] = (1, 20),
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with cleaned texts: spans of more than ``max_words`` words go, and so do rows of which ``share`` or more is hit, as in :func:`keep_clean`.

    So with the defaults no window of ``window`` words is left; occurrences of whole shorter items stay, unless
    merged spans of them are longer. What a cut joins is matched again, until nothing is over a limit. All
    other columns, and texts without a long span, stay as they are. A benchmark of one block needs no
    shuffle; with more blocks, only rows that were cut go through another round.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return map_batches(docs, _remove(first, window, text_col, max_words, share), docs.schema)
    done, todo = None, docs
    row, hit, over, long_spans = unused(docs, "row", "hit", "over", "long")
    while True:
        held = write_table(todo.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
        found = find_contamination(held, benchmark, row, text_col, item_col, item_text_col, window, block_words=block_words).where("n_hit > 0")
        long = F.filter("spans", lambda s: s[1] - s[0] > max_words)
        bad = share[1] * F.col("n_hit") >= share[0] * F.col("n_words")
        found = write_table(found.select(F.col("doc_id").alias(hit), bad.alias(over), long.alias(long_spans)).where(F.col(over) | (F.size(long_spans) > 0)), "decontam-spans")
        kept = held.join(found, F.col(row) == F.col(hit), "left_anti").drop(row)
        done = kept if done is None else done.unionByName(kept)
        cut = held.join(found.where(~F.col(over)), F.col(row) == F.col(hit)).select(*every(docs), long_spans)
        todo = write_table(map_batches(cut, _remove_noted(text_col, long_spans), docs.schema), "decontam-cut")
        if todo.isEmpty():
            return done


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    keep_text: bool = False,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items, spans``.

    A-Z is lower-cased; words are runs of ASCII letters, digits and non-ASCII
    characters. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. ``spans`` are merged half-open
    word ranges of all occurrences, ``items`` the sorted distinct ids (as
    strings) of items with an occurring window. Null and empty texts, items
    without words or without an id, and an empty benchmark match nothing; repeated rows each get
    their row. With ``keep_text`` the column ``__text`` follows.

    The automaton of at most ``block_words`` item words goes to the tasks with
    the closure; further blocks are further passes over the spans so far, each
    written down before the next, so memory is bounded at any benchmark size.
    Documents stream by partition and nothing is shuffled.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    base = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, __text string"
    first = True
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        if not first:
            d = write_table(d, "decontam")
        d = map_batches(d, _scan(block, window, first), f"{base}, __words long, __spans array<array<int>>, __items array<string>")
        first = False
    if first:
        d = map_batches(d, _scan([], window, True), f"{base}, __words long, __spans array<array<int>>, __items array<string>")
    items = F.array_sort(F.array_distinct("__items"))
    return d.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        items.alias("items"),
        F.col("__spans").alias("spans"),
        *(["__text"] if keep_text else []),
    ).withColumn("n_items", F.size("items").cast("long"))
