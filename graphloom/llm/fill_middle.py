"""Fill-in-middle: texts cut in three by a byte automaton and put together in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, map_batches, slices, text_bytes

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a transition emits: a unit (code point) begins, a sentinel ends.
UNIT, SENTINEL = 1, 2
#: Bytes that are scanned, or searched for a cut, at once.
SCAN_BYTES = 1 << 17


class Automaton:
    """A finite automaton over bytes: the bytes a code point still needs, and how far the sentinels are matched.

    ``step[state, class]`` is the next state, ``emit[state, class]`` what the transition
    emits, ``classes[byte]`` the class of bytes that no transition tells apart. After
    ``memory`` bytes the state depends on those bytes alone, whatever it was
    before, so that all places of a text are stepped side by side.
    """

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode() for s in sentinels]
        heads = sorted({w[:i] for w in words for i in range(len(w))})
        first = (0, b"")
        states, rows, outs = [first], [], []
        for need, seen in states:
            row, out = [], []
            for byte in range(256):
                tail = seen + bytes([byte])
                hit = any(tail.endswith(w) for w in words)
                left = next(h for h in sorted(heads, key=len, reverse=True) if tail.endswith(h))
                more = max(0, need - 1) if 128 <= byte < 192 else 1 if 192 <= byte < 224 else 2 if 224 <= byte < 240 else 3 if 240 <= byte < 248 else 0
                if (more, left) not in states:
                    states.append((more, left))
                row.append(states.index((more, left)))
                out.append(UNIT * (not 128 <= byte < 192) + SENTINEL * hit)
            rows.append(row)
            outs.append(out)
        table = np.concatenate([np.array(rows), np.array(outs)])
        kinds, classes = np.unique(table, axis=1, return_inverse=True)
        self.classes = classes.reshape(-1).astype(np.uint8)
        self.width = kinds.shape[1]
        self.step, self.emit = kinds[: len(states)].astype(np.uint8), kinds[len(states) :].astype(np.uint8)
        self.memory = 0
        apart = {(s, t) for s in range(len(states)) for t in range(s)}
        while apart:
            apart = {(max(a, b), min(a, b)) for s, t in apart for a, b in zip(self.step[s].tolist(), self.step[t].tolist(), strict=True) if a != b}
            self.memory += 1
            if self.memory > 4 + sum(map(len, words)):
                raise ValueError("an automaton that never forgets its state")

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What the transition at each byte of ``data`` emits; in pieces, so that memory is a few times SCAN_BYTES besides the result."""
        out = np.empty(len(data), np.uint8)
        step, emit, width = self.step.ravel(), self.emit.ravel(), np.uint16(self.width)
        for at in range(0, len(data), SCAN_BYTES):
            lo = max(0, at - self.memory)
            c = np.concatenate([np.zeros(self.memory - (at - lo), np.uint8), data[lo : at + SCAN_BYTES]])
            c = self.classes[c].astype(np.uint16)
            n = len(c) - self.memory
            state = np.zeros(n, np.uint16)
            for back in range(self.memory):
                state = step[state * width + c[back : back + n]].astype(np.uint16)
            out[at : at + n] = emit[state * width + c[self.memory :]]
        return out


@lru_cache(4)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    if any(not s or not s.isascii() for s in sentinels) or len(set(sentinels)) != 3:
        raise ValueError("three different sentinels of ASCII characters are needed")
    return Automaton(sentinels)


def count(emitted: np.ndarray, what: int) -> int:
    return sum(int(np.count_nonzero(emitted[at : at + SCAN_BYTES] & what)) for at in range(0, len(emitted), SCAN_BYTES))


def cut_at(emitted: np.ndarray, units: int) -> int:
    """The byte at which the first ``units`` units end: the second pass, over counts of pieces and then one piece."""
    for at in range(0, len(emitted), SCAN_BYTES):
        piece = emitted[at : at + SCAN_BYTES] & UNIT
        n = int(np.count_nonzero(piece))
        if units < n:
            return at + int(np.flatnonzero(piece)[units])
        units -= n
    return len(emitted)


def draws(seed: object, key: object) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``; a null key is empty."""
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(d[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(text: bytes, emitted: np.ndarray, h: tuple[int, ...], sentinels: tuple[str, ...], plain: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    n = count(emitted, UNIT)
    if not n or h[2] % 100 >= 100 - plain or count(emitted, SENTINEL):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i = cut_at(emitted, a)
    j = i + cut_at(emitted[i:], b - a)
    p, s, m = (x.encode() for x in sentinels)
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, b"".join((s, text[j:], p, text[:i], m, text[i:j]))
    return n, "psm", a, b - a, b"".join((p, text[:i], s, text[j:], m, text[i:j]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: object = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text of ``n`` code points is cut at two places drawn from the SHA-256 of ``seed:doc_id``.
    ``form`` is ``plain`` (the text as it is: empty texts, texts that hold a
    sentinel, and ``plain`` of 100 others; the cuts are null), ``spm`` (``spm`` of
    100 of the rest: suffix, prefix, middle) or ``psm`` (prefix, suffix, middle).

    One scan of the bytes by a table-driven automaton emits the beginnings of
    code points and the ends of sentinels; counts of both decide the form, and a second pass finds the
    bytes of the cuts. Null texts are empty; a null id is hashed as an empty
    one; repeated ids with different texts are cut at the same draws, repeated rows alike; empty tables
    are fine; other columns are ignored, whatever their names. Documents are
    independent, so nothing is shuffled; the scan takes one byte of memory for each byte of text.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    automaton(tuple(sentinels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton(tuple(sentinels))
        gap = b"\0" * dfa.memory
        for b in slices(batches):
            texts, ids, out = text_bytes(b.column("text")), b.column("doc_id").to_pylist(), []
            for lo, hi in chunks(texts):
                emitted = dfa.scan(np.frombuffer(gap.join(texts[lo:hi]), np.uint8))
                at = 0
                for key, t in zip(ids[lo:hi], texts[lo:hi], strict=True):
                    out.append(rearranged(t, emitted[at : at + len(t)], draws(seed, key), sentinels, plain, spm))
                    at += len(t) + len(gap)
            n, form, first, middle, made = zip(*out, strict=True) if out else ((), (), (), (), ())
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(made, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = rows.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return map_batches(rows, run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that :func:`fill_in_middle` rearranged, from its output and form."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)
