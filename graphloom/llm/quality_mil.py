"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, map_batches, slices, text_bytes, word_hashes
from graphloom.plans.tables import drop_table, write_table

#: Words of a passage.
PASSAGE = 64
#: Labelled documents that a model is fitted on at most, those of the least hashed ids, and the bytes of their features.
MAX_TRAIN, MAX_TRAIN_BYTES = 6000, 256 << 20
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\t\n\v\f\r",
    b".,;:?'\"()-",
    b"!",
    b"#*$%&|<>",
    b"=@_+/\\^~`[]{}",
    bytes(range(128, 256)),
)
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_BLANK = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
N_FEATURES = len(_CLASSES) + 1 + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of ``texts``, and each text's number of passages (at least one: of zeros if it has no word)."""
    blank = [t.translate(_BLANK) for t in texts]
    hashes, counts = word_hashes(blank)
    n_pass = np.maximum(-(-counts // PASSAGE), 1)
    out = np.zeros((int(n_pass.sum()), N_FEATURES), np.float32)
    if not len(hashes):
        return out, n_pass
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    on = np.frombuffer(b" ".join([b"", *blank, b""]), np.uint8) != 32
    step = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = step[0::2] + 1, step[1::2] + 1
    doc = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = np.repeat(np.cumsum(n_pass) - n_pass, counts) + within // PASSAGE
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    row = where[first]
    words = np.diff(np.append(first, len(hashes))).astype(np.float32)
    last_end = ends[np.append(first[1:], len(hashes)) - 1]
    kinds = _CLASS[raw]
    size = (last_end - starts[first]).astype(np.float32)
    edges = np.empty(2 * len(first), np.int64)
    edges[0::2], edges[1::2] = starts[first], last_end
    for k in range(len(_CLASSES) + 1):
        out[row, k] = np.add.reduceat(kinds == k, edges, dtype=np.int32)[0::2] / size
    at = len(_CLASSES) + 1
    length = (ends - starts).astype(np.float32)
    new_pass = np.zeros(len(hashes), bool)
    new_pass[first] = True
    same = np.zeros(len(hashes), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & ~new_pass[1:]
    key = np.stack([where.astype(np.uint64), hashes])
    order = np.lexsort(key[::-1])
    w, h = where[order], hashes[order]
    again = np.zeros(len(hashes), np.float32)
    again[1:] = (w[1:] == w[:-1]) & (h[1:] == h[:-1])
    upper = (kinds[starts] == 1) & (kinds[np.minimum(starts + 1, ends - 1)] == 1)
    end_kind = kinds[ends - 1]
    per = lambda x: np.add.reduceat(x.astype(np.float32), first) / words
    out[row, at] = np.log1p(per(length))
    out[row, at + 1] = per(same)
    out[row, at + 2] = np.add.reduceat(again, np.searchsorted(w, row)) / words
    out[row, at + 3] = per(upper)
    out[row, at + 4] = per((end_kind == 5) | (end_kind == 6))
    out[row, at + 5] = per(length <= 3)
    out[row, at + 6] = np.log1p(words)
    out[row, at + 7] = np.log1p(np.bincount(doc, minlength=len(texts)).astype(np.float32))[doc[first]]
    return out, n_pass


class GatedAttention:
    """Encoder tanh(W x), gated attention over a document's passages, and a logistic score of the weighted sum."""

    def __init__(self, n_in: int, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n_in, np.float32), np.ones(n_in, np.float32)
        self.p = {
            "W": r.normal(0, n_in**-0.5, (n_in, hidden)), "b": np.zeros(hidden),
            "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate),
            "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        at = np.cumsum(counts) - counts
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return score, (x, h, t, s, a, z, at)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.p
        score, (x, h, t, s, a, z, at) = self.forward(x, counts)
        g = (score - y) / len(y)
        gz = np.repeat(g[:, None] * p["c"], counts, axis=0)
        ga = (gz * h).sum(axis=1)
        ge = a * (ga - np.repeat(np.add.reduceat(a * ga, at), counts))
        gts = ge[:, None] * p["w"]
        gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
        gh = a[:, None] * gz + gt @ p["V"].T + gs @ p["U"].T
        gx = gh * (1 - h * h)
        out = {"W": x.T @ gx, "b": gx.sum(axis=0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": g.sum(keepdims=True)}
        return {k: v + decay * p[k] * (k not in "bd") for k, v in out.items()}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        at = np.cumsum(counts) - counts
        step, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = order[lo : lo + batch]
                rows = np.concatenate([np.arange(at[i], at[i] + counts[i]) for i in own])
                step += 1
                for k, g in self.gradients(x[rows], counts[own], y[own], decay).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - 0.95 * step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        feats = []
        texts = text_bytes(b.column("__text"))
        for lo, hi in chunks(texts):
            x, counts = passages(texts[lo:hi])
            at = np.cumsum(counts)
            feats += [x[j - n : j].tobytes() for j, n in zip(at.tolist(), counts.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(feats, pa.binary())], names=["quality", "features"])


def _score(model: GatedAttention):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = text_bytes(b.column("__text"))
            scores = [np.empty(0)]
            for lo, hi in chunks(texts):
                scores.append(model.forward(*passages(texts[lo:hi]))[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "score"])

    return run


def held_out(id_col: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> GatedAttention:
    """Fit a model on labelled documents that are not held out, ``max_train`` at most, and of these on as many as have ``max_bytes`` of features.

    A labelled id counts once for each of its labels, by the text of the least hash if it has several rows. Nulls among the labels and labels other than 0 and 1 don't count. With
    fewer than one document of either label, the model scores the share of label 1 (0.5 if there are none).
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    own = known.where(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    chosen = own.orderBy(F.xxhash64("__id"), "__id", "quality").limit(max_train)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("__own"), text.alias("__text")).join(F.broadcast(chosen), F.col("__own") == F.col("__id"))
    rows = rows.groupBy("__id", "quality").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    encoded = map_batches(rows.select("quality", "__text"), _encode, "quality int, features binary")
    encoded = write_table(encoded.withColumn("place", F.xxhash64("features", "quality")), "mil-features")
    last, used = None, 0
    for place, size in sorted((r[0], r[1]) for r in encoded.select("place", F.length("features")).collect()):
        used += size
        if used > max_bytes:
            break
        last = place
    got = encoded.where(F.col("place") <= F.lit(last)).toPandas() if last is not None else encoded.limit(0).toPandas()
    drop_table(encoded)
    got = got.assign(key=[hash_bytes(f) for f in got["features"]]).sort_values(["key", "quality"], kind="stable")
    model = GatedAttention(N_FEATURES)
    y = got["quality"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        model.p["c"][:] = 0
        model.p["d"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    parts = [np.frombuffer(f, np.float32).reshape(-1, N_FEATURES) for f in got["features"]]
    model.fit(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), y)
    return model


def hash_bytes(data: bytes) -> str:
    import hashlib

    return hashlib.md5(data, usedforsecurity=False).hexdigest()


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, cutoff: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Every passage of every text is encoded; neither labels nor ids nor other columns
    reach the score. Null and empty texts are one passage of zeros; repeated rows get equal scores; a
    document with several labels trains with each. Extra columns are ignored. Fitting
    takes ``max_train`` labelled documents at most, scoring streams by partition.
    """
    model = train(docs, labels, id_col, text_col, max_train)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    scored = map_batches(d, _score(model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
