"""Near-duplicate join on word n-grams: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD_TABLE, map_batches, mix, shingles, slices, split_likely, text_bytes, unused
from graphloom.operators.components import connected_components
from graphloom.plans.tables import drop_table, write_table

#: Shingles that one verification block holds; two blocks meet in a task. A set counts as MIN_SHINGLES at least, which bounds the sets of a block.
BLOCK_SHINGLES, MIN_SHINGLES = 400_000, 400


def choose_bands(threshold: float, target_recall: float, max_hashes: int = 512) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) whose bands reach ``target_recall`` at ``threshold`` within ``max_hashes``."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - target_recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for the recall that is asked for")


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (s[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[k:] >> np.uint64(32)).astype(np.uint32)


def minhash(sets: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash signature of one nonempty set of 64-bit hashes."""
    h = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 64):
        x = h[at : at + 64, None] ^ add
        x *= mul
        x ^= x >> np.uint32(15)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set of hashes."""
    out = []
    for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
        h = mix(s + salt)
        total = h.sum(dtype=np.uint64, keepdims=True) * np.uint64(3) + np.bitwise_xor.reduce(mix(h ^ salt), keepdims=True)
        out.append(int(mix(total + np.uint64(len(s))).view(np.int64)[0]))
    return out[0], out[1]


def _features(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _seeds(bands * rows)
        weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
        for b in slices(batches):
            keys, checks, sizes, flat, offsets = [], [], [], [], [0]
            sets = shingles([t.translate(WORD_TABLE) for t in text_bytes(b.column("__text"))], n)
            for s in sets:
                if len(s):
                    sig = minhash(s, mul, add).astype(np.uint64).reshape(bands, rows)
                    flat.append(mix(salt ^ mix((sig * weights).sum(axis=1, dtype=np.uint64))).view(np.int64))
                key, check = set_key(s) if len(s) else (None, None)
                keys.append(key)
                checks.append(check)
                sizes.append(len(s))
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            values = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("mark"),
                    b.column("mark2"),
                    pa.array(keys, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64())),
                ],
                names=["doc_id", "mark", "mark2", "key", "check", "size", "bands"],
            )

    return run


def _sets(n: int):
    """Texts of the classes that have candidates, to the rows that the block tasks read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = {c: b.column(c).to_pylist() for c in ("key", "part", "parts", "blocks")}
            out: dict[str, list] = {"part": [], "a": [], "b": [], "block": [], "key": [], "grams": []}
            for i, s in enumerate(shingles([t.translate(WORD_TABLE) for t in text_bytes(b.column("__text"))], n)):
                data, own, k = s.tobytes(), cols["part"][i], cols["blocks"][i]
                mine = cols["parts"][i]
                for other in range(k):
                    out["part"].append(own)
                    out["a"].append(min(mine, other))
                    out["b"].append(max(mine, other))
                    out["block"].append(mine)
                    out["key"].append(cols["key"][i])
                    out["grams"].append(data)
                    if len(out["key"]) >= 256:
                        yield _rows(out)
            yield _rows(out)

    return run


_SET_SCHEMA = pa.schema([("part", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("block", pa.int32()), ("key", pa.int64()), ("grams", pa.binary())])


def _rows(out: dict[str, list]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pydict(out, schema=_SET_SCHEMA)
    for v in out.values():
        v.clear()
    return batch


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of ``sets``, from products of 0/1 blocks of shared elements."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    total = np.zeros((m, m), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[who[i:j], at[i:j] - lo] = 1
        total += x @ x.T
    return total.astype(np.int64)


def _verify(threshold: float):
    def group(members: dict[int, tuple[int, np.ndarray]], same: bool) -> list[tuple[int, int | None, int]]:
        keys = list(members)
        if len(keys) < 2:
            return []
        sets, block = [members[k][1] for k in keys], np.array([members[k][0] for k in keys])
        sizes = np.array([len(s) for s in sets])
        inter = intersections(sets)
        linked = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
        np.fill_diagonal(linked, False)
        if not same:
            linked &= block[:, None] != block[None, :]
        out: list[tuple[int, int | None, int]] = [(keys[i], None, int(c)) for i, c in enumerate(linked.sum(axis=1)) if c]
        free = np.ones(len(keys), bool)
        for root in range(len(keys)):
            if not free[root]:
                continue
            free[root] = False
            todo = [root]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & free)
                free[new] = False
                out += [(keys[j], keys[root], 0) for j in new]
                todo += new.tolist()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("peer", pa.int64()), ("links", pa.int64())])
        now, members = None, {}

        def done() -> pa.RecordBatch:
            rows = group(members, now is not None and now[1] == now[2])
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=schema)

        for b in slices(batches):
            for part, a, c, block, key, grams in zip(*(b.column(x).to_pylist() for x in _SET_SCHEMA.names), strict=True):
                if (part, a, c) != now:
                    yield done()
                    now, members = (part, a, c), {}
                members[key] = (block, np.frombuffer(grams, np.uint64))
        yield done()

    return run


def _marked(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``docs`` with two hashes of id and text, which are equal for repeated rows alone."""
    own = [F.col(id_col), F.col(text_col).cast("string")]
    return docs.select("*", F.xxhash64(*own).alias(more[0]), F.xxhash64(F.lit(11), own[1], F.lit(13), own[0]).alias(more[1]))


def _classify(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, target_recall: float, max_hashes: int) -> DataFrame:
    """The columns of :func:`ngram_jaccard_join` for each row, with its ``mark`` and ``mark2`` and those of the row of its class that stays (``stays, stays2``; null where the row is alone)."""
    bands, rows = choose_bands(threshold, target_recall, max_hashes)
    texts = _marked(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")), "doc_id", "__text", "mark", "mark2")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    features = write_table(
        map_batches(texts, _features(n, bands, rows), f"doc_id {id_type}, mark long, mark2 long, key long, check long, size int, bands array<long>"), "ngram-features"
    )
    # nulls are last, so a row without an id stays only if its class has no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark", "mark2"))
    folded = write_table(
        features.where("key IS NOT NULL")
        .groupBy("key", "check")
        .agg(first.alias("best"), F.count("*").alias("n_copies"), F.max("size").alias("size"), F.first("bands").alias("bands")),
        "ngram-classes",
    )
    # two sets of one 64-bit key get keys of their own
    twice = folded.groupBy("key").count().where("count > 1").select("key").collect()
    own_key = F.when(F.col("key").isin([r[0] for r in twice]), F.xxhash64("key", "check")).otherwise(F.col("key")) if twice else F.col("key")
    classes = folded.withColumn("key", own_key)
    banded = classes.select("key", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = banded.join(buckets, "band").where("key <> least").select(F.col("least").alias("src"), F.col("key").alias("dst"))
    parts = connected_components(stars).withColumnsRenamed({"id": "key", "component": "part"})
    placed = write_table(parts.join(classes.select("key", F.col("best.mark").alias("mark"), F.col("best.mark2").alias("mark2"), "size"), "key"), "ngram-parts")
    blocks = placed.groupBy("part").agg(F.ceil(F.sum(F.greatest("size", F.lit(MIN_SHINGLES))) / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = placed.join(blocks, "part").select(
        "key", "mark", "mark2", "part", "blocks", F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks")).cast("int").alias("parts")
    )
    likely, _ = split_likely(texts, placed.select("mark"), "mark")
    # repeated rows, where there are any, are folded before their shuffle: each set goes to its blocks once
    repeated = write_table(features.groupBy("mark", "mark2").count().where("count > 1").select("mark", "mark2"), "ngram-repeated")
    if not repeated.isEmpty():
        many, likely = split_likely(likely, repeated.select("mark"), "mark")
        likely = likely.select("mark", "mark2", "__text").unionByName(many.groupBy("mark", "mark2").agg(F.first("__text").alias("__text")))
    sets = map_batches(
        likely.join(wanted, ["mark", "mark2"]).select("key", "part", "parts", "blocks", "__text"), _sets(n), "part long, a int, b int, block int, key long, grams binary"
    )
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = write_table(
        map_batches(sets.repartition(partitions, "part", "a", "b").sortWithinPartitions("part", "a", "b"), _verify(threshold), "key long, peer long, links long"),
        "ngram-links",
    )
    drop_table(placed)
    counts = found.where("peer IS NULL").groupBy("key").agg(F.sum("links").alias("n_links"))
    joined = connected_components(found.where("peer IS NOT NULL").select(F.col("peer").alias("src"), F.col("key").alias("dst")))
    joined = joined.withColumnsRenamed({"id": "key", "component": "label"})
    own = classes.select("key", "check", "best", "n_copies")
    named = joined.join(own, "key")
    least = named.groupBy("label").agg(F.min("best").alias("stays"))
    linked = named.select("key", "label").join(least, "label").join(counts, "key").select("key", "stays", "n_links")
    info = write_table(
        own.join(linked, "key", "left").select(
            "key", "check", F.coalesce("stays", "best").alias("stays"), F.col("best.id").alias("copy_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
        ),
        "ngram-info",
    )
    marks = features.select("doc_id", "mark", "mark2", own_key.alias("key"), "check")
    return marks.join(info, ["key", "check"], "left").select(
        "doc_id",
        F.coalesce("stays.id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "mark", "mark2", F.col("stays.mark").alias("stays"), F.col("stays.mark2").alias("stays2"),
    )


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    target_recall: float = 0.995,
    max_hashes: int = 512,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_copies, n_links``.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased. Documents with equal shingle sets are copies: ``copy_id`` is
    their least id and ``n_copies`` their number. ``n_links`` counts the other
    shingle sets whose Jaccard similarity is ``threshold`` or more, decided on
    the full sets. ``class_id`` is the least id of the documents that such
    links and copies connect. Null and empty texts, and texts without a word,
    are linked with nothing and are their own class (also if repeated); the
    class of a null id without partners is null. Repeated rows are copies of each other, and rows
    of one id with different texts are documents of their own.

    Copies are folded before anything else. Bands (as many as ``target_recall``
    at the threshold takes) only place sets that may be similar into one
    candidate component, by star edges, so a bucket of m sets costs m rows. Each
    component is cut into blocks of about BLOCK_SHINGLES shingles and every two
    blocks meet in one task, which counts links and returns a spanning forest,
    never the pairs. All sets of a component are compared, so recall within it
    is 1. Keys of shingle sets have 128 bits; sets that agree in the first 64 are told apart.
    """
    return _classify(docs, id_col, text_col, n, threshold, target_recall, max_hashes).select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, target_recall: float = 0.995, max_hashes: int = 512
) -> DataFrame:
    """``docs`` with one row of each class of :func:`ngram_jaccard_join`: that of the least id, and of the least hash if an id has several.

    Rows are told apart by id and text: rows of one id with different texts are judged each by its
    own class, and of repeated rows one stays. A row without an id stays if its class has no row with one. Rows
    without a word are all kept. Only rows that may have to go are shuffled.
    """
    found = write_table(_classify(docs, id_col, text_col, n, threshold, target_recall, max_hashes).where("stays IS NOT NULL"), "ngram-classes-of-documents")
    a, b, x, y = unused(docs, "mark", "mark2", "gone", "gone2")
    best = (F.col("mark") == F.col("stays")) & (F.col("mark2") == F.col("stays2"))
    own = [F.col("mark").alias(x), F.col("mark2").alias(y)]
    gone = write_table(found.where(~best).select(*own).distinct(), "ngram-gone")
    rows = _marked(docs, id_col, text_col, a, b)
    likely, kept = split_likely(rows, gone.select(x), a)
    same = (F.col(a) == F.col(x)) & (F.col(b) == F.col(y))
    kept = kept.unionByName(likely.join(gone, same, "left_anti"))
    twice = write_table(found.where(best & (F.col("n_copies") > 1)).groupBy(*own).count().where("count > 1").select(x, y), "ngram-twice")
    if not twice.isEmpty():
        repeated, kept = split_likely(kept, twice.select(x), a)
        kept = kept.unionByName(repeated.join(twice, same, "left_anti")).unionByName(repeated.join(twice, same, "left_semi").dropDuplicates([a, b]))
    return kept.drop(a, b)
