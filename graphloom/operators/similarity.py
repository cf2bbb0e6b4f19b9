"""Sketched and exact similarity: MinHash, LSH, clones, vectors, colour refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.plans.tables import drop_table, shuffled, write_table

#: Rows and queries of a group of vectors that one call scores, at most, and bytes of either as doubles; places of one matrix product.
GROUP_ROWS, GROUP_QUERIES, GROUP_BYTES, PRODUCT_CELLS = 16_384, 16_384, 64 << 20, 1 << 22
#: A matrix product adds in an order of its own: scores nearer than this are decided exactly.
ROUNDING = 1e-9
#: Shingles that a block of sets holds; two blocks meet in a task. A set counts as MIN_RUNS at least, which bounds the sets of a block.
BLOCK_RUNS, MIN_RUNS = 1 << 20, 512


def token_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of ``k`` words; all words if there are fewer, but some."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(own: Column) -> Column:
        n = F.size(own)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))

    # the array around the words makes them once, not once a run
    return F.when(text.isNotNull(), F.get(F.transform(F.array(words), runs), F.lit(0))).otherwise(F.array().cast("array<string>"))


def minhash(items: Column, hashes: int = 128) -> Column:
    """The signature of an array: for each seed the least 64-bit hash of an element; the greatest long everywhere for an empty array."""
    # one hash an element, then cheap mixes of it for every seed; the array around them makes the hashes once, not once a seed
    base = F.array(F.transform(items, lambda x: F.xxhash64(x)))
    signed = lambda own: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.coalesce(F.array_min(F.transform(own, lambda h: F.xxhash64(h, i))), F.lit((1 << 63) - 1)))
    return F.get(F.transform(base, signed), F.lit(0))


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places; the longer signature is cut, empty ones give 0."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x == y).cast("int"))
    return F.when(n > 0, F.aggregate(same, F.lit(0), lambda s, x: s + x) / n).otherwise(0.0)


def merge_signatures(a: Column, b: Column) -> Column:
    """The signature of the union of two sets."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two arrays of distinct elements; 0 for two empty ones."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(256)
def _odd(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(8) | np.uint64(salt)) | np.uint64(1)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of :func:`token_shingles`, in order; none for null."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def word_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words that :func:`token_shingles` lists."""
    many = min(k, len(words))
    g = np.zeros(len(words) - many + 1 if many else 0, np.uint64)
    for j, m in enumerate(_odd(many, 1)):
        g += words[j : j + len(g)] * m
    g = np.sort(_mix(g + np.uint64(many)))
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


def set_key(runs: np.ndarray) -> int:
    """A 64-bit key of a set from :func:`word_runs`."""
    return int.from_bytes(hashlib.blake2b(runs.tobytes(), digest_size=8).digest(), "little", signed=True)


def run_bands(runs: np.ndarray, hashes: int, bands: int) -> np.ndarray:
    """Keys of the bands of a MinHash signature of ``hashes`` places; none for an empty set."""
    if not len(runs):
        return np.empty(0, np.int64)
    mul, add = _odd(hashes, 2).astype(np.uint32), (_odd(hashes, 3) >> np.uint64(32)).astype(np.uint32)
    h, low = (runs >> np.uint64(32)).astype(np.uint32), np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):  # as much as stays in a cache
        np.minimum(low, ((h[at : at + 1024, None] ^ add) * mul).min(axis=0), out=low)
    rows = hashes // bands
    cut = low[: bands * rows].astype(np.uint64).reshape(bands, rows)
    return _mix((cut * _odd(bands * rows, 4).reshape(bands, rows)).sum(axis=1, dtype=np.uint64) ^ _odd(bands, 5)).view(np.int64)


def _runs(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    at, words = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return (word_runs(words[i:j], k) for i, j in zip(at[:-1], at[1:], strict=True))


def sketched(texts: DataFrame, k: int, hashes: int, bands: int) -> DataFrame:
    """The columns of ``texts`` but ``text``, and the ``size, key, bands`` of its set of ``k``-word shingles.

    Words are cut and hashed by Spark; runs and signatures are a few array operations a text. Neither texts nor sets leave the task.
    """
    rest = [(c, t) for c, t in texts.dtypes if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), set_key(s), run_bands(s, hashes, bands)) for s in _runs(b.column("words"), k)]
            own = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c, _ in rest), *own], names=[*(c for c, _ in rest), "size", "key", "bands"])

    schema = ", ".join(f"{c} {t}" for c, t in [*rest, ("size", "int"), ("key", "long"), ("bands", "array<long>")])
    return texts.select(*(c for c, _ in rest), word_hashes(F.col("text")).alias("words")).mapInArrow(run, schema)


def dealt(texts: DataFrame) -> DataFrame:
    """``texts`` (``id`` and more) dealt out evenly if they come in few parts, as few files would be few tasks; many parts are not shuffled for it."""
    few = texts.rdd.getNumPartitions() < 2 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition("id") if few else texts


def sets_of(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The columns of ``wanted`` (``id, key`` and more: a text of each set) and ``runs``, its set as hashes, cut anew from ``texts`` (``id, text``)."""
    rest = wanted.dtypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(_runs(b.column("words"), k))
            # an id may have other texts, too
            at = [i for i, key in enumerate(b.column("key").to_pylist()) if set_key(sets[i]) == key]
            own = b.select([c for c, _ in rest]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64()))], names=[*own.schema.names, "runs"])

    some = texts.join(wanted, "id").select(*(c for c, _ in rest), word_hashes(F.col("text")).alias("words"))
    return some.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*rest, ("runs", "array<long>")])).dropDuplicates(["key"])


def parts_of(banded: DataFrame, buckets: DataFrame) -> DataFrame:
    """``key, part``: the components of sets (``key, band``) that share bands. Each of ``buckets`` (``band, least``) links its sets to one key, so one of m sets costs m rows."""
    stars = banded.join(shuffled(buckets), "band").where("key <> least").select(F.col("least").alias("src"), F.col("key").alias("dst"))
    return connected_components(stars).withColumnsRenamed({"id": "key", "component": "part"})


def shared_runs(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The numbers of elements that each of ``left`` shares with each of ``right``, from products of 0/1 blocks."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    total = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, who in sides if len(common) else ():
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        kept = np.flatnonzero(common[at] == values)
        order = kept[np.argsort(at[kept], kind="stable")]
        places.append((at[order], who[order]))
    for lo in range(0, len(common), width):
        x, y = (np.zeros((len(s), min(width, len(common) - lo)), np.float32) for s in (left, right))
        for m, (at, who) in zip((x, y), places, strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            m[who[i:j], at[i:j] - lo] = 1
        total += x @ y.T
    return total.astype(np.int64)


def alike_in_parts(left: DataFrame, right: DataFrame, low: float, high: float, half: bool) -> DataFrame:
    """``x, y, similarity, alike``: the ids of sets of ``left`` and ``right`` (``part, key, id, mark, size, runs``) of one part and unlike keys, whose Jaccard similarity is ``low`` or more where marks are equal (``alike``), ``high`` or more elsewhere.

    Each side of a part is cut into blocks of bounded size and every two blocks meet in one task: a set is shuffled once a
    block of the other side, not once a pair. ``half``: both sides are the same, and pairs come one way round.
    """
    id_type = dict(left.dtypes)["id"]
    many = lambda t, c: t.groupBy("part").agg(F.ceil(F.sum(F.greatest("size", F.lit(MIN_RUNS))) / F.lit(BLOCK_RUNS)).cast("int").alias(c))
    blocks = write_table(many(left, "na").join(many(right, "nb"), "part"), "blocks")
    own = lambda n: F.pmod(F.xxhash64("key", F.lit(7)), F.col(n)).cast("int")
    each = lambda lo, hi: F.explode(F.sequence(lo, hi - 1))
    rest = ["key", "id", "mark", "runs"]
    x = left.join(blocks, "part").withColumn("a", own("na")).select("part", "a", each(F.col("a") if half else F.lit(0), F.col("nb")).alias("b"), *rest)
    y = right.join(blocks, "part").withColumn("b", own("nb")).select("part", each(F.lit(0), F.col("b") + 1 if half else F.col("na")).alias("a"), "b", *rest)

    def meet(s: pa.Table, t: pa.Table) -> pa.Table:
        i = j = np.empty(0, np.int64)
        similarity, alike = np.empty(0), np.empty(0, bool)
        if len(s) and len(t):
            sets = [[np.asarray(r, np.int64) for r in c["runs"].combine_chunks().to_numpy(zero_copy_only=False)] for c in (s, t)]
            shared = shared_runs(*sets)
            n, m = (np.array([len(r) for r in c]) for c in sets)
            union = n[:, None] + m[None, :] - shared
            # every set has an element
            scores = shared / union
            same = s["mark"].to_numpy()[:, None] == t["mark"].to_numpy()[None, :]
            k, o = s["key"].to_numpy()[:, None], t["key"].to_numpy()[None, :]
            once = (k < o) if half and s["a"][0] == s["b"][0] else (k != o)
            i, j = np.nonzero(once & (scores >= np.where(same, low, high)))
            similarity, alike = scores[i, j], same[i, j]
        return pa.table({"x": s["id"].take(pa.array(i)), "y": t["id"].take(pa.array(j)), "similarity": similarity, "alike": alike})

    keys = ["part", "a", "b"]
    # names of its own, as both sides may be one table
    y = y.toDF(*(f"{c}_" for c in y.columns)).toDF(*y.columns)
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(meet, f"x {id_type}, y {id_type}, similarity double, alike boolean")


def lsh_bands(signature: Column, bands: int, rows: int) -> Column:
    # the array around the signature makes it once, not once a band
    cut = lambda own: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(own, b * rows + 1, F.lit(rows))))
    return F.get(F.transform(F.array(signature), cut), F.lit(0))


def lsh_candidates(signed: DataFrame, bands: int = 20, rows: int = 5) -> DataFrame:
    """``a, b, hits`` of pairs of ``signed`` (``id, signature``) that share a band; ``a`` < ``b``. Equal signatures must have been folded before."""
    return _sharing(signed.select("id", F.explode(lsh_bands(F.col("signature"), bands, rows)).alias("band")))


def _sharing(own: DataFrame) -> DataFrame:
    """``a, b, hits`` of pairs of ``own`` (``id, band``) that share a band; ``a`` < ``b``."""
    return own.alias("x").join(own.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id"))).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("hits"))


def lsh_query(signed: DataFrame, asked: DataFrame, bands: int = 32, rows: int = 4, limit: int | None = 10) -> DataFrame:
    """``query, id, similarity, hits``: the best ``limit`` (None: all) of ``signed`` for each of ``asked`` (``id, signature``) among those that share a band. 32 bands of 4 rows find .999999 of pairs of similarity .8, .8 of those of .5."""
    index = signed.select("id", "signature", F.explode(lsh_bands(F.col("signature"), bands, rows)).alias("band"))
    q = asked.select(F.col("id").alias("query"), F.col("signature").alias("qs"), F.explode(lsh_bands(F.col("signature"), bands, rows)).alias("band"))
    hit = q.join(index, "band").where("query <> id").groupBy("query", "id").agg(F.count("*").alias("hits"), F.first("qs").alias("qs"), F.first("signature").alias("signature"))
    scored = hit.select("query", "id", signature_similarity(F.col("qs"), F.col("signature")).alias("similarity"), "hits")
    if limit is None:
        return scored
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), F.desc("hits"), "id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def similar_texts(texts: DataFrame, asked: DataFrame, threshold: float = 0.8, k: int = 5, hashes: int = 128, bands: int = 32) -> DataFrame:
    """``query, id, similarity``: all of ``texts`` (``id, text``) whose sets of ``k``-word shingles have a Jaccard similarity of ``threshold`` or more with one of ``asked`` (a stated set of queries, itself left out).

    Bands place sets in components, and all sets of a component are compared as sets of 64-bit hashes of shingles (:func:`alike_in_parts`).
    Texts with one set of shingles are folded before the bands, and come back by the key of their set. Sets of components with a query alone are shuffled.
    """
    own = lambda t: sketched(t.where("id IS NOT NULL").select("id", "text"), k, hashes, bands).where("size > 0")
    folded = lambda t: t.groupBy("key").agg(F.min_by(F.struct("id", "size", "bands"), "id").alias("s")).select("key", "s.id", "s.size", "s.bands")
    every, q = write_table(own(dealt(texts)), "similar"), write_table(own(asked), "similar-asked")
    sets, wanted = write_table(folded(every), "similar"), write_table(folded(q), "similar-asked")
    banded = lambda t: t.select("key", F.explode("bands").alias("band"))
    # only bands of queries link
    parts = write_table(parts_of(banded(sets).unionByName(banded(wanted)), banded(wanted).groupBy("band").agg(F.min("key").alias("least"))), "similar")
    found = lambda t, own: sets_of(t, write_table(own.join(parts, "key").select("id", "key", "size", "part"), "similar"), k).select("part", "key", F.col("key").alias("id"), F.lit(0).alias("mark"), "size", "runs")
    exact = alike_in_parts(write_table(found(asked, wanted), "similar"), write_table(found(texts, sets), "similar"), threshold, threshold, False)
    exact = exact.select(F.col("x").alias("qk"), F.col("y").alias("key"), "similarity")
    # copies need no look
    exact = write_table(exact.unionByName(wanted.select(F.col("key").alias("qk"), "key", F.lit(1.0).alias("similarity"))).where(F.col("similarity") >= threshold), "similar")
    return q.select(F.col("id").alias("query"), F.col("key").alias("qk")).join(exact, "qk").join(every.select("id", "key"), "key").where("query <> id").select("query", "id", "similarity")


def clones(texts: DataFrame, threshold: float = 0.8, k: int = 5, min_lines: int = 5, hashes: int = 100, bands: int = 25) -> DataFrame:
    """``a, b, similarity, kind, confidence`` of similar texts (``id, text``) of ``min_lines`` lines or more.

    LSH (25 bands of 4 rows: .97 of pairs at .6 share one, .9999 of those at .8) places texts in components, whose pairs are decided on their sets of shingles (as 64-bit hashes): exact from .95 on, structural (equal but
    for letters and digits) from .6 on, else near from ``threshold`` on; confidence is the similarity times 1, .8 and .9. Texts with
    one set of shingles are folded: each is paired with the least id of its set, and only these are compared.
    """
    # what is shuffled or written is keys, sizes, bands and, of candidates, sets
    some = texts.where(F.size(F.split("text", "\n")) >= min_lines).select("id", "text")
    own = dealt(some).select("id", F.xxhash64(F.regexp_replace("text", r"[A-Za-z0-9]+", "x")).alias("skeleton"), "text")
    own = write_table(sketched(own, k, hashes, bands), "clones")
    least = Window.partitionBy("key").orderBy("id")
    ranked = own.withColumn("first", F.first("id").over(least)).withColumn("rn", F.row_number().over(least))
    same = ranked.where("rn > 1").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"))
    one = write_table(ranked.where("rn = 1").drop("first", "rn"), "clones")
    banded = one.select("key", F.explode("bands").alias("band"))
    parts = parts_of(banded, write_table(banded.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "clones"))
    wanted = write_table(one.drop("bands").withColumnRenamed("skeleton", "mark").join(parts, "key"), "clones")
    sets = write_table(sets_of(some, wanted, k), "clones")
    scored = alike_in_parts(sets, sets, min(0.6, threshold), min(0.95, threshold), True).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity", "alike")
    scored = (
        write_table(scored, "clones")
        .withColumn("kind", F.when(F.col("similarity") >= 0.95, "exact").when(F.col("alike") & (F.col("similarity") >= 0.6), "structural").when(F.col("similarity") >= threshold, "near"))
        .where("kind IS NOT NULL").select("a", "b", "similarity", "kind")
    )
    factor = F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "structural", 0.8).otherwise(0.9)
    return same.unionByName(scored).withColumn("confidence", F.col("similarity") * factor)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or vectors of unlike lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _plain(vector: Column) -> Column:
    """``vector`` as doubles; null if an entry is."""
    return F.when(~F.exists(vector, lambda x: x.isNull()), vector.cast("array<double>"))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two matrices, added from the first column on as :func:`dot` adds."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s = s + x[:, j] * y[:, j]
    return s


def best_of_group(rows: pd.DataFrame, asked: pd.DataFrame, k: int, scaled: bool) -> pd.DataFrame:
    """``query, id, similarity``: the best ``k`` of ``rows`` (``id, vector``) for each of ``asked`` (``query, vector``), ties by id, itself left out.

    By cosine, or with ``scaled`` by plain dot products. A matrix product proposes what comes within rounding of the ``k``-th
    best; exact scores of these decide, added up as :func:`dot` does. Null vectors, and those of another length, score 0. Of equal vectors the least ids alone are looked at.
    """
    rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
    ids, names = rows["id"].to_numpy(), asked["query"].to_numpy()
    size = lambda c: np.array([-1 if v is None else len(v) for v in c], dtype=np.int64)
    own, wanted = size(rows["vector"]), size(asked["vector"])
    out = []
    for n in np.unique(wanted):
        x = np.zeros((len(rows), max(n, 0)))
        same = np.flatnonzero(own == n) if n > 0 else np.empty(0, np.int64)
        if len(same):
            x[same] = np.stack(rows["vector"].to_numpy()[same])
        fits = np.isin(np.arange(len(rows)), same)
        copies = pd.Series(pd.factorize(np.array([v.tobytes() + f.tobytes() for v, f in zip(x, fits, strict=True)], dtype=object))[0])
        kept = np.flatnonzero((copies.groupby(copies).cumcount() <= k).to_numpy())
        x, fits = x[kept], fits[kept]
        at = np.flatnonzero(wanted == n)
        y = np.stack(asked["vector"].to_numpy()[at]) if n > 0 else np.zeros((len(at), 0))
        with np.errstate(all="ignore"):
            nx, ny = (np.ones(len(x)), np.ones(len(y))) if scaled else (np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y)))
            ux, uy = (np.where((m > 0)[:, None] | np.isnan(m)[:, None], v / m[:, None], 0.0) for v, m in ((x, nx), (y, ny)))
            step = max(1, PRODUCT_CELLS // max(1, len(x)))
            for start in range(0, len(y), step):
                s = uy[start : start + step] @ ux.T
                # one more than k, as the query itself may be among them
                least = -np.partition(-s, k, axis=1)[:, k : k + 1] if s.shape[1] > k + 1 else np.full((len(s), 1), -np.inf)
                i, j = np.nonzero(~(s < least - ROUNDING))
                i = i + start
                other = ids[kept[j]] != names[at[i]]
                i, j = i[other], j[other]
                norm = nx[j] * ny[i]
                score = np.where(fits[j] & ((norm > 0) | np.isnan(norm)), _in_order(x[j], y[i]) / norm, 0.0)
                order = np.lexsort((j, np.where(np.isnan(score), -np.inf, -score), i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                top = np.arange(len(i)) - first < k
                out.append(pd.DataFrame({"query": names[at[i[top]]], "id": ids[kept[j[top]]], "similarity": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query": names[:0], "id": ids[:0], "similarity": np.zeros(0)})


def best_by_group(rows: DataFrame, asked: DataFrame, keys: list[str], k: int, scaled: bool) -> DataFrame:
    """``query, id, similarity``: the best ``k`` of each query over all groups of ``keys`` that ``rows`` (``keys, id, vector``) and ``asked`` (``keys, query, vector``) share. Each group is one call of :func:`best_of_group`, so it should be bounded."""
    t, u = dict(rows.dtypes), dict(asked.dtypes)
    schema = f"query {u['query']}, id {t['id']}, similarity double, odd boolean"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": right["query"][:0], "id": left["id"][:0], "similarity": np.zeros(0), "odd": np.zeros(0, bool)})
        found = best_of_group(left, right, k, scaled)
        return found.assign(odd=found["similarity"].isna())

    some = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(best, schema)
    # pandas has no NaN beside its nulls
    some = some.withColumn("similarity", F.when(F.col("odd"), float("nan")).otherwise(F.col("similarity"))).drop("odd")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return some.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("query", "id", "similarity")


def group_rows(vectors: DataFrame, most: int) -> int:
    """Rows of ``vectors`` (``vector``) that a group may have: ``most``, fewer if vectors are long."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    return max(1, min(most, GROUP_BYTES // (8 * max(1, longest))))


def nearest(vectors: DataFrame, asked: DataFrame, k: int, blocks: int = 8, where: Column | None = None) -> DataFrame:
    """``query, id, similarity``: the ``k`` nearest of ``vectors`` (``id, vector``) by cosine for each of ``asked``, itself left out.

    A stated query set against all rows, exactly: rows are dealt to parts of bounded size (``blocks`` of them at least), queries to
    blocks of bounded size, and each part meets each block in one matrix product (:func:`best_of_group`), which keeps the best ``k`` of a query.
    """
    base = (vectors if where is None else vectors.where(where)).where("id IS NOT NULL").select("id", _plain(F.col("vector")).alias("vector"))
    q = asked.where("id IS NOT NULL").select(F.col("id").alias("query"), _plain(F.col("vector")).alias("vector"))
    parts = max(blocks, -(-base.count() // group_rows(base, GROUP_ROWS)))
    many = -(-q.count() // group_rows(q, GROUP_QUERIES)) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    wide = base.select(dealt("id", parts).alias("part"), every(many).alias("block"), "id", "vector")
    wanted = q.select(every(parts).alias("part"), dealt("query", many).alias("block"), "query", "vector")
    return best_by_group(wide, wanted, ["part", "block"], k, False)


def fingerprint_similarity(a: str, b: str) -> Column:
    """Weighted similarity of two structural fingerprints, structs ``signature, params, returns, complexity, flow``.

    .40 for signatures; .15 each for the numbers of parameters and of results, for complexity and for the control flow. Numbers
    one apart get half; parts missing on either side drop out and the rest is scaled up.
    """
    part = lambda n: (F.col(f"{a}.{n}"), F.col(f"{b}.{n}"))
    near = lambda n: F.when(part(n)[0] == part(n)[1], 1.0).when(F.abs(part(n)[0] - part(n)[1]) == 1, 0.5).otherwise(0.0)
    s, t = part("signature")
    parts = [
        (0.40, signature_similarity(s, t), s.isNotNull() & t.isNotNull()),
        *((0.15, near(n), part(n)[0].isNotNull() & part(n)[1].isNotNull()) for n in ("params", "returns", "complexity")),
        (0.15, jaccard(*part("flow")), part("flow")[0].isNotNull() & part("flow")[1].isNotNull()),
    ]
    total = sum((F.when(ok, w * v).otherwise(0.0) for w, v, ok in parts), F.lit(0.0))
    weight = sum((F.when(ok, w).otherwise(0.0) for w, _, ok in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def color_refinement(nodes: DataFrame, edges: DataFrame, rounds: int | None = 10) -> DataFrame:
    """``id, color, settled``: labels (``id, label``) refined by the multisets of neighbours' colours, over edges both ways, until the number of colours stays.

    At most ``rounds`` rounds; ``settled`` says whether colours stayed by then. With None there is no bound: colours only
    ever split, so there are fewer rounds than nodes.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    colors = write_table(nodes.select("id", F.xxhash64("label").alias("color")), "wl")
    n, r, settled = colors.select("color").distinct().count(), 0, False
    while not settled and (rounds is None or r < rounds):
        # a sum of hashes stands for the multiset: no list of a hub's neighbours is gathered
        around = both.join(colors.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.xxhash64("color").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
        new = write_table(colors.join(around, "id", "left").select("id", F.xxhash64("color", "sum", "n").alias("color")), "wl")
        drop_table(colors)
        colors, m, r = new, new.select("color").distinct().count(), r + 1
        settled, n = m == n, m
    return colors.withColumn("settled", F.lit(settled))


def color_histogram(colors: DataFrame) -> DataFrame:
    """Two graphs of unlike histograms aren't isomorphic."""
    return colors.groupBy("color").agg(F.count("*").alias("n"))


def motif(edges: DataFrame, pattern: list[tuple[str, str]]) -> DataFrame:
    """All injective matches of a small pattern of directed edges: one column for each of its nodes (subgraph isomorphism by joins that the optimizer orders)."""
    e = edges.select("src", "dst").distinct()
    out: DataFrame | None = None
    for a, b in pattern:
        step = e.select(F.col("src").alias(a), F.col("dst").alias(b)) if a != b else e.where("src = dst").select(F.col("src").alias(a))
        out = step if out is None else out.join(step, [c for c in dict.fromkeys((a, b)) if c in out.columns])
    names = out.columns
    for i, x in enumerate(names):
        for y in names[:i]:
            out = out.where(F.col(x) != F.col(y))
    return out
