"""Token ids in ORC: run-length encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, slices, text_bytes, worker_state
from graphloom.plans.tables import new_path

#: Words of a generation whose ids a worker keeps: those met since the last change of generations, and those of the generation before.
CACHE_WORDS = 300_000
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
#: ASCII punctuation but the apostrophe, which some tokenizers join to letters.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers use for each byte: itself where it is printable, else the next free one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class _Words(dict):
    """Ids by word. A word that isn't there is encoded and kept."""

    def __init__(self, make: Callable[[bytes], bytes], known: dict[bytes, bytes]):
        super().__init__(known)
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.make(word)
        return ids


class WordEncoder:
    """Encodes with the tokenizers library, once for each distinct piece of text.

    Where the tokenizer's tokens never span white space, pieces are what stands
    between ASCII blanks, with ASCII letters lower-cased if that changes no ids. A
    piece of lower-case letters, with or without ASCII punctuation after it, goes
    straight to the tokenizer's model; others go through all of it. Probes of the
    tokenizer decide each of these; without the first, texts are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young = _Words(self._word, {})
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []  # not to be kept
        self.hot: dict[bytes, bytes] = {}  # met in both generations: they start the next one
        same = lambda text, parts: self._ids([text])[0] == b"".join(self._ids(parts))
        self.by_word = all(same(t, t.split()) for t in ("a b", "ab  cd\n\nef", " x\t", "don't 42 !? é", "the the"))
        self.lower = all(same(t, [t.lower()]) for t in ("The QUICK", "É Él", "A1b"))
        self.direct = True
        self.direct = self.by_word and all(self._direct(w.encode()) == self._ids([w])[0] for w in ("word,", "the", "éa###", "ciónra.", "übergröße!!", 'ab"', "x", "日本語", "çà$$$", "ελληνικά)", "an.."))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _direct(self, word: bytes) -> bytes | None:
        """The ids of letters and the punctuation after them, from the model; None for other words."""
        stem = word.rstrip(_PUNCTUATION)
        if not self.direct:
            return None
        if stem.isalpha() and stem.islower():  # ASCII
            letters = stem.decode()
        else:
            letters = stem.decode("utf-8", "replace")
            if not letters.isalpha() or not unicodedata.is_normalized("NFC", letters) or letters != letters.lower():
                return None
        if len(stem) == len(word):
            return self._model(letters)
        return self._kept(stem, letters) + self._kept(word[len(stem) :], word[len(stem) :].decode())

    def _word(self, word: bytes) -> bytes:
        """The ids of a word that isn't in this generation."""
        if (ids := self.old.get(word)) is not None:
            self.hot[word] = ids
            return ids
        if len(word) > 48:
            self.long.append(word)
        else:
            ids = self._direct(word)
        return self._ids([word.decode("utf-8", "replace")])[0] if ids is None else ids

    def _kept(self, piece: bytes, text: str) -> bytes:
        if (got := self.young.get(piece)) is None:
            got = self.young[piece] = self.old.get(piece) or self._model(text)
        return got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if not self.by_word:
            return self._ids([t.decode("utf-8", "replace") for t in texts])
        if self.lower:
            texts = [t.lower() if b"<|" not in t else t for t in texts]  # special tokens keep their case
        get = self.young.__getitem__
        out = [b"".join(map(get, t.split())) for t in texts]
        for w in self.long:
            self.young.pop(w, None)
        self.long.clear()
        if len(self.young) > CACHE_WORDS:
            self.old, self.young, self.hot = self.young, _Words(self._word, self.hot if len(self.hot) < CACHE_WORDS // 2 else {}), {}
        return out


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state("tokens", path, lambda: WordEncoder(path))
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        start = 0
        for part in slices(batches, 512):
            texts = text_bytes(part.column("__text"))
            ids = [x + end for x in encoder.encode(texts)]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = start + np.concatenate([[0], np.cumsum(counts)])
            start = int(starts[-1])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("shard"), pa.array(starts[:-1]), pa.array(counts), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> str:
    """Encode ``docs`` and write them to ``path`` in ascending order of ``id_col``; returns ``path``.

    Rows have ``doc_id, shard, shard_start, n_tokens, ids``: shards are ranges of ids in order,
    each its own file or files, and ``shard_start`` counts the ids before the
    row in its shard. Integer columns and lists are run-length encoded; each
    stripe has a row index and a Bloom filter on ``doc_id``, so readers skip
    stripes by id and take stripes in parallel. Null texts are empty and have the end id alone; null
    ids come first; rows of one id come in order of their texts. Repeated rows stay. An empty table makes files without rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = (
        d.repartitionByRange(partitions, "doc_id", F.xxhash64("__text"))
        .sortWithinPartitions("doc_id", F.xxhash64("__text"), "__text")
        .withColumn("shard", F.spark_partition_id())
    )
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, shard int, shard_start long, n_tokens long, ids array<int>"
    map_batches(ranged, _encode(tokenizer_path, end_id), schema).write.options(**ORC_OPTIONS).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, schema: str = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>") -> DataFrame:
    """What :func:`write_tokens` wrote, with ``start``: the ids of all documents before the row. Reads no ids unless they are used.

    Starts of shards are summed on the driver from one row a shard; there are as many shards as partitions were written.
    """
    rows = spark.read.schema(schema).orc(path)
    sums = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = [], 0
    for shard, n in sums:
        offsets.append((shard, total))
        total += n
    base = F.broadcast(spark.createDataFrame(offsets, "shard int, shard_base long"))
    return rows.join(base, "shard").select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def find_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's tokens: the id is pushed to the stripes' indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id") == F.lit(doc_id))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        at = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(values)).cast("B")
        sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of :func:`read_tokens`: the CRC-32 is of the ids as little-endian unsigned 32-bit integers."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return map_batches(tokens, _checksums, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def tokenize_to_orc(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and return their digest as read back."""
    spark = docs.sparkSession
    at = write_tokens(docs, tokenizer_path, path or new_path(spark, "tokens"), id_col, text_col, end_id)
    id_type = docs.schema[id_col].dataType.simpleString()
    return token_digest(read_tokens(spark, at, f"doc_id {id_type}, shard int, shard_start long, n_tokens long, ids array<int>"))
