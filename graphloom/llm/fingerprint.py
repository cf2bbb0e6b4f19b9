"""Document fingerprints that add up: sums of wide vectors hashed from paragraphs, modulo powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.tables import write_table

#: Lanes that tell texts apart: 32-bit groups of a paragraph's SHA-512, summed modulo 2**EXACT_BITS.
EXACT_LANES, EXACT_BITS = 16, 32
#: Lanes that measure likeness: random signs of a paragraph's word shingles, summed modulo 2**LIKE_BITS.
LIKE_LANES, LIKE_BITS = 128, 24
#: Words of a shingle.
SHINGLE = 5
#: Bits k and k + 32 of a hash, summed as two counts in one number.
_PAIR = (1 << 32) + 1
_WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines, blank ones too. An empty or null text has one empty paragraph."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _word_hashes(paragraph: Column) -> Column:
    lower = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, _WORD_BREAKS, -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingle_hashes(words: Column) -> Column:
    """``words`` must be a column of the plan below, as each shingle reads it."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.slice(words, F.lit(1), F.size(words) - (SHINGLE - 1)), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE)))),
    ).when(F.size(words) > 0, F.array(F.xxhash64(words)))


def sum_fingerprints(texts: DataFrame, *keys: str, text_col: str = "text", fold: bool = False) -> DataFrame:
    """``keys``, ``exact`` and ``like``: the lanes of all texts of a key, summed.

    Every paragraph is hashed by itself, so the lanes of two texts add up to those of
    the texts together (:func:`combined`). ``exact``: 16 lanes of 32 bits from the
    paragraph's SHA-512. ``like``: 128 lanes, in each the sum of random signs of the paragraph's five-word shingles
    (a paragraph of fewer words, but not none, is one shingle). With ``fold``, all rows of
    a key have one text, which counts once: the sums are divided by the number of rows.

    A paragraph's shingles are rows that are summed at once in a hash aggregate, before any shuffle: memory follows
    the number of keys in a task, not the length of texts.
    """
    one = texts.select(*keys, F.posexplode(paragraphs(F.col(text_col))).alias("__i", "__p"))
    words = one.select(*keys, "__i", F.sha2("__p", 512).alias("__sha"), _word_hashes(F.col("__p")).alias("__w"))
    hashed = words.select(*keys, "__i", "__sha", _shingle_hashes(F.col("__w")).alias("__g"))
    rows = hashed.select(*keys, "__i", "__sha", F.posexplode_outer("__g").alias("__at", "__h"))
    first = F.coalesce("__at", F.lit(0)) == 0
    rows = rows.select(*keys, (first & (F.col("__i") == 0)).alias("__row"), F.when(first, F.col("__sha")).alias("__sha"), "__h", F.xxhash64("__h", F.lit(1)).alias("__h1"))
    group = lambda i: F.conv(F.substring("__sha", 8 * i + 1, 8), 16, 10).cast("long")
    bits = lambda h, k: F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(_PAIR))
    sums = rows.groupBy(*keys).agg(
        F.count_if("__row").alias("__rows"),
        F.count("__h").alias("__n"),
        *(F.sum(group(i)).alias(f"__e{i}") for i in range(EXACT_LANES)),
        *(F.sum(F.when(F.col("__h").isNotNull(), bits(h, k))).alias(f"__{h[2:]}_{k}") for h in ("__h", "__h1") for k in range(32)),
    )
    share = (lambda c: F.call_function("div", c, F.col("__rows"))) if fold else (lambda c: c)

    def signs(h: str, k: int, high: bool) -> Column:
        both = F.coalesce(F.col(f"__{h}_{k}"), F.lit(0))
        ones = F.shiftright(both, 32) if high else both.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.pmod(share(2 * ones - F.col("__n")), F.lit(1 << LIKE_BITS)).cast("int")

    return sums.select(
        *keys,
        F.array(*(F.pmod(share(F.coalesce(f"__e{i}", F.lit(0))), F.lit(1 << EXACT_BITS)) for i in range(EXACT_LANES))).alias("exact"),
        F.array(*(signs(h, k, high) for h in ("h", "h1") for high in (False, True) for k in range(32))).alias("like"),
    )


def combined(a: Column, b: Column, bits: int, sign: int = 1) -> Column:
    """The lanes of ``a`` with those of ``b`` inserted, or with sign -1 deleted."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y.cast("long"), F.lit(1 << bits)))


def encoded(exact: Column, like: Column) -> Column:
    """A fingerprint as text: 8 hex digits for each exact lane, 6 for each likeness lane."""
    digits = lambda lanes, bits: F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), bits // 4, "0")), "")
    return F.concat(digits(exact, EXACT_BITS), digits(like, LIKE_BITS))


def _signed(v: Column) -> Column:
    return F.when(v >= 1 << (LIKE_BITS - 1), v - (1 << LIKE_BITS)).otherwise(v).cast("double")


def likeness(like_a: Column, like_b: Column, same: Column) -> Column:
    """How like two fingerprints are, 0 to 1: twice the shared shingles over all of both, as the lanes estimate it.

    The lanes' products estimate how many shingles two multisets share, with a standard error
    of about 1 / sqrt(LIKE_LANES). ``same`` (equal exact lanes) gives 1; texts without words are alike only then.
    """
    total = lambda lanes: F.aggregate(lanes, F.lit(0.0), lambda a, b: a + b)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: _signed(x) * _signed(y)))
    size = dot(like_a, like_a) + dot(like_b, like_b)
    return F.when(same, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(like_a, like_b) / size)))


def _document_key(doc_id: Column, text: Column) -> Column:
    """32 bytes that name a document: its id and text."""
    return F.unhex(F.sha2(F.concat(F.when(doc_id.isNull(), "null").otherwise(F.concat(F.lit("="), doc_id.cast("string"))), F.lit("\n"), text), 256))


def following(keys: DataFrame) -> DataFrame:
    """``keys`` (``key, doc_id`` and more) with ``next_key``: the one after it in the order of falling ids, null ids last, then rising keys; after the last comes the first.

    Keys are dealt out by ranges; a window looks ahead within each, and the first keys of the ranges, one row each, say what follows their ends.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").asc()]
    dealt = write_table(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "fingerprint-keys")
    ahead = "lead(key) OVER (PARTITION BY range ORDER BY doc_id DESC NULLS LAST, key)"
    within = dealt.withColumn("next_key", F.expr(ahead))
    # one row for each range, by its first key
    firsts = dealt.groupBy("range").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), F.col("key"))).alias("first"))
    after = firsts.selectExpr("range", "coalesce(lead(first) OVER (ORDER BY range), first_value(first) OVER (ORDER BY range)) AS after")
    return within.join(F.broadcast(after), "range").withColumn("next_key", F.coalesce("next_key", "after")).drop("range", "after")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last third of the code points (rounded down) replaced by as many of the
    start of the next document, or all of it if it is shorter. The next document is the one of the
    next lower id (null ids are lowest); after the last comes the first, and a lone document follows itself.
    Ids must be numbers. Rows of one id with different texts are documents of their own, in the order of a SHA-256
    of id and text; repeated rows are one document, and each gets its row. Null texts are
    empty. Empty tables are fine; other columns are ignored.

    Built-in functions alone. Fingerprints of the texts as they are come from sums that are folded before their
    shuffle, repeated rows too. For the edits, texts are shuffled once, by document,
    starts of the next texts go to their documents, and lanes are summed where they then lie.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", _document_key(F.col("doc_id"), F.col("text")))
    keys = texts.groupBy("key", "doc_id", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies"))
    ordered = write_table(following(keys), "fingerprint-order")
    own = write_table(sum_fingerprints(texts, "key", fold=True), "fingerprints")
    whole = texts.groupBy("key").agg(F.first("text").alias("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    starts = whole.withColumnRenamed("key", "next_key").join(ordered, "next_key").select("key", "doc_id", "n_chars", "copies", F.substring("text", F.lit(1), third).alias("start"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), "start")
    carried = ["key", "doc_id", "n_chars", "copies", "edited_sha"]
    made = whole.join(starts, "key").withColumn("text", edited).withColumn("edited_sha", F.unhex(F.sha2("text", 256)))
    made = sum_fingerprints(made, *carried).withColumnsRenamed({"exact": "edited_exact", "like": "edited_like"})
    later = own.select(F.col("key").alias("next_key"), F.xxhash64("exact").alias("next_exact"), F.col("like").alias("next_like"))
    pairs = ordered.select("key", "next_key").join(later, "next_key").drop("next_key")
    return made.join(own.join(pairs, "key"), "key").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        encoded(F.col("exact"), F.col("like")).alias("fingerprint"), encoded(F.col("edited_exact"), F.col("edited_like")).alias("edited_fingerprint"),
        likeness(F.col("like"), F.col("edited_like"), F.col("exact") == F.col("edited_exact")).alias("near_edited"),
        likeness(F.col("like"), F.col("next_like"), F.xxhash64("exact") == F.col("next_exact")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
