"""Quality rules whose cutoffs are certified on labelled documents by exact binomial tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.llm.common import every, map_batches, slices, text_bytes
from graphloom.plans.tables import write_table

SYMBOLS = b"#*$%&|<>"
#: Rules by name; each is a share from 0 to 1 and a document fails above the cutoff.
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
}
#: What a rejected share of good documents weighs against one of bad documents when a cutoff is chosen, on labels that don't certify it.
FALSE_COST = 10
#: Cutoffs are tried on this fixed grid, from mild to strict.
GRID = [i / 50 for i in range(49, 0, -1)]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def text_stats(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """Counts of one text, as in STATS. Words are split by ASCII white space."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(triples) > len(distinct := set(triples)):
        once: set = set()
        twice = {t for t in triples if t in once or once.add(t)}
        end = 0
        for i, t in enumerate(triples):
            if t in twice:
                repeated += i + 3 - max(i, end)
                end = i + 3
    del triples
    return (
        len(words),
        len(joined.decode("utf-8", "replace")) if not joined.isascii() else len(joined),
        sum(map(joined.count, (bytes([c]) for c in SYMBOLS))),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for b in slices(batches):
        rows = [text_stats(t) for t in text_bytes(b.column("__text"))]
        cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "__text"]
        kept = [n for n in b.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays(
            cols + [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=kept + names
        )


def with_stats(docs: DataFrame, id_col: str, text_col: str, stratum: Column, keep: bool = False) -> DataFrame:
    """``doc_id``, ``stratum`` and the counts of STATS for each document; with ``keep``, before them the columns of ``docs`` as ``__in_<number>``."""
    d = docs.select(
        *(c.alias(f"__in_{i}") for i, c in enumerate(every(docs) if keep else [])), F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("__text")
    )
    own = StructType([f for f in d.schema.fields if f.name != "__text"])
    return map_batches(d, _stats, StructType(own.fields + StructType.fromDDL(STATS).fields))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial in n and p, by exact summation."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


Counts = dict[tuple[str, str, int], list[int]]


def _above(counts: Counts, stratum: str, rule: str) -> tuple[int, int, list[tuple[int, int]]]:
    """The good and the bad documents, and those above each cutoff of GRID."""
    cells = [counts.get((stratum, rule, i), [0, 0]) for i in range(len(GRID) + 1)]
    fp = tp = 0
    out = []
    for c in cells[:-1]:
        fp, tp = fp + c[0], tp + c[1]
        out.append((fp, tp))
    return sum(c[0] for c in cells), sum(c[1] for c in cells), out


def choose_cutoffs(counts: Counts, strata: list[str], max_false_rejection: float) -> dict[tuple[str, str], int]:
    """The place in GRID of each stratum's and rule's best cutoff: that of the best balance (share of bad less FALSE_COST times the share of good rejected) within ``max_false_rejection``, the mildest of equals. Rules without a positive balance are left out."""
    out = {}
    for s in strata:
        for rule in RULES:
            good, bad, above = _above(counts, s, rule)
            best = 0.0
            for i, (fp, tp) in enumerate(above):
                if good and bad and fp <= max_false_rejection * good and (balance := tp / bad - FALSE_COST * fp / good) > best + 1e-12:
                    best, out[s, rule] = balance, i
    return out


def certify_cutoffs(counts: Counts, chosen: dict[tuple[str, str], int], max_false_rejection: float, confidence: float) -> dict[tuple[str, str], float]:
    """The cutoff of each stratum and rule that is certified: the chosen one, or the strictest milder one.

    ``counts[stratum, rule, i]`` has the good and the bad documents whose value
    is above GRID[i] and, but for i = 0, not above GRID[i - 1]; i = len(GRID) has the rest.
    A cutoff is certified if the exact binomial test rejects, at the level of
    its stratum and rule, that the rule rejects over its part of ``max_false_rejection`` (the same for each
    chosen rule of the stratum) of good documents. Levels are ``(1 - confidence)`` by the number of chosen
    strata and rules (Bonferroni) and each grid is tested in fixed sequence from mild to
    strict, stopping at the first that fails. None of ``counts`` may have been used to choose.
    """
    out: dict[tuple[str, str], float] = {}
    for (s, rule), last in chosen.items():
        part = max_false_rejection / sum(x == s for x, _ in chosen)
        good, _, above = _above(counts, s, rule)
        for cutoff, (fp, _) in zip(GRID[: last + 1], above, strict=False):
            if not good or binomial_tail(fp, good, part) > (1 - confidence) / len(chosen):
                break
            out[s, rule] = cutoff
    return out


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    strata: tuple[str, ...] = ("de", "en", "es", "fr"),
    max_false_rejection: float = 0.02,
    confidence: float = 0.95,
    keep: bool = False,
) -> DataFrame:
    """One row per document: id, stratum, the counts of STATS, ``base_failed``, ``rule`` (the first rule that it fails, else null) and ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1: good, 0: bad). Labelled
    documents that pass the base rules are halved by a hash of their ids: one half chooses rules and cutoffs, the
    other, which has no part in that, certifies them. With probability ``confidence``, the share
    of good documents that the rules reject is at most ``max_false_rejection``
    in every stratum. Values of ``stratum_col`` outside ``strata``, nulls too,
    form the stratum "other". Null and empty texts have no words and fail the
    base rules. Repeated rows and ids are judged row by row; a labelled id counts once however many rows it has, in each
    rule by the greatest value among them, and once for each of its labels if they differ. Null labels don't count. Without labels
    no cutoff is certified and the base rules decide alone. Extra columns are ignored.

    With ``keep``, the columns of ``docs`` come back as ``__in_<number>``.

    Counts are taken once and written down; labels join them, not the texts. The
    holdout is read as counts by stratum, rule and grid cell: some thousand
    rows whatever the input's size. With ``keep``, a second pass over the texts carries those columns.
    """
    known = [*strata, "other"]
    stratum = F.when(F.col(stratum_col).isin(*strata), F.col(stratum_col)).otherwise("other")
    stats = write_table(with_stats(docs, id_col, text_col, stratum), "quality-stats")
    judged = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    held = stats.where(~base_failed()).join(judged, F.col("doc_id") == F.col("__id"))
    held = held.groupBy("doc_id", "stratum", "quality").agg(*(F.max(F.expr(f)).alias(r) for r, f in RULES.items()))
    cell = lambda rule: F.lit(len(GRID)) - F.size(F.filter(F.lit(GRID), lambda g: F.col(rule) > g))
    half = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)).alias("half")
    cells = held.select(half, "stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), cell(r).alias("cell")) for r in RULES))).alias("x"))
    halves: tuple[Counts, Counts] = ({}, {})
    for r in cells.groupBy("half", "stratum", "quality", "x.rule", "x.cell").count().collect():
        halves[r["half"]].setdefault((r["stratum"], r["rule"], r["cell"]), [0, 0])[1 - r["quality"]] += r["count"]
    cutoffs = certify_cutoffs(halves[1], choose_cutoffs(halves[0], known, max_false_rejection), max_false_rejection, confidence)
    failed = F.lit(None).cast("string")
    for (s, rule), cutoff in sorted(cutoffs.items(), reverse=True):
        failed = F.when((F.col("stratum") == s) & (F.expr(RULES[rule]) > cutoff), F.lit(rule)).otherwise(failed)
    if keep:
        stats = with_stats(docs, id_col, text_col, stratum, True)
    return (
        stats.withColumn("base_failed", base_failed())
        .withColumn("rule", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, in all their columns, that :func:`quality_rules` keeps."""
    judged = quality_rules(docs, labels, keep=True, **options)
    return judged.where("kept").select(*(F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)))
