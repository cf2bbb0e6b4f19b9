"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, fill_middle, fingerprint, html_extract, line_dedup, mixing, ngram_join, pii_crf, quality_mil, quality_rules, token_orc, url_filter, whitening

TOKENIZER = "word_bpe_49k.json"
URL_ALLOW = ["org/", "com/fr/"]
URL_BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]
#: The second tier of the URL filter, a block list of hosts like those that such filters are fed: it decides where none of the rules fits.
URL_BLOCK_LIST = [f"{name}.example.{end}/" for name in ("ads-track", "casino-win", "spam-farm") for end in ("com", "net", "org")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "mix_source", "mix_tokens", "mix_epoch", "mix_block", "mix_pos")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_ALLOW, URL_BLOCK)
    method = url_filter.rule_table(spark, [], URL_BLOCK_LIST)
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules, method)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenize_to_orc(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_url_filter, op3_ngram_join, op4_quality_classifier, op5_token_files,
        op6_personal_data, op7_quality_rules, op8_html_extraction, op9_decontamination, op10_line_dedup,
        op11_fill_in_middle, op12_fingerprints, op13_whitening,
    )
}

_WORDS = """list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule, verdict, tier) AS (
  VALUES ('org/', 'allow', 0), ('com/fr/', 'allow', 0), ('example.org/es/', 'block', 0), ('example.org/en/1', 'block', 0), ('com/de/', 'block', 0),
         ('ads-track.example.com/', 'block', 1), ('ads-track.example.net/', 'block', 1), ('ads-track.example.org/', 'block', 1),
         ('casino-win.example.com/', 'block', 1), ('casino-win.example.net/', 'block', 1), ('casino-win.example.org/', 'block', 1),
         ('spam-farm.example.com/', 'block', 1), ('spam-farm.example.net/', 'block', 1), ('spam-farm.example.org/', 'block', 1)
), fits AS (
  SELECT p.page_id, u.rule, u.verdict, u.tier,
         row_number() OVER (PARTITION BY p.page_id, u.tier ORDER BY length(u.rule) DESC, u.rule) AS rn
  FROM parts p JOIN rules u
    ON (p.host = split_part(u.rule, '/', 1) OR ends_with(p.host, '.' || split_part(u.rule, '/', 1)))
   AND starts_with(p.path, substr(u.rule, strpos(u.rule, '/')))
)
SELECT p.page_id, p.host, p.path, a.rule, coalesce(a.verdict, b.verdict, 'allow') AS verdict, b.rule AS method_rule
FROM parts p
LEFT JOIN fits a ON a.page_id = p.page_id AND a.tier = 0 AND a.rn = 1
LEFT JOIN fits b ON b.page_id = p.page_id AND b.tier = 1 AND b.rn = 1
""",
    "op9_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i:i + 12], ' '))) AS win
  FROM items WHERE len(w) > 0
),
docs AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM docs, sizes WHERE len(w) >= n
),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words h USING (doc_id) LEFT JOIN named m USING (doc_id)
""",
    "op10_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), marked AS (
  SELECT doc_id, ls, list_filter(list_transform(ls, lambda x, i: {'s': regexp_replace(x, '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g'), 'i': i}), lambda x: x.s <> '') AS kept FROM lines
), places AS (
  SELECT doc_id, unnest(list_transform(generate_series(1, greatest(len(kept) - 2, 1)),
         lambda i: {'w': array_to_string(list_transform(kept[i:i + 2], lambda x: x.s), chr(10)), 'a': kept[i].i, 'b': kept[least(i + 2, len(kept))].i})) AS p
  FROM marked WHERE len(kept) > 0
), ranked AS (
  SELECT doc_id, p.a AS a, p.b AS b, row_number() OVER (PARTITION BY p.w ORDER BY doc_id, p.a) AS rn FROM places
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, unnest(generate_series(a, b)) AS k FROM ranked WHERE rn > 1) GROUP BY doc_id
)
SELECT l.doc_id, len(ls) AS n_lines, coalesce(len(g), 0) AS n_removed,
       array_to_string(CASE WHEN g IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(g, i)) END, chr(10)) AS text
FROM lines l LEFT JOIN gone USING (doc_id)
""",
    "op11_fill_in_middle": """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM docs
), cut AS (
  SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, CAST(least(c1, c2) AS BIGINT) AS a, CAST(greatest(c1, c2) AS BIGINT) AS b FROM drawn
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
}
