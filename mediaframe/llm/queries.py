"""Registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credential_scan as cs
from . import decontaminate as dc
from . import exact_dedup as ed
from . import html_main, jaccard_join, langid
from . import lattice_lm as lm
from . import piece_transducer as pt
from . import license_scan as ls
from . import quality, spelling, toxicity, whitening
from .common import table


def op1_lattice_lm(spark: SparkSession, sf_dir: str, model: str = pt.MODEL) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2, remainder(7) == 2, class_col="lang", model=model)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.judge(dc.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.digest(cs.scan_credentials(table(spark, sf_dir, "documents")))


def remainder(n: int) -> F.Column:
    """The part of the fixed folds that a document is in."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder(4) != 2))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(remainder(3) != 1), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False)))


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = pt.MODEL) -> DataFrame:
    return pt.tokenize(table(spark, sf_dir, "documents"), model=model)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.filter(remainder(4) != 2), table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.digest(ls.scan_licenses(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_credential_scan": op3_credential_scan,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_html_main": op6_html_main,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

WORD2 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op2_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD2}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD2}') AS w FROM benchmark),
        i2 AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i2)),
        ks AS (SELECT DISTINCT k FROM win),
        dg AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks)),
        hit AS (SELECT dg.doc_id, dg.p, dg.k, win.item_id FROM dg JOIN win USING (k, gram)),
        pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
}
