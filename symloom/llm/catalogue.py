"""Registered queries on training data, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.docpairs import described_functions
from symloom.llm.handwritten import EVIDENCE, file_evidence, foreign_files
from symloom.llm.leakage import leaked_items, leaks
from symloom.llm.spans import shared_characters, sharing_pairs
from symloom.llm.tokens import default_vocabulary, encode_documents, token_ids, token_text
from symloom.sources.tables import table


def _foreign(spark: SparkSession, folder: str) -> DataFrame:
    return foreign_files(*(table(spark, folder, t) for t in ("symbols", "source_files", "projects")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _foreign(spark, folder).select("file_path")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _foreign(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def p1_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Files by what each kind of evidence says of them, those of which nothing is said included."""
    found = file_evidence(*(table(spark, folder, t) for t in ("symbols", "source_files", "projects")))
    return found.groupBy(*EVIDENCE).agg(F.count(F.lit(1)).alias("n_files"))


def p1_handwritten_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols of hand-written files, each once."""
    symbols = table(spark, folder, "symbols").select("id", "projectId", "qualifiedName", "filePath").distinct()
    foreign = _foreign(spark, folder).select(F.col("file_path").alias("filePath"))
    return symbols.where("filePath IS NOT NULL").join(foreign, "filePath", "left_anti").select("id", "projectId", "qualifiedName", "filePath")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return described_functions(table(spark, folder, "symbols"), table(spark, folder, "source_files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pairs(spark, folder).select("symbol_id")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of each document, and whether its ids give its text again."""
    vocabulary = default_vocabulary()
    ids = table(spark, folder, "documents").select("doc_id", "text", token_ids("text", vocabulary).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), (F.coalesce("text", F.lit("")) == token_text("ids", vocabulary)).alias("same"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(p7_found(spark, folder), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sharing_pairs(table(spark, folder, "documents"))


def p8_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_characters(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_reasons": p1_reasons, "p1_evidence": p1_evidence, "p1_handwritten_symbols": p1_handwritten_symbols,
    "p5_found": p5_found, "p5_pairs": p5_pairs,
    "p6_ids": p6_ids, "p6_round_trip": p6_round_trip,
    "p7_found": p7_found, "p7_items": p7_items,
    "p8_found": p8_found, "p8_shared": p8_shared,
}

_WINDOWS = """WITH starts AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300),
windows AS (SELECT doc_id, i, md5(substring(text, i, 300)) AS h FROM starts),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
held AS (SELECT w.doc_id, w.i, w.h FROM windows w JOIN shared s ON s.h = w.h)"""

ORACLES: dict[str, str] = {
    "p8_found": _WINDOWS + "\nSELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p8_shared": _WINDOWS
    + """, covers AS (SELECT doc_id, least(300, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS n FROM (SELECT DISTINCT doc_id, i FROM held) u)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(c.n, 0) AS shared_chars FROM documents d LEFT JOIN (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM covers GROUP BY 1) c ON c.doc_id = d.doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
