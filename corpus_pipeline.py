"""From raw documents to packed sequences: language ID, near-duplicate removal, redaction, packing.

Every stage works on all that the stage before it kept; run() writes each stage's rows and rereads them.

Defined cases, for every stage: documents with null text go in the first stage, as do empty ones and all others without
a letter; a null id, language or source is kept as it is, except that the first stage names the language; of repeated
rows, as of all near-duplicates, one stays, that of the least id (null last), of ties the least hash of the text; texts of
any length are worked on whole; an empty table gives an empty table; columns beside those of documents, whatever their
names, are handed on by all stages but the last, which returns the rows of packing.pack().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, packing, pii, simhash
from tessella.llm.common import cut, drop_cut, id_remainder, table, temporary, unpacked, whole_row

#: Documents go if they have no letters, or if their text is near no language's codeword or near two: a score below MIN_SCORE.
MIN_SCORE = 0.4

#: The stages learn, link and pack; SQL can express none of these. Tests hold run() against a plain version.
ORACLE_SQL = None


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told, with that language as their lang; learn from two thirds of the labelled ones."""
    seen = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(id_remainder(F.col("doc_id"), 3) != 1)
    # nondeterministic only so that Spark does not run it a second time, in other workers, for the filter
    predict = langid.predictor(langid.train(seen)).asNondeterministic()
    told = docs.select(whole_row(docs), predict(F.col("text")).alias("told"))
    kept = told.where((F.col("told.lang_pred") != "und") & (F.col("told.score") >= MIN_SCORE))
    return unpacked(kept, docs.columns, lang=F.col("told.lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group."""
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with temporary():
            docs = cut(stage(spark, before, sf_dir), f"pipeline-{name}", outlives=True)
        drop_cut(before)
    return docs
