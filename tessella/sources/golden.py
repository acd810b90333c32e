"""Evaluation cases from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """id string, question string, expectedAnswer string, relevantChunkIds array<string>, relevantDocumentIds array<string>,
metadata map<string,string>, expectedTerms array<string>, tenantId string, expectedTermGroups array<array<string>>, expectNoEvidence boolean,
expectedClaims array<struct<id:string,alternatives:array<string>>>,
relevantEvidence array<struct<documentId:string,requiredTextGroups:array<array<string>>>>"""


def problems(cases: DataFrame) -> DataFrame:
    """(id, problem) of every case that can't be evaluated."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    positive = some("relevantChunkIds") | some("relevantDocumentIds") | some("expectedTerms") | some("expectedTermGroups") | some("expectedClaims") | some("relevantEvidence") | F.col("expectedAnswer").isNotNull()
    negative = F.coalesce("expectNoEvidence", F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = F.filter(
        F.array(
            F.when(blank("id"), "no id"),
            F.when(blank("question"), "no question"),
            F.when(negative & positive, "a case without evidence expects some"),
            F.when(~negative & ~positive, "nothing is expected"),
        ),
        lambda p: p.isNotNull(),
    )
    repeated = cases.groupBy("id").count().where("count > 1").select("id", F.lit("id occurs more than once").alias("problem"))
    return cases.select("id", F.explode(found).alias("problem")).union(repeated)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON array; malformed files and cases that can't be evaluated raise."""
    cases = spark.read.json(path, schema=SCHEMA, multiLine=True, mode="FAILFAST")
    bad = problems(cases).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return cases
