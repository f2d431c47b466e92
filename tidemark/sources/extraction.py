"""Checking what a model extracted: strict JSON, quotes that stand in the source, no claims out of suspicious paragraphs.

The call of a model isn't part of this; its answers come as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

MOST, DEFAULT_CONFIDENCE = 200, 0.5
ANSWER = "struct<claims:array<struct<subject:string,predicate:string,object_kind:string,object:string,quote:string,confidence:double>>>"


def candidates(answers: DataFrame) -> DataFrame:
    """Claims of answers (id, source, answer) with their ``outcome``.

    Answers that aren't of the form give one row ``malformed``; of one with more than ``MOST`` claims all are ``too_many``.
    A blank subject or predicate is ``incomplete``, a quote that isn't in the source ``ungrounded``; one inside a suspicious
    paragraph is ``quarantined``; the rest is ``accepted``. A missing or non-positive confidence is one half.
    """
    parsed = answers.withColumn("a", F.from_json("answer", ANSWER)).withColumn("n", F.size("a.claims"))
    bad = F.coalesce(F.col("n") < 0, F.lit(True)) | F.col("a.claims").isNull()
    rows = parsed.withColumn("c", F.explode_outer("a.claims"))
    c = lambda k: F.col("c")[k]
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    tainted = F.exists(text.suspicious_paragraphs(F.col("source")), lambda p: text.grounded(p, c("quote")))
    outcome = (
        F.when(bad, "malformed").when(F.col("n") > MOST, "too_many").when(blank(c("subject")) | blank(c("predicate")), "incomplete")
        .when(~F.coalesce(text.grounded(F.col("source"), c("quote")), F.lit(False)), "ungrounded").when(F.coalesce(tainted, F.lit(False)), "quarantined").otherwise("accepted")
    )
    confidence = F.when(c("confidence") > 0, F.least(c("confidence"), F.lit(1.0))).otherwise(DEFAULT_CONFIDENCE)
    kept = rows.filter(bad | (F.col("n") > 0))
    return kept.select("id", c("subject").alias("subject"), text.normalize_predicate(c("predicate")).alias("predicate"), c("object_kind").alias("object_kind"), c("object").alias("object"), c("quote").alias("quote"), confidence.alias("confidence"), outcome.alias("outcome"))


def locate(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk of its document that holds each quote: quotes (quote_id, document, quote), chunks (document, sequence, content)."""
    hit = quotes.join(chunks, "document").filter(text.grounded(F.col("content"), F.col("quote")))
    return hit.groupBy("quote_id").agg(F.min("sequence").alias("sequence"))
