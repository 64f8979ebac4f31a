"""Whether claims are borne out by their evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_terms, urls


def support(claim: Column, evidence: Column, context: Column) -> Column:
    """The share of the claim's content words that evidence or context have; 1 for a claim without any."""
    own = content_terms(claim)
    ground = F.array_union(content_terms(evidence), content_terms(context))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, ground)) / F.size(own))


def with_evidence(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (doc_id, ...) with the evidence of their documents (doc_id, evidence); of an unknown document the empty text."""
    return claims.join(docs.groupBy("doc_id").agg(F.max("evidence").alias("evidence")), "doc_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))


def judge(claims: DataFrame, threshold: float = 0.5, support_of=support) -> DataFrame:
    """claims (claim_id, claim, citation, evidence, context) with support, grounded, bad_citations and flagged.

    ``support_of`` may be any function of the columns (claim, evidence, context) that gives 0 to 1.
    """
    bad = F.filter(urls(F.col("claim")), lambda u: ~u.eqNullSafe(F.col("citation")))
    out = claims.select("claim_id", F.round(support_of(F.col("claim"), F.col("evidence"), F.col("context")), 6).alias("support"), F.size(bad).alias("bad_citations"))
    return out.select("claim_id", "support", (F.col("support") >= threshold).alias("grounded"), "bad_citations", ((F.col("support") < threshold) | (F.col("bad_citations") > 0)).alias("flagged"))


def rates(judged: DataFrame) -> DataFrame:
    """(n, citation_validity, groundedness, hallucination); without claims 1, 1 and 0."""
    share = lambda c, empty: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(empty)), 6)
    return judged.agg(F.count("*").alias("n"), share(F.col("bad_citations") == 0, 1.0).alias("citation_validity"), share(F.col("grounded"), 1.0).alias("groundedness"), share(F.col("flagged"), 0.0).alias("hallucination"))
