"""BM25 over a DataFrame of documents, for a DataFrame of queries."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .graph import checkpointed

K1, B = 1.5, 0.75
#: Tables of queries are broadcast up to so many bytes, and joined by shuffle beyond.
MOST_BROADCAST = 32 << 20


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term), distinct; queries: (qid, query)."""
    return queries.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def checked(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """small, to be broadcast if its values take at most ``most`` bytes when written out."""
    size = small.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))) + 32), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= most else small


def doc_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, dl): the number of terms of each document."""
    return docs.select("doc_id", F.size(terms(F.col("text"))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return doc_stats(docs).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


@dataclass
class Index:
    """postings: (term, doc_id, tf, dl, dn); n and avgdl are of all documents, those without terms too."""

    postings: DataFrame
    n: int
    avgdl: float

    def save(self, folder: str) -> None:
        """The postings sorted by term within their files, so that a reader skips what it does not ask for, and the statistics."""
        spark = self.postings.sparkSession
        self.postings.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        spark.createDataFrame([(self.n, self.avgdl)], "n long, avgdl double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


def load(spark, folder: str) -> Index:
    stats = spark.read.parquet(f"{folder}/stats").first()
    return Index(spark.read.parquet(f"{folder}/postings"), stats["n"], stats["avgdl"])


def build(docs: DataFrame, only: DataFrame | None = None) -> Index:
    """The index of docs (doc_id, text), or of the given terms (term) alone.

    The texts are tokenised once: what comes of it, the postings and one row
    of lengths of each document, is written to the shared folder.
    """
    own = docs.select("doc_id", terms(F.col("text")).alias("w"))
    own = own.select("doc_id", F.size("w").cast("long").alias("dl"), F.size(F.array_distinct("w")).cast("long").alias("dn"), "w")
    rows = own.select("doc_id", "dl", "dn", F.explode(F.array_append("w", F.lit(None).cast("string"))).alias("term"))
    if only is not None:  # other terms go before anything is shuffled
        rows = rows.join(checked(only.select("term").distinct().withColumn("asked", F.lit(True))), "term", "left").filter("asked OR term IS NULL")
    rows = checkpointed(rows.groupBy("doc_id", "dl", "dn", "term").agg(F.count("*").alias("tf")))
    # rows of one id count one by one
    lengths = rows.filter("term IS NULL").agg(F.sum("tf").alias("n"), F.sum(F.col("dl") * F.col("tf")).alias("t")).first()
    n = lengths["n"] or 0
    return Index(rows.filter("term IS NOT NULL").select("term", "doc_id", "tf", "dl", "dn"), n, (lengths["t"] or 0) / max(1, n))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    rows = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, n_docs) -> DataFrame:
    """(term, df, idf)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log1p((n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))


def indexed(docs: DataFrame | Index, wanted: DataFrame) -> Index:
    return docs if isinstance(docs, Index) else build(docs, wanted)


def bm25(docs: DataFrame | Index, queries: DataFrame, top: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, rank) over documents or their index: scores to six digits; ties by doc_id."""
    wanted = query_terms(queries)
    index = indexed(docs, wanted)
    rows = index.postings.join(checked(wanted.select("term").distinct()), "term", "left_semi")
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl or 1.0))
    weights = checkpointed(idf(rows, F.lit(index.n)).select("term", "idf"))
    parts = rows.join(checked(weights), "term").select("doc_id", "term", (F.col("idf") * F.col("tf") * F.lit(k1 + 1) / norm).alias("part"))
    scores = parts.join(checked(wanted), "term").groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return ranked(scores, top)


def ranked(scores: DataFrame, top: int, key: str = "doc_id") -> DataFrame:
    """The best ``top`` rows of each qid with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
