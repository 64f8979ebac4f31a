"""Exact dense retrieval, and encoders of texts."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import hash_bucket, instructed, strip
from .graph import checkpointed
from .keyword import ranked

DIM = 1024
#: Bytes of vectors in a block; a block of queries and one of documents meet in a task, with their product.
BLOCK_BYTES = 16 << 20


def blocks(rows: DataFrame, key: str, vector: str, block_bytes: int) -> int:
    """How many blocks of about that many bytes the vectors make, as doubles."""
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.size(vector), F.lit(0)) + 2), F.lit(0))).first()[0] * 8
    return max(1, math.ceil(size / block_bytes))


def exact_topk(vectors: DataFrame, queries: DataFrame, top: int = 10, dim: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, doc_id, score, rank) by inner product, to six digits; ties by doc_id.

    vectors: (doc_id, v); queries: (qid, q). Both are dealt in blocks by their
    bytes; each block of queries meets each block of vectors in a task of its
    own, by one matrix product in parts of bounded size, and passes on no more
    than ``top`` rows a query. So the plan is one join whatever the number of
    queries, and a vector is sent as often as there are blocks of queries.
    """
    n_q, n_v = blocks(queries, "qid", "q", block_bytes), blocks(vectors, "doc_id", "v", block_bytes)
    ids = {"qid": queries.schema["qid"].dataType.simpleString(), "doc_id": vectors.schema["doc_id"].dataType.simpleString()}
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    double = lambda c: F.col(c).cast("array<double>").alias(c)
    left = queries.select("qid", double("q"), part("qid", n_q).alias("a"), every(n_v).alias("b")).withColumn("cell", F.col("a") * n_v + F.col("b"))
    right = vectors.select("doc_id", double("v"), part("doc_id", n_v).alias("b"), every(n_q).alias("a")).withColumn("cell", F.col("a") * n_v + F.col("b"))
    left, right = (x.repartitionById(n_q * n_v, F.col("cell")) for x in (left.select("qid", "q", "cell"), right.select("doc_id", "v", "cell")))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.stack(column.to_numpy())[:, :dim] if len(column) else np.empty((0, 0))

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        best = []
        if own.num_rows and others.num_rows:
            others = others.sort_by("doc_id")
            q, v = matrix(own.column("q")), matrix(others.column("v"))
            step = max(1, block_bytes // (8 * len(v)))
            for at in range(0, len(q), step):
                score = np.round(q[at : at + step] @ v.T, 6) + 0.0
                place = np.argsort(-score, axis=1, kind="stable")[:, :top]
                at_ = np.repeat(np.arange(at, at + len(score)), place.shape[1])
                best.append((at_, place.ravel(), np.take_along_axis(score, place, 1).ravel()))
        a, b, s = (np.concatenate(x) for x in zip(*best)) if best else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
        return pa.table({"qid": own.column("qid").take(pa.array(a)), "doc_id": others.column("doc_id").take(pa.array(b)), "score": pa.array(s)})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, f"qid {ids['qid']}, doc_id {ids['doc_id']}, score double")
    return ranked(found, top)


def dense_topk(vectors: DataFrame, queries: DataFrame, top: int = 10, dim: int | None = None) -> DataFrame:
    """exact_topk of vectors (doc_id, embedding) and queries (qid, embedding), over their first ``dim`` dimensions."""
    return exact_topk(vectors.select("doc_id", F.col("embedding").alias("v")), queries.select("qid", F.col("embedding").alias("q")), top, dim)


def hashed_bow(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc_id, bucket, value): each distinct word of three characters at least adds 1 to its bucket; unit length."""
    words = F.filter(F.array_distinct(F.split(strip(F.lower("text")), r"\s+")), lambda w: F.length(w) >= 3)
    hits = docs.select("doc_id", F.explode_outer(words).alias("word")).filter("word IS NOT NULL")
    hits = hits.groupBy("doc_id", hash_bucket(F.col("word"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return hits.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("value"))


def mock_embedding(dim: int = DIM, batch: int | None = None):
    """An Arrow UDF: seeded noise of 0.05 plus hashed words, of unit length; equal texts get equal vectors, whatever the batch."""

    @pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd

        def vector(text: str) -> np.ndarray:
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % 2**32
            v = np.random.default_rng(seed).standard_normal(dim) * 0.05
            for token in {t for t in text.lower().split() if len(t) >= 3}:
                v[int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % dim] += 1.0
            norm = np.linalg.norm(v)
            return (v / (norm if norm else 1.0)).astype(np.float32)

        texts = list(texts.fillna(""))
        step = batch or max(1, len(texts))
        return pd.Series([vector(t) for at in range(0, len(texts), step) for t in texts[at : at + step]], dtype=object)

    return embed


class MockEncoder:
    """Documents and queries are encoded alike: its words are hashed, so an instruction would only be noise."""

    def __init__(self, dim: int = DIM, batch: int | None = None):
        self.dim, self.embed = dim, mock_embedding(dim, batch)

    def documents(self, text: Column) -> Column:
        return self.embed(text)

    def queries(self, text: Column) -> Column:
        return self.embed(text)


class ModelEncoder:
    """A sentence encoder, if its library is installed; queries go with an instruction, documents without."""

    def __init__(self, name: str, task: str, batch: int = 64):
        import importlib.util

        if importlib.util.find_spec("sentence_transformers") is None:
            raise RuntimeError("sentence_transformers is not installed")
        self.task = task

        @pandas_udf("array<float>")
        def embed(texts):
            import pandas as pd
            from sentence_transformers import SentenceTransformer

            kept = globals().setdefault("_encoders", {})
            if name not in kept:
                kept[name] = SentenceTransformer(name)
            return pd.Series(list(kept[name].encode(list(texts.fillna("")), batch_size=batch, normalize_embeddings=True)))

        self.embed = embed

    def documents(self, text: Column) -> Column:
        return self.embed(text)

    def queries(self, text: Column) -> Column:
        return self.embed(instructed(text, self.task))


#: Encoders by name; others may be added.
ENCODERS: dict[str, Callable] = {"mock": MockEncoder, "model": ModelEncoder}


def encoder(kind: str = "mock", /, **parameters):
    return ENCODERS[kind](**parameters)


def embedded(docs: DataFrame, encode: MockEncoder | ModelEncoder, text_col: str = "embedding_text") -> DataFrame:
    """(doc_id, embedding) of docs."""
    return docs.select("doc_id", encode.documents(F.col(text_col)).alias("embedding"))


def drift(texts: DataFrame, reference: Callable[[Column], Column], other: Callable[[Column], Column]) -> DataFrame:
    """(n, max_cosine_drift, max_difference, exact) between two encodings of texts (text); an empty table has no drift."""
    rows = texts.select(reference(F.col("text")).alias("a"), other(F.col("text")).alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    out = rows.agg(F.count("*").alias("n"), F.max(F.abs(F.lit(1.0) - dot)).alias("c"), F.max(gap).alias("d"), F.every(F.col("a") == F.col("b")).alias("e"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return out.select("n", zero(F.col("c")).alias("max_cosine_drift"), zero(F.col("d")).alias("max_difference"), F.coalesce("e", F.lit(True)).alias("exact"))


def save_vectors(vectors: DataFrame, docs: DataFrame, path: str) -> int:
    """vectors (doc_id, embedding) as Parquet of float32, and their number; raises if documents and vectors are not the same ids."""
    rows = checkpointed(vectors.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding")))
    both = rows.groupBy("doc_id").agg(F.count("*").alias("v")).join(docs.groupBy("doc_id").agg(F.count("*").alias("d")), "doc_id", "full")
    odd = both.filter("NOT v <=> d").count()
    if odd:
        raise ValueError(f"{odd} ids have not as many vectors as documents")
    rows.write.mode("overwrite").parquet(path)
    return rows.count()


def load_vectors(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
