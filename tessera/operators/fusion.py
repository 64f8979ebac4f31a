"""Reciprocal rank fusion, hybrid retrieval by several signals, and the recommendation policy."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .graph import checkpointed
from .keyword import Index, bm25, build, checked, indexed, query_terms, ranked
from .linking import link
from .vectors import exact_topk

RRF_K, POOL, RERANK, GATE = 60, 50, 10, 0.35
#: What a refusal and a result say.
NOTHING = "No evidence-backed candidates found; nothing to recommend."
HUMAN = "Shortlist only. A person reviews and decides."
NO_BACKER = "an unnamed organization"


def overlap(docs: DataFrame | Index, queries: DataFrame, top: int = POOL) -> DataFrame:
    """(qid, doc_id, score, rank) by the cosine of the sets of terms, over documents or their index."""
    wanted = query_terms(queries)
    postings = indexed(docs, wanted).postings
    qn = wanted.groupBy("qid").agg(F.count("*").alias("qn"))
    shared = postings.join(checked(wanted), "term").groupBy("qid", "doc_id", "dn").agg(F.count("*").alias("both"))
    cosine = F.col("both") / F.sqrt(F.col("qn") * F.col("dn").cast("double"))
    return ranked(shared.join(checked(qn), "qid").select("qid", "doc_id", F.round(cosine, 6).alias("score")), top)


def centroid(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, v): of each query the mean of its members' vectors, of unit length; queries whose members have no vector have no row.

    members: (qid, node_id); vectors: (node_id, v).
    """
    each = members.join(vectors, "node_id").select("qid", F.posexplode("v").alias("dim", "x"))
    mean = each.groupBy("qid", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-9)
    return mean.groupBy("qid").agg(v.alias("v")).select("qid", F.transform("v", lambda x: x / norm).alias("v"))


def graph_search(linked: DataFrame, vectors: DataFrame, node_rows: DataFrame, top: int = POOL) -> DataFrame:
    """(qid, doc_id, score, rank): technologies by their vectors' inner product with the centroid of what a query names; a query that names nothing abstains.

    linked: (qid, node_id); vectors: (node_id, v); node_rows: (node_id, doc_id).
    Every query that names something is held against every technology, as exact search is.
    """
    asked = checkpointed(centroid(linked, vectors)).withColumnRenamed("v", "q")
    documents = node_rows.filter("doc_id IS NOT NULL").select("node_id", "doc_id").join(vectors, "node_id").select("doc_id", "v")
    return exact_topk(documents, asked, top)


def fire_rate(queries: DataFrame, linked: DataFrame) -> DataFrame:
    """(n, fired, rate): how many queries name something in the graph."""
    rows = queries.select("qid").join(linked.select("qid").distinct().withColumn("hit", F.lit(1)), "qid", "left")
    rate = F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), F.count("hit").alias("fired"), F.round(rate, 6).alias("rate"))


def fuse(lists: dict[str, DataFrame], top: int = POOL, k: int = RRF_K) -> DataFrame:
    """(qid, doc_id, score, rank, <signal>_score...): the sum of 1 / (k + rank) over the lists; a missing signal scores 0."""
    every = reduce(DataFrame.unionByName, [x.select("qid", "doc_id", "rank", "score", F.lit(name).alias("signal")) for name, x in lists.items()])
    signals_ = [F.round(F.coalesce(F.max(F.when(F.col("signal") == name, F.col("score"))), F.lit(0.0)), 6).alias(f"{name}_score") for name in lists]
    # distinct ranks are summed in order, so that equal sets of ranks give equal sums
    total = F.aggregate(F.array_sort(F.collect_list(F.lit(1.0) / (F.lit(float(k)) + F.col("rank")))), F.lit(0.0), lambda a, x: a + x)
    fused = every.groupBy("qid", "doc_id").agg(F.round(total, 9).alias("score"), *signals_)
    return ranked(fused, top)


def signals(
    docs: DataFrame, queries: DataFrame, use_keyword: bool = True, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, top: int = POOL
) -> dict[str, DataFrame]:
    """The ranked lists of a retrieval: text, keyword if asked for, and graph if its (surfaces, vectors, nodes) are given. The texts are tokenised once."""
    index = build(docs, query_terms(queries).select("term").distinct())
    lists = {"text": overlap(index, queries, top)}
    if use_keyword:
        lists["keyword"] = bm25(index, queries, top)
    if graph is not None:
        surfaces, vectors, node_rows = graph
        lists["graph"] = graph_search(link(queries, surfaces), vectors, node_rows, top)
    return lists


def rerank(pool: DataFrame, cut: int = RERANK, score: Column | None = None) -> DataFrame:
    """The first ``cut`` of each query by a score, the fused one if none is given; ties by doc_id."""
    rows = pool if score is None else pool.withColumn("score", score)
    return ranked(rows.drop("rank"), cut)


def hybrid(docs: DataFrame, queries: DataFrame, top: int = POOL, cut: int = RERANK, use_keyword: bool = True, graph=None) -> DataFrame:
    """(qid, doc_id, score, rank, <signal>_score...) fused from the signals and cut, with the document's columns other than its text, and a snippet of that.

    With a graph, graph_linked says whether the query names something in it.
    """
    lists = signals(docs, queries, use_keyword, graph, top)
    pool = rerank(fuse(lists, top), cut)
    if graph is not None:
        named = link(queries, graph[0]).select("qid").distinct().withColumn("linked", F.lit(True))
        pool = pool.join(checked(named), "qid", "left").withColumn("graph_linked", F.coalesce("linked", F.lit(False))).drop("linked")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    told = docs.select("doc_id", *rest, F.substring(strip(F.col("text")), 1, 160).alias("snippet"))
    pool = checkpointed(pool)
    found = told.join(checked(pool.select("doc_id").distinct()), "doc_id", "left_semi")  # only these documents are told on
    return pool.join(found, "doc_id", "left")


def evidence(candidates: DataFrame) -> Column:
    """Whether a candidate has text and an address, as far as it has a column for that."""
    has = F.length("snippet") > 0
    if "source_url" in candidates.columns:
        has = has & (F.length("source_url") > 0)
    return F.coalesce(has, F.lit(False))


def confidence(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def gated(candidates: DataFrame, gate: float = GATE) -> DataFrame:
    """(qid, n_kept, confidence, refusal): whether the evidence of a query suffices.

    Candidates without text or address are no evidence; a query without any,
    or with a confidence below the gate, is refused. One equal to it passes.
    """
    kept = candidates.withColumn("kept", evidence(candidates))
    out = kept.groupBy("qid").agg(F.count_if("kept").alias("n_kept"), F.coalesce(F.max(F.when(F.col("kept"), F.col("text_score"))), F.lit(0.0)).alias("top"))
    out = out.withColumn("confidence", confidence(F.col("top")))
    hundredths = F.floor((F.round(F.col("confidence") * 10_000).cast("long") + 50) / 100)
    shown = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    low = F.concat(F.lit("Top confidence "), shown, F.lit(f" below threshold {gate}; flagged for human review rather than asserted."))
    reason = F.when(F.col("n_kept") == 0, NOTHING).when(F.col("confidence") < gate, low)
    return out.select("qid", "n_kept", "confidence", reason.alias("refusal"))


def with_gaps(candidates: DataFrame) -> DataFrame:
    """candidates with expertise_gap: no organization stands behind the document (organizations: array)."""
    return candidates.withColumn("expertise_gap", F.coalesce(F.size("organizations"), F.lit(0)) <= 0)


def explained(query: Column, title: Column, organizations: Column, snippet: Column, url: Column) -> Column:
    """One claim with its citation, of retrieved evidence alone."""
    backer = F.coalesce(F.nullif(F.get(organizations, F.lit(0)), F.lit("")), F.lit(NO_BACKER))
    text = F.regexp_replace(F.substring(snippet, 1, 160), r"\s+$", "")
    said = (F.lit("Relevant to '"), query, F.lit("': "), title, F.lit(" from "), backer, F.lit('. Supporting evidence: "'), text, F.lit('..." [source: '), url, F.lit("]"))
    return F.concat(*said)


def recommend(candidates: DataFrame, queries: DataFrame, gate: float = GATE, via: str = "tessera/hybrid", explain=explained) -> DataFrame:
    """(qid, query, overall_confidence, refusal, num_expertise_gaps, recommendations, human_in_the_loop) of every query.

    candidates: (qid, doc_id, score, text_score, title, organizations, snippet,
    source, source_url). Gaps are counted over all candidates; then those
    without evidence go. Those with a backer come first, then by score and
    doc_id. Of a query that is refused, or has no candidates, the
    recommendations are the empty array. ``explain`` may be any function of
    the columns (query, title, organizations, snippet, source_url).
    """
    rows = checkpointed(with_gaps(candidates).join(checked(queries.select("qid", "query")), "qid"))
    gates = gated(rows, gate)
    gaps = rows.groupBy("qid").agg(F.count_if("expertise_gap").alias("gaps"))
    order = Window.partitionBy("qid").orderBy(F.col("expertise_gap").cast("int"), F.desc("score"), "doc_id")
    why = explain(F.col("query"), F.col("title"), F.col("organizations"), F.col("snippet"), F.col("source_url"))
    kept = rows.filter(evidence(rows)).withColumn("place", F.row_number().over(order))
    provenance = F.struct("source", F.lit(via).alias("retrieved_via")).alias("provenance")
    one = F.struct("place", "doc_id", "title", why.alias("why"), F.col("source_url").alias("citation"), confidence(F.col("text_score")).alias("confidence"), provenance, "expertise_gap")
    told = kept.select("qid", one.alias("one")).groupBy("qid").agg(F.sort_array(F.collect_list("one")).alias("found"))
    out = queries.select("qid", "query").join(gates, "qid", "left").join(gaps, "qid", "left").join(told, "qid", "left")
    refusal = F.when(F.col("n_kept").isNull(), NOTHING).otherwise(F.col("refusal"))
    none = F.array().cast(told.schema["found"].dataType)
    return out.select(
        "qid", "query", F.coalesce("confidence", F.lit(0.0)).alias("overall_confidence"), refusal.alias("refusal"),
        F.coalesce("gaps", F.lit(0)).cast("long").alias("num_expertise_gaps"),
        F.when(refusal.isNull(), F.coalesce("found", none)).otherwise(none).alias("recommendations"), F.lit(HUMAN).alias("human_in_the_loop"),
    )


