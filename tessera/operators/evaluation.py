"""Ranking metrics, intervals, paired tests, AUC and agreement of rankings."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import prefix
from .keyword import checked

KS, MAIN = (1, 5, 10, 20, 50), 10
#: Up to so many differences that are neither zero nor tied the test is exact.
EXACT = 50


def ir_metrics(ranking: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, main: int = MAIN) -> DataFrame:
    """One row per qid of relevant: recall at ks, and precision, MRR and nDCG at main, and MAP.

    ranking: (qid, doc_id, rank); relevant: (qid, doc_id). A query without hits scores 0.
    """
    rel = relevant.select("qid", "doc_id", F.lit(1).alias("rel"))
    total = relevant.groupBy("qid").agg(F.count("*").alias("r"))
    hits = ranking.join(rel, ["qid", "doc_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    at = lambda k: F.count_if(F.col("rank") <= k)
    per = hits.groupBy("qid").agg(
        *(at(k).alias(f"h{k}") for k in sorted({*ks, main})), F.min(F.when(F.col("rank") <= main, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= main, F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0)))).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(main)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return total.join(per, "qid", "left").select(
        "qid", *(zero(F.col(f"h{k}") / F.col("r")).alias(f"recall_{k}") for k in ks), zero(F.col(f"h{main}") / F.lit(float(main))).alias(f"p_{main}"),
        zero(F.lit(1.0) / F.col("first")).alias(f"mrr_{main}"), zero(F.col("dcg") / ideal).alias(f"ndcg_{main}"), zero(F.col("ap") / F.col("r")).alias("map"),
    )


def long_form(metrics: DataFrame) -> DataFrame:
    """(qid, metric, value)."""
    return metrics.unpivot("qid", [c for c in metrics.columns if c != "qid"], "metric", "value")


def bootstrap(values: DataFrame, n_boot: int = 1000, ci: float = 0.95, seed: int = 7) -> DataFrame:
    """(metric, mean, lo, hi): percentiles of means of resamples, drawn by an MD5 of (seed, resample, draw).

    values: (metric, qid, value). The resamples are joined as counts of ranks, never as copies of rows.
    """
    numbered = prefix(values.select("metric", "qid", "value"), ["metric"], ["qid"], F.lit(1)).select("metric", "value", F.col("upto").alias("i"))
    numbered = numbered.join(checked(values.groupBy("metric").agg(F.count("*").alias("n"))), "metric")
    sizes = values.groupBy("metric").agg(F.count("*").alias("n")).select("n").distinct()
    draws = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select("n", "b", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    times = draws.withColumn("i", pick).groupBy("n", "b", "i").agg(F.count("*").alias("times"))
    means = numbered.join(times, ["n", "i"]).groupBy("metric", "b").agg((F.sum(F.col("value") * F.col("times")) / F.max("n")).alias("m"))
    tail = (1 - ci) / 2
    bounds = means.groupBy("metric").agg(F.round(F.percentile("m", tail), 6).alias("lo"), F.round(F.percentile("m", 1 - tail), 6).alias("hi"))
    return values.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean")).join(bounds, "metric")


def exact_tails(most: int = EXACT) -> list[tuple[int, int, float]]:
    """(m, w, p): the two-sided probability that the smaller rank sum of m differences is w or less; from the number of sets of ranks with each sum."""
    out, ways = [], [1]
    for m in range(1, most + 1):
        longer = [0] * (len(ways) + m)
        for total, n in enumerate(ways):
            longer[total] += n
            longer[total + m] += n
        ways, below = longer, 0
        for w in range(m * (m + 1) // 4 + 1):
            below += ways[w]
            out.append((m, w, min(1.0, 2 * below / 2**m)))
    return out


def normal_tails(z: Column) -> Column:
    """Two-sided probability of a normal deviate, within 2e-7, by a polynomial in 1 / (1 + 0.2316419 |z|)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    series = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = (series + F.lit(c)) * t
    return F.lit(2.0) * F.lit(0.3989422804014327) * F.exp(-z * z / F.lit(2.0)) * series


def signed_rank(pairs: DataFrame) -> DataFrame:
    """(metric, n, delta, w, z, p): the Wilcoxon statistic of cand - base, zeros dropped, average ranks for ties.

    pairs: (metric, qid, base, cand). p is exact for at most EXACT differences
    without zeros and ties, else by the normal approximation; 1 without a
    difference. Differences are taken to six digits, and ranks come from the
    counts of distinct ones, of which metrics from 0 to 1 have 10**6 at most.
    """
    d = pairs.withColumn("d", F.round(F.col("cand") - F.col("base"), 6))
    by = d.filter("d <> 0").groupBy("metric", F.abs("d").alias("size")).agg(F.count("*").alias("ties"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = prefix(by, ["metric"], ["size"], F.col("ties")).withColumn("rk", F.col("upto") + (F.col("ties") + 1) / F.lit(2.0))
    s = ranked.groupBy("metric").agg(
        F.sum("ties").alias("m"), F.sum(F.col("up") * F.col("rk")).alias("wp"), F.sum((F.col("ties") - F.col("up")) * F.col("rk")).alias("wn"),
        F.sum(F.col("ties") * (F.col("ties") * F.col("ties") - 1)).alias("t"),
    )
    mean, var = F.col("m") * (F.col("m") + 1) / F.lit(4.0), F.col("m") * (F.col("m") + 1) * (2 * F.col("m") + 1) / F.lit(24.0) - F.col("t") / F.lit(48.0)
    z = F.when(var > 0, (F.least("wp", "wn") - mean) / F.sqrt(var))
    all_ = d.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("delta"))
    out = all_.join(s.select("metric", "m", "t", F.least("wp", "wn").alias("w"), z.alias("z")), "metric", "left")
    tails = pairs.sparkSession.createDataFrame(exact_tails(), "m long, sum long, exact double")  # EXACT**3 / 12 rows, whatever the data
    whole = (F.col("t") == 0) & (F.col("m") == F.col("n"))
    out = out.withColumn("sum", F.when(whole, F.col("w").cast("long"))).join(F.broadcast(tails), ["m", "sum"], "left")
    p = F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(F.coalesce("exact", normal_tails(F.col("z"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("metric", "n", "delta", zero(F.col("w")).alias("w"), zero(F.round("z", 6)).alias("z"), F.round(p, 6).alias("p"))


def paired_delta(pairs: DataFrame, n_boot: int = 1000, ci: float = 0.95, seed: int = 7) -> DataFrame:
    """(metric, n, delta, lo, hi, w, z, p): signed_rank, and the interval of the mean difference over resamples of the queries."""
    spread = bootstrap(pairs.select("metric", "qid", F.round(F.col("cand") - F.col("base"), 6).alias("value")), n_boot, ci, seed).select("metric", "lo", "hi")
    return signed_rank(pairs).join(spread, "metric").select("metric", "n", "delta", "lo", "hi", "w", "z", "p")


def marginal_pairs(measured: DataFrame) -> DataFrame:
    """(metric, qid, base, cand) with metric as "baseline|candidate|metric": each system beside the one before it.

    measured: (ix, system, qid, metric, value), ix counting the systems from 0.
    """
    base = measured.select((F.col("ix") + 1).alias("ix"), F.col("system").alias("baseline"), "qid", "metric", F.col("value").alias("base"))
    both = measured.join(base, ["ix", "qid", "metric"])
    return both.select(F.concat_ws("|", "baseline", "system", "metric").alias("metric"), "qid", "base", F.col("value").alias("cand"))


def p_value(z: float) -> float:
    """Two-sided, of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def verdict(delta: Column, p: Column, alpha: float = 0.05) -> Column:
    """helps, hurts or no significant difference; by the test alone."""
    return F.when((p < alpha) & (delta > 0), "helps").when((p < alpha) & (delta < 0), "hurts").otherwise("no significant difference")


def roc_auc(scores: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc) of (score, is_pos): average ranks for ties; null if a side is empty.

    Ranks come from counts by distinct score, dealt by ranges of the score.
    """
    return auc_of(scores.groupBy("score").agg(F.count_if("is_pos").alias("p"), F.count("*").alias("c")))


def auc_of(by: DataFrame) -> DataFrame:
    """The same of (score, p, c): of each score how many are positive, and how many in all."""
    ranks = prefix(by, [], ["score"], F.col("c")).select("p", "c", ((F.col("upto") + (F.col("c") + 1) / F.lit(2.0)) * F.col("p")).alias("r"))
    out = ranks.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("c") - F.sum("p"), F.lit(0)).alias("n_neg"), F.sum("r").alias("r"))
    auc = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos") * F.col("n_neg").cast("double"))
    return out.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(auc, 6)).alias("auc"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, jaccard, tau, same_order) of two rankings (qid, doc_id, rank) per query."""
    x = a.select("qid", "doc_id", F.col("rank").alias("ra"))
    y = b.select("qid", "doc_id", F.col("rank").alias("rb"))
    both = x.join(y, ["qid", "doc_id"], "full")
    sets = both.groupBy("qid").agg((F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()) / F.count("*")).alias("jaccard"), F.every(F.col("ra").eqNullSafe(F.col("rb"))).alias("same_order"))
    shared = both.filter("ra IS NOT NULL AND rb IS NOT NULL").groupBy("qid").agg(F.collect_list(F.struct("ra", "rb")).alias("s"))
    pairs = F.aggregate("s", F.lit(0.0), lambda t, p: t + F.aggregate(F.col("s"), F.lit(0.0), lambda u, q: u + F.signum((p["ra"] - q["ra"]).cast("double") * (p["rb"] - q["rb"]))))
    n = F.size("s").cast("double")
    tau = shared.select("qid", F.when(n > 1, F.round(pairs / (n * (n - 1)), 6)).alias("tau"))
    return sets.join(tau, "qid", "left").select("qid", F.round("jaccard", 6).alias("jaccard"), "tau", "same_order")


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def kendall(a: Column, b: Column) -> Column:
    """Kendall's tau of the places that the shared members of two rankings (arrays without repeats) have; null with fewer than two."""
    spots = F.transform(F.array_intersect(a, b), lambda x: F.struct(F.array_position(a, x).alias("p"), F.array_position(b, x).alias("q")))

    def signs(s: Column) -> Column:
        one = lambda x, y: F.signum(((x["p"] - y["p"]) * (x["q"] - y["q"])).cast("double"))
        total = F.aggregate(s, F.lit(0.0), lambda t, x: t + F.aggregate(s, F.lit(0.0), lambda u, y: u + one(x, y)))
        n = F.size(s).cast("double")
        return F.when(n > 1, total / (n * (n - 1)))

    return F.element_at(F.transform(F.array(spots), signs), 1)


def run_pairs(runs: DataFrame, *columns: str) -> DataFrame:
    """(qid, a_<column>..., b_<column>...) for every two runs of a query, the earlier first; runs: (run, qid, columns)."""
    a = runs.select("qid", F.col("run").alias("a_run"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = runs.select("qid", F.col("run").alias("b_run"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, "qid").filter("a_run < b_run")


def retrieval_stability(runs: DataFrame) -> DataFrame:
    """(qid, mean_jaccard, mean_kendall_tau, exact_order_match_rate) over every two runs of a query; 1 where there are no two.

    runs: (run, qid, doc_id, rank).
    """
    lists = runs.groupBy("run", "qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("l"))
    a, b = F.col("a_l"), F.col("b_l")
    each = run_pairs(lists, "l").select("qid", set_jaccard(a, b).alias("j"), kendall(a, b).alias("t"), (a == b).cast("double").alias("e"))
    means = each.groupBy("qid").agg(F.avg("j").alias("j"), F.avg("t").alias("t"), F.avg("e").alias("e"))
    one = lambda c, name: F.round(F.coalesce(c, F.lit(1.0)), 6).alias(name)
    names = (("j", "mean_jaccard"), ("t", "mean_kendall_tau"), ("e", "exact_order_match_rate"))
    return runs.select("qid").distinct().join(means, "qid", "left").select("qid", *(one(F.col(c), n) for c, n in names))


def explanation_stability(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """(n, answered, refusal_rate, exact_match_rate, mean_semantic_equivalence, citation_set_jaccard, grounded, citation_validity, hallucination).

    runs: (run, qid, prose, citations, vector) with the vector of the prose, of
    unit length; claims: (run, qid, grounded, bad_citations), judged. A query
    is answered if one of its runs has a claim; faithfulness is the mean over
    answered queries of the mean over runs, and null without any.
    """
    dot = F.aggregate(F.zip_with("a_vector", "b_vector", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    each = run_pairs(runs, "prose", "citations", "vector").select(
        "qid", (F.col("a_prose") == F.col("b_prose")).cast("double").alias("e"), dot.alias("s"), set_jaccard(F.col("a_citations"), F.col("b_citations")).alias("j")
    )
    means = each.groupBy("qid").agg(F.avg("e").alias("e"), F.avg("s").alias("s"), F.avg("j").alias("j"))
    share = lambda c: F.avg(c.cast("double"))
    told = claims.groupBy("run", "qid").agg(share(F.col("grounded")).alias("g"), share(F.col("bad_citations") == 0).alias("v"))
    rates = runs.select("run", "qid").join(told, ["run", "qid"], "left").groupBy("qid").agg(
        F.max(F.col("g").isNotNull()).alias("answered"), F.avg(F.coalesce("g", F.lit(1.0))).alias("g"), F.avg(F.coalesce("v", F.lit(1.0))).alias("v"), F.avg(F.coalesce(F.lit(1.0) - F.col("g"), F.lit(0.0))).alias("h")
    )
    rows = rates.join(means, "qid", "left")
    one = lambda c, name: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(1.0))), F.lit(1.0)), 6).alias(name)
    of_answered = lambda c, name: F.round(F.avg(F.when(F.col("answered"), F.col(c))), 6).alias(name)
    return rows.agg(
        F.count("*").alias("n"), F.count_if("answered").alias("answered"), F.round(F.coalesce(F.lit(1.0) - F.avg(F.col("answered").cast("double")), F.lit(0.0)), 6).alias("refusal_rate"),
        one(F.col("e"), "exact_match_rate"), one(F.col("s"), "mean_semantic_equivalence"), one(F.col("j"), "citation_set_jaccard"),
        of_answered("g", "grounded"), of_answered("v", "citation_validity"), of_answered("h", "hallucination"),
    )


def encoding_stability(texts: DataFrame, encode, batches: tuple[int, ...] = (1, 8, 32)) -> DataFrame:
    """(batch, n, max_cosine_drift, max_difference, exact): encodings by batches of these sizes against the whole batch.

    texts: (text); encode(batch) gives a function of a text column, the whole batch for None.
    """
    from .vectors import drift

    parts = [drift(texts, encode(None), encode(size)).select(F.lit(size).alias("batch"), "*") for size in batches]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
