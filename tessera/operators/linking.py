"""Linking of entity names in queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import surface_key

LINKABLE = ["organization", "inventor", "expert", "facility"]
#: Words too general to stand for an entity alone.
GENERIC = "university medical center institute inc corp llc ltd company co the of and school college hospital labs laboratory laboratories".split()


def surfaces(nodes: DataFrame) -> DataFrame:
    """(surface, node_id): full names, and single words that belong to one entity only.

    A word counts if it is not generic, has three characters at least and is no full name.
    """
    names = nodes.filter(F.col("ntype").isin(LINKABLE)).select(surface_key(F.coalesce(F.nullif("label", F.lit("")), F.expr("substring(node_id, instr(node_id, ':') + 1)"))).alias("surface"), "node_id").filter("surface <> ''").distinct()
    words = names.select(F.explode(F.array_distinct(F.split("surface", " "))).alias("word"), "node_id").filter(~F.col("word").isin(GENERIC) & (F.length("word") >= 3))
    alone = words.groupBy("word").agg(F.min("node_id").alias("low"), F.max("node_id").alias("high")).filter("low = high").select(F.col("word").alias("surface"), F.col("low").alias("node_id"))
    return names.unionByName(alone.join(names.select("surface").distinct(), "surface", "left_anti"))


def link(queries: DataFrame, index: DataFrame, longest: int = 4) -> DataFrame:
    """(qid, node_id) by the longest surfaces from left to right, words being used once; queries without a link have no row."""
    words = queries.select("qid", F.split(surface_key(F.col("query")), " ").alias("w"))
    spans = words.select("qid", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i")).select("qid", "w", "i", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).filter("i + n <= size(w)")
    spans = spans.select("qid", "i", "n", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("surface"))
    found = spans.join(index.select("surface").distinct(), "surface").groupBy("qid", "i").agg(F.max(F.struct("n", "surface")).alias("best"))
    taken = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "best.n", "best.surface"))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate("s", zero, lambda a, x: F.when(x["i"] >= a["end"], F.struct((x["i"] + x["n"]).alias("end"), F.array_append(a["out"], x["surface"]).alias("out"))).otherwise(a), lambda a: a["out"])
    return taken.select("qid", F.explode(kept).alias("surface")).join(index, "surface").select("qid", "node_id").distinct()
