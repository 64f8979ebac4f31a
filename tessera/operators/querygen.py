"""Synthetic queries: evaluation sets and query-document pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_words, norm_query, plain_title_words, strip
from .graph import checkpointed
from .keyword import checked

FRAMES = ["methods for {}", "approaches to {}", "evidence on {}", "studies about {}", "applications of {}"]
#: Templates of lay queries, and what fills them.
TEMPLATES = [
    "therapy targeting {kw} for {ind}", "{mod} for {ind} available for licensing", "partner with technology for {kw}",
    "treatment approach involving {kw}", "{kw} candidate for clinical development",
]
INDICATIONS = ["oncology", "autoimmune disease", "rare disease", "metabolic disorders", "neurology", "inflammatory conditions"]
MODALITIES = ["small molecule", "biologic", "delivery platform", "antibody", "gene therapy", "cell therapy"]
NO_KEYWORD = "novel therapeutic"


def framed(number: Column, words: Column) -> Column:
    frames = F.array(*(F.lit(f) for f in FRAMES))
    return F.replace(F.get(frames, (number % len(FRAMES)).cast("int")), F.lit("{}"), words)


def eval_set(docs: DataFrame, n: int = 200, seed: int = 11, least_df: int = 2, most_share: float = 0.3, words: int = 5) -> DataFrame:
    """(query_id, query, doc_id): n documents drawn by hash, each asked for by its rarest words.

    Words in fewer than least_df or more than most_share of the documents don't
    count; where fewer than three are left, rarer words count too, and where
    none is left all do. A document without words is asked for by the frame alone.
    """
    total = docs.count()
    most = max(least_df, int(total * most_share))
    tokens = docs.select("doc_id", F.explode_outer(F.array_distinct(long_words(F.col("text")))).alias("w")).filter("w IS NOT NULL")
    drawn = checkpointed(docs.select("doc_id", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(n).select("doc_id"))
    rare = checkpointed(tokens.join(F.broadcast(drawn), "doc_id"))  # n rows
    df = tokens.join(checked(rare.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    own = Window.partitionBy("doc_id")
    rows = rare.join(df, "w").withColumn("strict", F.col("df").between(least_df, most)).withColumn("loose", F.col("df") <= most)
    rows = rows.withColumn("n_strict", F.count_if("strict").over(own)).withColumn("n_loose", F.count_if("loose").over(own))
    rows = rows.filter(F.when(F.col("n_strict") >= 3, F.col("strict")).when(F.col("n_loose") > 0, F.col("loose")).otherwise(True))
    best = rows.withColumn("r", F.row_number().over(own.orderBy("df", "w"))).filter(F.col("r") <= words)
    asked = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("r", "w"))).alias("ws"))
    told = drawn.join(asked, "doc_id", "left").withColumn("said", F.coalesce(F.array_join(F.transform("ws", lambda x: x["w"]), " "), F.lit("")))
    return told.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), strip(framed(F.col("doc_id"), F.col("said"))).alias("query"), "doc_id")


def usable(query: Column, title: Column) -> Column:
    """4 to 40 words, of which at most 0.8 stand in the title."""
    title = F.coalesce(title, F.lit(""))
    q = F.array_distinct(F.split(F.lower(query), " "))
    shared = F.size(F.array_intersect(q, F.array_distinct(F.split(F.lower(title), r"\s+")))) / F.size(q)
    n = F.size(F.split(query, " "))
    return (n >= 4) & (n <= 40) & ((title == "") | (shared <= 0.8))


def pick(values: Column, *parts) -> Column:
    """One of values, by a hash of the parts."""
    at = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") % F.size(values)
    return F.get(values, at.cast("int"))


def templated(docs: DataFrame, per_doc: int = 3, least: int = 200, max_docs: int | None = None, generated: str = "", generator: str = "mock") -> DataFrame:
    """(query, doc_id, source, source_url, retrieved_date, generator, generated_date, query_index): up to per_doc queries about each document.

    docs: (doc_id, title, abstract, embedding_text, keywords, source,
    source_url, retrieved_date). The text is the embedding text, or else title
    and abstract, and has ``least`` characters. Keywords, or else the title's
    words that are no jargon, fill templates, 3 * per_doc times; of usable
    queries that differ in more than case the first ones stay. ``max_docs``
    documents with queries, in order of doc_id, are the most that are given.
    """
    given = F.nullif(F.coalesce("embedding_text", F.lit("")), F.lit(""))
    text = strip(F.coalesce(given, F.concat_ws(" ", "title", "abstract")))
    words = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(plain_title_words(F.col("title")))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(NO_KEYWORD)))
    rows = docs.filter(F.length(text) >= least).withColumn("w", words).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3 * per_doc - 1))))
    key = (F.col("doc_id").cast("string"), F.col("j").cast("string"))
    lists = {"kw": F.col("w"), "ind": F.array(*map(F.lit, INDICATIONS)), "mod": F.array(*map(F.lit, MODALITIES))}
    query = pick(F.array(*map(F.lit, TEMPLATES)), *key, F.lit("t"))
    for name, values in lists.items():
        query = F.replace(query, F.lit("{" + name + "}"), pick(values, *key, F.lit(name)))
    rows = rows.withColumn("query", norm_query(query)).filter(usable(F.col("query"), F.col("title")))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.lower("query")).orderBy("j"))
    rows = rows.withColumn("nth", nth).filter("nth = 1").withColumn("query_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("j")) - 1).filter(F.col("query_index") < per_doc)
    if max_docs is not None:
        kept = rows.select("doc_id").distinct().orderBy("doc_id").limit(max_docs)
        rows = rows.join(kept, "doc_id", "left_semi")
    return rows.select("query", "doc_id", "source", "source_url", "retrieved_date", F.lit(generator).alias("generator"), F.lit(generated).alias("generated_date"), "query_index")


def title_of(text: Column) -> Column:
    return strip(F.get(F.split(F.coalesce(text, F.lit("")), "\n"), F.lit(0)))


def parsed_array(prose: Column) -> Column:
    """The strings of the JSON array in some prose; null without one."""
    return F.from_json(F.regexp_extract(prose, r"(?s)\[.*\]", 0), "array<string>")
