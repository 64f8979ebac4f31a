"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

The index has, of a term, a document and a place: one pass over the texts
tokenises them and stores the postings of the terms asked for (here all terms
of the benchmark), beside each document's number of words, as Parquet in the
folder that the cluster shares. A test item's windows are phrases of
``window`` consecutive words (an item of fewer words is one). All else is
asked of the index: how often each term stands in it, and the postings of each
window's two rarest terms. Their places are moved back by the term's offset in
the window and the lists are intersected: where both terms give one start, the
phrase may stand there, and where the starts differ by no more than ``slop``
words, the window is near. Only documents with such a start are read again, to
hold the phrase against their words, which makes phrase matches exact.

Documents are never joined with each other. Tables of the size of the
benchmark's are broadcast only after their bytes were summed; beyond
``MOST_BROADCAST`` bytes the same joins are shuffled.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, quoted, shared, shared_folder
from .native import ALNUM, ascii_lower, keyed, let

WINDOW, SLOP, MOST_BROADCAST = 13, 5, 32 << 20


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"{ALNUM}+"), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(wid, words, items): the distinct windows, and the items that have each; an item without an id lends windows but no name."""
    words = tokens(F.coalesce(quoted(text_col), F.lit("")))
    items = benchmark.select(quoted(id_col).cast("string").alias("item"), words.alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    rows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    grouped = rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grouped.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "words", "items")


def sized(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """small, to be broadcast if its values take at most ``most`` bytes when written out."""
    size = small.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))) + 32), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= most else small


@dataclass
class Index:
    """postings: (doc_key, h, pos, term_id); docs: (doc_key, h, n_words) of every row. term_id is a hash of the term."""

    postings: DataFrame
    docs: DataFrame


def term_id(term: Column) -> Column:
    return F.xxhash64(term)


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, folder: str | None = None) -> Index:
    """The stored index of docs (doc_key, h, doc_id, text), of the vocabulary (term) if one is given, in ``folder`` or one of its own."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    every = docs.select("doc_key", "h", let(tokens(F.col("text")), lambda w: F.struct(w.alias("w"), F.size(w).alias("n"))).alias("t"))
    every = every.select("doc_key", "h", "t.n", F.posexplode_outer("t.w").alias("pos", "term"))
    first = F.coalesce("pos", F.lit(0)) == 0  # one row of each document, also of one without words, has its number of words
    if vocabulary is None:
        kept = every.withColumn("term_id", term_id(F.col("term"))).withColumn("term_id", F.when(F.col("term").isNotNull(), F.col("term_id")))
    else:
        known = sized(vocabulary.select("term", term_id(F.col("term")).alias("term_id")).distinct())
        kept = every.join(known, "term", "left").filter(F.col("term_id").isNotNull() | first)
    kept.select("doc_key", "h", "pos", "term_id", F.when(first, F.col("n")).alias("n_words")).write.parquet(folder)
    return load_index(spark, folder)


def load_index(spark, folder: str) -> Index:
    stored = spark.read.parquet(folder)
    docs = stored.filter("n_words IS NOT NULL").select("doc_key", "h", F.col("n_words").cast("long").alias("n_words"))
    return Index(stored.filter("term_id IS NOT NULL").select("doc_key", "h", "pos", "term_id"), docs)


def rarest(windows: DataFrame, index: Index) -> DataFrame:
    """(wid, term_id, off, k, alone): the two rarest terms of each window, or its only one."""
    terms = windows.select("wid", F.posexplode("words").alias("off", "term")).groupBy("wid", "term").agg(F.min("off").alias("off"))
    counts = index.postings.groupBy("term_id").agg(F.count("*").alias("n"))
    found = terms.withColumn("term_id", term_id(F.col("term"))).join(counts, "term_id", "left")
    own = Window.partitionBy("wid")
    ranked = found.withColumn("k", F.row_number().over(own.orderBy(F.coalesce("n", F.lit(0)), "term")) - 1)
    return ranked.withColumn("alone", F.count("*").over(own) == 1).filter("k < 2").select("wid", "term_id", "off", "k", "alone")


def search(index: Index, windows: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_key, h, wid, start) of the windows that are near in a document: each start on which their rarest terms agree, or null."""
    drivers = shared(rarest(windows, index))
    moved = index.postings.join(sized(drivers), "term_id").select("doc_key", "h", "wid", (F.col("pos") - F.col("off")).alias("start"), "k", "alone")
    order = Window.partitionBy("doc_key", "h", "wid").orderBy("start", "k")
    before, kind = F.lag("start").over(order), F.lag("k").over(order)
    moved = moved.withColumn("gap", F.when(F.col("alone"), F.lit(0)).when(kind != F.col("k"), F.col("start") - before))
    met = moved.filter(F.col("gap") <= slop)
    return met.select("doc_key", "h", "wid", F.when((F.col("gap") == 0) & (F.col("start") >= 0), F.col("start")).alias("start")).distinct()


RESULT = "struct<n_hit:bigint,items:array<string>,n_near:bigint>"


def matches(docs: DataFrame, index: Index, windows: DataFrame, slop: int) -> DataFrame:
    """(doc_key, h, m) of the documents with a near window; m is a RESULT."""
    met = shared(search(index, windows, slop))
    told = met.groupBy("doc_key", "h", "wid").agg(F.collect_set("start").alias("starts")).join(sized(windows), "wid")
    told = shared(told.groupBy("doc_key", "h").agg(F.collect_list(F.struct("starts", "words", "items")).alias("met")))
    again = docs.select("doc_key", "h", "text").join(sized(told.select("doc_key", "h")), ["doc_key", "h"], "left_semi")
    rows = again.join(told, ["doc_key", "h"])

    def held(words: Column, x: Column) -> Column:
        return F.filter(x["starts"], lambda s: F.slice(words, s + 1, F.size(x["words"])) == x["words"])

    def exact(words: Column) -> Column:
        each = F.transform("met", lambda x: F.struct(held(words, x).alias("starts"), F.size(x["words"]).alias("n"), x["items"].alias("items")))
        return F.filter(each, lambda x: F.size(x["starts"]) > 0)

    rows = rows.select("doc_key", "h", F.size("met").cast("long").alias("n_near"), let(tokens(F.col("text")), exact).alias("exact"))
    places = F.flatten(F.transform("exact", lambda x: F.transform(x["starts"], lambda s: F.struct(s.cast("long").alias("s"), (s + x["n"]).cast("long").alias("e")))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(a: Column, p: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), p["e"] - F.greatest(a["end"], p["s"]))
        return F.struct(F.greatest(a["end"], p["e"]).alias("end"), (a["n"] + more).alias("n"))

    n_hit = F.aggregate(F.sort_array(places), zero, cover, lambda a: a["n"])
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("exact", lambda x: x["items"]))))
    found = rows.select("doc_key", "h", F.struct(n_hit.alias("n_hit"), items.alias("items"), F.col("n_near")).cast(RESULT).alias("m"))
    return found.dropDuplicates(["doc_key", "h"])  # rows of one id and text are one document here


def decontaminate(
    df: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, percent: int = 5,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near, contaminated) of every row; with ``keep``, these columns of df (none called so) in the place of doc_id.

    n_hit: words inside an exact occurrence of a window; items: the items (as
    strings, sorted) with such windows; n_near: windows whose two rarest terms
    stand within ``slop`` words of the window's distance (or whose only term
    stands at all), exact ones included; of equally rare terms the first in
    order counts. A row is contaminated if at least ``percent`` of 100 words
    are hit, and one at least. Null, empty and wordless texts and items have
    no words; equal rows get equal results, also without an id. Texts of any
    length are searched whole. An empty table gives no rows, an empty
    benchmark no hits.
    """
    docs = keyed(df, id_col, text_col)
    windows = shared(item_windows(benchmark, window))
    index = build_index(docs, windows.select(F.explode("words").alias("term")).distinct())
    found = shared(matches(docs, index, windows, slop))
    told = index.docs.join(found, ["doc_key", "h"], "left")
    if keep is None:
        named = ["doc_id"]
        rows = told.withColumn("doc_id", F.when(F.col("doc_key") > -(2**63), F.col("doc_key")))
    else:
        named = keep
        key, h = F.coalesce(quoted(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(quoted(text_col), F.lit("")))
        own = df.select(*(quoted(c) for c in keep), key.alias("doc_key"), h.alias("h"))
        rows = own.join(told.dropDuplicates(["doc_key", "h"]).hint("shuffle_hash"), ["doc_key", "h"])
    none = F.array().cast("array<string>")
    out = rows.select(
        *(quoted(c) for c in named), "n_words", F.coalesce("m.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("m.items", none).alias("items"), F.coalesce("m.n_near", F.lit(0).cast("long")).alias("n_near"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too: its hit words, the items found and the windows that are near."""
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated", "n_near")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bw AS (SELECT item, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM bw),
 ns AS (SELECT DISTINCT n FROM win),
 dp AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, ns WHERE len(w) >= n),
 dg AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM dp),
 hit AS (SELECT doc_id, s, dg.n, item FROM dg JOIN win USING (n, g)),
 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id),
 tk AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM d), ct AS (SELECT t, count(*) AS n FROM tk GROUP BY t),
 wg AS (SELECT DISTINCT g FROM win), wt AS (SELECT g, t, min(off) AS off FROM (SELECT g, unnest(string_split(g, ' ')) AS t, generate_subscripts(string_split(g, ' '), 1) - 1 AS off FROM wg) GROUP BY g, t),
 dr AS (SELECT * FROM (SELECT g, t, off, row_number() OVER (PARTITION BY g ORDER BY coalesce(n, 0), t) AS k, count(*) OVER (PARTITION BY g) AS terms FROM wt LEFT JOIN ct USING (t)) WHERE k <= 2),
 mv AS (SELECT doc_id, g, k, terms, pos - off AS s FROM tk JOIN dr USING (t)),
 nr AS (SELECT DISTINCT a.doc_id, a.g FROM mv a JOIN mv b ON a.doc_id = b.doc_id AND a.g = b.g AND a.k = 1 AND b.k = 2 AND abs(a.s - b.s) <= 5 UNION SELECT DISTINCT doc_id, g FROM mv WHERE terms = 1),
 nn AS (SELECT doc_id, count(*) AS n_near FROM nr GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
