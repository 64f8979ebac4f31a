"""License scan by ordered signature rules, in DataFrame functions alone.

A text that has none of a few stems is done. In the others, the rules whose
keyword they hold are tried, and every match becomes an interval. Sorted by
start, falling end and priority, an interval that lies within an earlier one
is suppressed; of two that partly overlap, the one with the better priority
stays. All of it happens within the row: nothing is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, texts
from .license_rules import S, signatures, stems
from .native import ALNUM, GAP, let

#: Fixed by the contract: phrases and labels.
PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}
#: Every family rule's match has one of these, in lower case. None has a space where a pattern lets other things stand.
STEMS = (
    "licen", "spdx", "creativecommons", "cc0", "attribution", "gnu.org", "mozilla.org", "opensource.org", "apache.org", "opendatacommons",
    "wtfpl.net", "boost.org", "eclipse.org", "python.org", "php.net", "openssl.org", "sil.org", "europa.eu", "cecill.info", "postgresql.org",
    "w3.org", "mongodb.com", "mariadb.com", "elastic.co", "firstdonoharm", "json.org", "llama.meta.com", "coscl.org",
)
#: Or it holds a word and a match of the pattern: words that may stand on two lines or have marks between them.
SPLIT_STEMS = (("under", r"(?:released|distributed|available|provided)\s{1,3}under"), ("commons", f"creative{S}commons"), ("cc", f"cc{S}by"))


def phrase(words: tuple[str, ...]) -> str:
    return f"(?i)(?<!{ALNUM})" + f"{GAP}+".join(words) + f"(?!{ALNUM})"


def rules() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("priority"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(label).alias("label"), F.lit(c).alias("certainty")) for i, k, p, label, c in signatures()))


def intervals(text: Column, rule: Column) -> Column:
    """The matches of a rule as (start, -end, priority, label, certainty)."""

    def of(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule["pattern"], -1), lambda s: F.length(s))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,priority:int,label:string,certainty:double>>").alias("out"))

        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.get(gaps, i)
            end = start + F.length(F.get(found, i))
            one = F.struct(start.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["certainty"].alias("certainty"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda a: a["out"]))

    return let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), of)


DETECTION = "struct<start:int,back:int,priority:int,label:string,certainty:double>"


def resolved(found: Column) -> Column:
    """The intervals that stay, of all."""
    none = F.lit(None).cast(DETECTION)
    zero = F.struct(F.array().cast(f"array<{DETECTION}>").alias("kept"), none.alias("last"))

    def step(a: Column, d: Column) -> Column:
        last = a["last"]
        apart = last.isNull() | (d["start"] >= -last["back"])
        within = d["back"] >= last["back"]
        loses = within | (d["priority"] >= last["priority"])
        return F.when(apart, F.struct(F.when(last.isNull(), a["kept"]).otherwise(F.concat(a["kept"], F.array(last))).alias("kept"), d.alias("last"))).when(loses, a).otherwise(F.struct(a["kept"].alias("kept"), d.alias("last")))

    return F.aggregate(F.array_sort(found), zero, step, lambda a: F.when(a["last"].isNull(), a["kept"]).otherwise(F.concat(a["kept"], F.array(a["last"]))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row.

    Base places are those of PHRASES; labels also has what the rules find.
    detections are the intervals that stay, in characters from 0; score is the
    greatest certainty of a detection or, for a base phrase, 0.8 (0 without).
    A null or empty text has no words and no labels; equal rows get equal
    results. Of intervals with one start and end the better priority stays.
    Texts of any length are scanned whole; an empty table gives no rows.
    """
    rows = texts(df, id_col, text_col)
    word = F.lit(f"{ALNUM}+")

    def words_in(text: Column) -> Column:
        return F.size(F.regexp_extract_all(text, word, F.lit(0))).cast("long")

    def base(text: Column) -> Column:
        def places(label: str, words: tuple[str, ...]) -> Column:
            def of(parts: Column) -> Column:
                hit = F.size(parts) > 1
                first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
                return F.struct(
                    F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), F.when(hit, words_in(first)).alias("first"), F.when(hit, words_in(last) + F.lit(len(words))).alias("tail")
                )

            return let(F.split(text, phrase(words), -1), of)

        return F.array(*(places(label, words) for label, words in PHRASES.items()))

    low = F.lower("text")
    stem = F.lit(False)
    for s in STEMS:
        stem = stem | F.contains("low", F.lit(s))
    for s, pattern in SPLIT_STEMS:
        stem = stem | (F.contains("low", F.lit(s)) & F.col("low").rlike(pattern))
    for first, others in stems().items():
        beside = F.lit("" in others)
        for word_ in sorted(others - {""}):
            beside = beside | F.contains("low", F.lit(word_))
        stem = stem | (F.contains("low", F.lit(first)) & beside)
    rows = rows.withColumn("low", low).select("doc_id", "text", F.when(stem, F.col("low")).alias("low"), words_in(F.col("text")).alias("n_words"))
    found = let(rules(), lambda all_: F.flatten(F.filter(F.transform(F.filter(all_, lambda r: F.contains(F.col("low"), r["keyword"])), lambda r: intervals(F.col("text"), r)), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "n_words", F.when(F.contains("low", F.lit("license")), base(F.col("text"))).alias("base"), F.when(F.col("low").isNotNull(), resolved(found)).alias("found"))
    hits = F.filter("base", lambda b: b["n"] > 0)
    rows = rows.select(
        "doc_id", "n_words", hits.alias("base"),
        F.coalesce(F.transform("found", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["certainty"].alias("certainty"))), F.array().cast("array<struct<start:int,end:int,label:string,certainty:double>>")).alias("detections"),
    )
    own = F.coalesce(F.transform("base", lambda b: b["label"]), F.array().cast("array<string>"))
    certain = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["certainty"])), F.lit(0.0)), F.when(F.size(own) > 0, 0.8).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"), F.array_max(F.transform("base", lambda b: F.col("n_words") - b["tail"])).alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(F.concat(own, F.transform("detections", lambda d: d["label"])))), ",").alias("labels"),
        certain.alias("score"), "detections",
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too: the base places and all labels."""
    return scan(documents(spark, sf_dir)).drop("detections")
