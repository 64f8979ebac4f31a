"""Line-first quality rules, in DataFrame functions alone.

Each line is judged by itself: navigation (items between bars), shouting,
symbols, boilerplate phrases, and no punctuation in UNPUNCTUATED words or more. Lines
that fail are removed, and a document that loses more than ``most_lost`` of
its text is rejected, beside those that fail the base rules.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, texts
from .native import SOLID, let, union_length

SYMBOLS = r"[#*$%&|<>]"
#: Phrases that stand in page furniture.
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of (use|service)|accept (all )?cookies|javascript (is|must be) (required|enabled|disabled)"
    "|sign up for our newsletter|subscribe to our|click here to|share (this )?on (facebook|twitter)|skip to (main )?content|powered by wordpress|lorem ipsum"
)
MOST_LOST = 0.5
#: From so many words on a line has a mark of punctuation.
UNPUNCTUATED = 20


def line_fault(line: Column) -> Column:
    """The name of the rule that a line fails, or null."""
    words = F.size(F.regexp_extract_all(line, F.lit(f"{SOLID}+"), F.lit(0)))

    def count(pattern: str) -> Column:
        return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))

    return let(
        words,
        lambda n: F.when((count(r"\|") >= 3) & (count(r"\|") * 4 >= n), "navigation")
        .when((n >= 4) & (count(SYMBOLS) * 3 >= n), "symbols")
        .when((n >= 4) & (count("!") * 2 >= n), "shouting")
        .when(line.rlike(f"(?i)({BOILERPLATE})"), "boilerplate")
        .when((n >= UNPUNCTUATED) & (count(r"[.!?:;,\x{3002}\x{FF0C}\x{FF01}\x{FF1F}]") == 0), "punctuation"),
    )


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that stand twice or more in the text."""

    def places(grams: Column) -> Column:
        # equal windows stand together when sorted; hashes of 64 bits within one text
        def of_sorted(rows: Column) -> Column:
            hit = F.filter(
                F.transform(rows, lambda r, j: F.when((r["g"] == F.get(rows, j - 1)["g"]) | (r["g"] == F.get(rows, j + 1)["g"]), r["i"])), lambda i: i.isNotNull()
            )
            return union_length(F.sort_array(hit), F.lit(5))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    return F.when(F.size(words) < 5, F.lit(0).cast("long")).otherwise(let(windows, places))


def measures(text: Column) -> Column:
    """A struct of the base measures."""

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.struct(n.alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    return let(F.regexp_extract_all(text, F.lit(f"{SOLID}+"), F.lit(0)), of_words)


def duplicate_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SOLID))
    return let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def clean(df: DataFrame, most_lost: float = MOST_LOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines, lost) of every row.

    cleaned is the text without the lines that fail a rule; lost is the share
    of the non-blank lines' characters that they held. A text without words
    (null, empty or blank) fails the base rules, as does one of fewer than ten
    words. A share of just ``most_lost`` is kept. Equal rows get equal results,
    texts of any length are judged whole, other columns may have any name and
    an empty table gives no rows.
    """
    rows = texts(df, id_col, text_col).withColumn("m", measures(F.col("text")))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), line_fault(x).alias("fault")))
    rows = rows.withColumn("lines", lines)

    def size(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.when(x["line"].rlike(SOLID), F.length(x["line"])).otherwise(0))

    bad = F.filter("lines", lambda x: x["fault"].isNotNull())
    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))
    rows = rows.select(
        "doc_id", F.array_join(F.transform(F.filter("lines", lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n").alias("cleaned"), "m.n_words", "m.word_chars", symbols.cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"), "m.n_repeat_words", F.size(bad).cast("long").alias("n_bad_lines"), size(bad).alias("lost_chars"), size(F.col("lines")).alias("chars"),
    )
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    lost = F.when(F.col("chars") > 0, F.col("lost_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (lost <= most_lost)).alias("kept"), "n_bad_lines", lost.alias("lost"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too: the base measures, the verdict, and the lines that failed."""
    return clean(documents(spark, sf_dir)).drop("cleaned", "lost")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
 h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM g),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1),
 rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
 l0 AS (SELECT doc_id, unnest(ls) AS x FROM w),
 l1 AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, length(x) - length(replace(x, '|', '')) AS bars,
   length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS sy, length(x) - length(replace(x, '!', '')) AS ex,
   length(x) - length(regexp_replace(x, '[.!?:;,。，！？]', '', 'g')) AS pu FROM l0),
 l2 AS (SELECT doc_id, x, n, (bars >= 3 AND bars * 4 >= n) OR (n >= 4 AND sy * 3 >= n) OR (n >= 4 AND ex * 2 >= n)
   OR regexp_matches(x, '(?i)({BOILERPLATE})') OR (n >= {UNPUNCTUATED} AND pu = 0) AS bad FROM l1),
 l3 AS (SELECT doc_id, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN n > 0 THEN x END) AS dup, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS nbad,
   sum(CASE WHEN n > 0 THEN length(x) ELSE 0 END) AS chars, sum(CASE WHEN bad AND n > 0 THEN length(x) ELSE 0 END) AS lost FROM l2 GROUP BY doc_id),
 a AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words,
   nbad::BIGINT AS n_bad_lines, CASE WHEN chars > 0 THEN lost::DOUBLE / chars::DOUBLE ELSE 0 END AS lost FROM w JOIN l3 USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {MOST_LOST} AS kept, n_bad_lines FROM a
"""
