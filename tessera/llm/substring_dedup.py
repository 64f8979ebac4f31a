"""Exact substring deduplication by seed and extend.

Seeds: every run of ``length`` words has ``length - k + 1`` word k-grams; the
least of their hashes (the rightmost of equal ones) is its anchor (winnowing).
The anchor of a window depends on the window's words alone, so equal windows
of two documents meet at equal anchors, and an anchor stands for a span: the
consecutive windows that share it.

Extension: documents are joined on their anchors. Spans with one anchor and
equal words are equal as far as they go both ways, and need no further look.
Where the spans of an anchor differ (at the ends of a repeat, or where only
the anchor is repeated), one bearer of each distinct span is laid on the
anchor's pivot, its bearer of the smallest id: their words are compared from
the anchor to the left and to the right, as far as they are equal. What the
match covers is a repeat if it is of ``length`` words or more. Windows beyond
the match can only be repeated where the pivot does not have them; of these,
the smallest id per word sequence is kept by their hashes. Touching matches
are joined, which gives the maximal repeats.

A document is held against a pivot or a smallest id only, so the work grows
with the number of anchors, never with the pairs of a group of copies; a hot
passage is pre-aggregated by map-side minima.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE2, U64, Words, documents, inverse, mix, powers, released, shared, texts, windows
from .sentencepiece_sampling import chunks

#: Places within a block stand in a hash's low bits, so a block has fewer places than these.
LOW = U64((1 << 24) - 1)
BLOCK = 1 << 23


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


class Sums:
    """Hashes of any run of words, by prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.total = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum(hashes * powers(base, len(hashes)), out=self.total[1:])
        self.back = powers(inverse(base), len(hashes) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start] + (end - start).astype(U64))


def anchors(grams: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """Of each width consecutive hashes, the place of the least (by its upper 40 bits; the rightmost of equal ones)."""
    out = []
    for at in range(0, len(grams) - width + 1, block):
        some = grams[at : at + block + width - 1]
        order = (some & ~LOW) | (LOW - np.arange(len(some), dtype=U64))
        out.append(at + (LOW - (least(order, width) & LOW)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def spans(words: Words, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each span: its document, first window, number of windows, and anchor's place (words of all texts)."""
    none = np.empty(0, dtype=np.int64)
    if words.n < length:
        return none, none, none, none, np.empty(0, dtype=U64)
    grams = windows(words.hash, k)
    anchor = anchors(grams, length - k + 1)
    inside = words.doc[: len(anchor)] == words.doc[length - 1 :]
    start = np.flatnonzero(inside)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(anchor[start]) != 0) | (np.diff(words.doc[start]) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    start = start[first]
    return words.doc[start], start, n, anchor[start], grams


def long_runs(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, h, anchor, a, start, n, off): the spans; a is a hash of a span's words and of its anchor's place (off) in it."""

    def run(batches):
        for batch in batches:
            items = [x.encode() for x in batch.column("text").to_pylist()]
            for part in chunks(items):
                words = Words(items[part])
                doc, start, n, anchor, grams = spans(words, length, k)
                if not len(doc):
                    continue
                end = start + n + (length - 1)
                # with the anchor, 128 bits
                a = mix(Sums(words.hash, BASE2).of(start, end) + (anchor - start).astype(U64))
                at = pa.array(doc + part.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(grams[anchor].view(np.int64)), pa.array(a.view(np.int64)),
                     pa.array((start - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int16))],
                    names=["doc_id", "h", "anchor", "a", "start", "n", "off"],
                )

    return rows.mapInArrow(released(run), "doc_id long, h long, anchor long, a long, start int, n int, off short")


def worded(rows: DataFrame, length: int) -> DataFrame:
    """(anchor, doc_id, h, start, off, words) of the asked spans: the words of their windows."""

    def run(batches):
        for batch in batches:
            out = []
            for i, (asked, text) in enumerate(zip(batch.column("asked").to_pylist(), batch.column("text"))):
                words = text.as_buffer().to_pybytes().split()
                out += [(i, x["anchor"], x["start"], x["off"], b" ".join(words[x["start"] : x["start"] + x["n"] + length - 1])) for x in asked]
            at = pa.array([x[0] for x in out], type=pa.int64())
            told = [pa.array([x[j] for x in out], type=t) for j, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int16()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([told[0], batch.column("doc_id").take(at), batch.column("h").take(at), *told[1:]], names=["anchor", "doc_id", "h", "start", "off", "words"])

    return rows.mapInArrow(released(run), "anchor long, doc_id long, h long, start int, off short, words binary")


def extension(words: list[bytes], off: int, pivot: list[bytes], pivot_off: int) -> tuple[int, int]:
    """The words [first, end) that are equal to the pivot's, from the anchor both ways; (off, off) if the anchors' first words differ."""
    left, right = 0, 0
    while left < min(off, pivot_off) and words[off - left - 1] == pivot[pivot_off - left - 1]:
        left += 1
    while off + right < len(words) and pivot_off + right < len(pivot) and words[off + right] == pivot[pivot_off + right]:
        right += 1
    return (off - left, off + right) if right else (off, off)


def extended(pairs: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, start, end, key): of spans and their pivots the matches (key null), and the windows beyond them with a digest of their words."""

    def run(batches):
        for batch in batches:
            ids, hs, starts, ends, keys = [], [], [], [], []
            names = ("doc_id", "h", "start", "off", "words", "pivot_id", "pivot_off", "pivot_words")
            for doc_id, h, start, off, words, pivot_id, pivot_off, pivot_words in zip(*(batch.column(n).to_pylist() for n in names)):
                words = words.split()
                # the pivot's document lends all its windows; from itself it takes none
                first, end = (0, 0) if doc_id == pivot_id else extension(words, off, pivot_words.split(), pivot_off)
                found = []
                if end - first >= length:
                    found.append((first, end, None))
                for i in range(len(words) - length + 1):
                    if i < first or i + length > end:
                        found.append((i, i + length, hashlib.md5(b" ".join(words[i : i + length])).digest()))
                for a, b, key in found:
                    ids.append(doc_id)
                    hs.append(h)
                    starts.append(start + a)
                    ends.append(start + b)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(hs, type=pa.int64()), pa.array(starts, type=pa.int32()), pa.array(ends, type=pa.int32()), pa.array(keys, type=pa.binary())],
                names=["doc_id", "h", "start", "end", "key"],
            )

    return pairs.mapInArrow(released(run), "doc_id long, h long, start int, end int, key binary")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a hash of the text, which tells rows with one id apart."""
    return texts(df, id_col, text_col).withColumn("h", F.xxhash64("text"))


def repeats(df: DataFrame, length: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, start, end): maximal repeats, in words of the row.

    Each word in a range is covered by ``length`` consecutive words that also
    start in a row with a smaller id. Rows with a null id neither lend nor lose
    words; rows with equal ids don't count against each other. Texts of fewer
    than ``length`` words have no repeats.
    """
    rows = keyed(df, id_col, text_col).filter("doc_id IS NOT NULL")
    found = shared(long_runs(rows, length, k))
    # an anchor of one document alone seeds nothing; where all spans of an anchor are equal, nothing is extended
    met = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("a") < F.max("a")).alias("differ"))
    met = shared(met.filter("low < high").select("anchor", "differ"))
    found = shared(found.join(met, "anchor"))
    kinds = shared(found.groupBy("anchor", "a", "differ").agg(F.min("doc_id").alias("least"), F.count("*").alias("bearers")).filter("differ OR bearers > 1").select("anchor", "a", "least"))
    seeds = shared(found.join(kinds, ["anchor", "a"]).select("doc_id", "h", "anchor", "start", "n", "off", "least", "differ"))
    del found, met, kinds
    copied = seeds.filter("doc_id > least").select("doc_id", "h", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    asked = seeds.filter("doc_id = least AND differ").groupBy("doc_id", "h").agg(F.collect_set(F.struct("anchor", "start", "n", "off")).alias("asked"))
    around = shared(worded(rows.join(asked, ["doc_id", "h"]).select("doc_id", "h", "text", "asked"), length))
    first = F.min_by(F.struct("off", "words"), F.struct("doc_id", "h", "start"))
    pivots = shared(around.groupBy("anchor").agg(F.min("doc_id").alias("pivot_id"), first.alias("p")).select("anchor", "pivot_id", F.col("p.off").alias("pivot_off"), F.col("p.words").alias("pivot_words")))
    grown = shared(extended(around.join(pivots, "anchor"), length))
    lent = shared(grown.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"))
    beyond = grown.join(lent, "key").filter("doc_id > least").select("doc_id", "h", "start", "end")
    return copied.unionByName(grown.filter("key IS NULL").select("doc_id", "h", "start", "end")).unionByName(beyond)


def deduplicate(df: DataFrame, length: int = 50, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, ranges) of every row.

    kept is the text without the words of its ranges, joined by one space;
    ranges are the maximal repeats (start, end), in words. Null, empty and
    short texts have none. Of rows with equal windows that of the smallest id
    keeps them; rows of one id keep them all, as do rows without an id. Texts
    of any length are read whole; an empty table gives no rows.
    """
    ranges = shared(repeats(df, length, k, id_col, text_col).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    rows = keyed(df, id_col, text_col).join(ranges.hint("shuffle_hash"), ["doc_id", "h"], "left").select("doc_id", "text", "ranges")

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = text.encode().split()
                n, merged = len(words), []
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                if merged:
                    cuts = [0, *(x for r in merged for x in (r["start"], r["end"])), n]
                    words = [w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]
                out.append((n, n - len(words), b" ".join(words).decode(), merged))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([x[i] for x in out], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))))],
                names=["doc_id", "n_words", "n_removed", "kept", "ranges"],
            )

    return rows.mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept string, ranges array<struct<start:int,end:int>>")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too: what is left when words that a smaller id has in 50 in a row are removed."""
    return deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by all windows at once.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w FROM documents),
 p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
 x AS (SELECT doc_id, s, md5_number(array_to_string(w[s:s + 49], ' ')) AS h FROM p),
 m AS (SELECT h, min(doc_id) AS first_id FROM x GROUP BY h),
 c AS (SELECT DISTINCT x.doc_id, unnest(range(x.s, x.s + 50)) AS i FROM x JOIN m USING (h) WHERE m.first_id < x.doc_id),
 g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
