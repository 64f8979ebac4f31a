"""Near-duplicate documents by DartMinHash signatures and a banded join.

Every unit of weight of a set's elements owns a Poisson process of darts on
the rank axis, seeded by the element; a dart that strikes within an element's
weight is thrown into one of ``k`` coordinates, and each coordinate keeps its
earliest dart. Two sets keep the same dart in a coordinate with the
probability of their weighted Jaccard similarity. A set of total weight W
looks at ranks below (k ln k + 2k) / W, so its signature costs O(W + k log k)
darts and not W * k; sets that leave a coordinate empty look twice as far.

The elements are shingles of ``shingle`` lower-cased (A-Z) words; a text of
fewer words is one shingle. A shingle weighs as often as it stands in the
text. Links are decided on the sets of shingles, so a text that has a shingle
twice also shows the bands of its unit weights: texts that are alike in either
sense meet. Texts of equal words are one class by their hash and take part
once.

Texts that agree in a band of the signature are held against the pivot of
their bucket by exact Jaccard similarity; the pivot is the text that shares
most in all its buckets, as what others were copied from does. A pivot goes to
its partners in runs of bounded size, once a run. Where a bucket then still
holds texts of different classes, those outside its largest class are held
against all others by matrix products over their shingles. So every two texts
that share a bucket end in one class or have been compared, and no pair is a
row unless it is a link or has the pivot in it. Buckets of like texts cost one
comparison a text; those of unlike texts cost the product of the largest class
and the rest, which the bands' length keeps rare.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE2, U64, Words, documents, mix, powers, quoted, released, shared, texts, unit, windows
from .sentencepiece_sampling import chunks
from .substring_dedup import Sums


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle."""
    grams = windows(words.hash, k)
    inside = np.flatnonzero(words.doc[: len(grams)] == words.doc[k - 1 :]) if len(grams) else np.empty(0, dtype=np.int64)
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = Sums(words.hash, BASE).of(words.first[few], words.first[few + 1])
    return np.concatenate((grams[inside], whole)), np.concatenate((words.doc[inside], few))


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, sets: int, k: int, seed: int = 0) -> np.ndarray:
    """The darts kept by each set, (sets, k); rows of sets without weight are 0.

    element, weight, owner: distinct elements (uint64) of each set, with positive weights.
    """
    out = np.zeros((sets, k), dtype=U64)
    total = np.bincount(owner, weight, sets)
    reach = np.divide(k * math.log(k) + 2.0 * k, total, out=np.zeros(sets), where=total > 0)
    open_ = total > 0
    while open_.any():
        mine = open_[owner]
        e, w, o = element[mine], weight[mine], owner[mine]
        # one process for each unit of weight, a last one for the rest
        cells = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(e)), cells)
        level = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        stream = mix(e[at] + mix(level.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))))
        share, o = np.minimum(1.0, w[at] - level), o[at]
        limit, rank = reach[o], np.zeros(len(at))
        found_set, found_rank, found_dart = [], [], []
        throw = 0
        while len(stream):
            dart = mix(stream + U64((0xD1342543DE82EF95 * (throw + 1)) & (2**64 - 1)))
            rank = rank - np.log(unit(dart))
            near = rank < limit
            stream, rank, limit, share, o, dart = stream[near], rank[near], limit[near], share[near], o[near], dart[near]
            name = mix(dart ^ U64(BASE2))
            hit = unit(mix(name ^ U64(BASE))) < share
            found_set.append(o[hit])
            found_rank.append(rank[hit])
            found_dart.append(name[hit])
            throw += 1
        s, r, d = np.concatenate(found_set), np.concatenate(found_rank), np.concatenate(found_dart)
        slot = s * k + (d % U64(k)).astype(np.int64)
        order = np.argsort(r, kind="stable")[::-1]
        kept = np.zeros(sets * k, dtype=U64)
        kept[slot[order]] = d[order]  # the earliest is written last
        full = np.zeros(sets * k, dtype=bool)
        full[slot] = True
        done = open_ & full.reshape(sets, k).all(axis=1)
        out[done] = kept.reshape(sets, k)[done]
        open_ &= ~done
        reach = reach * 2.0
    return out


def banded(kept: np.ndarray, bands: int, size: int) -> np.ndarray:
    """(sets, bands): a hash of each band of signatures."""
    keys = (kept.reshape(len(kept), bands, size) * powers(BASE, size)).sum(axis=2, dtype=U64)
    return mix(keys + np.arange(bands, dtype=U64) * U64(BASE2)).view(np.int64)


def sketched(rows: DataFrame, bands: int, size: int, shingle: int) -> DataFrame:
    """(doc_key, h, text_id, bands): text_id tells word sequences apart."""

    def run(batches):
        for batch in batches:
            items = [x.encode().lower() for x in batch.column("text").to_pylist()]
            for part in chunks(items):
                words = Words(items[part])
                n = part.stop - part.start
                a = Sums(words.hash, BASE).of(words.first[:-1], words.first[1:])
                b = Sums(words.hash, BASE2).of(words.first[:-1], words.first[1:])
                element, owner = shingles(words, shingle)
                order = np.lexsort((element, owner))
                element, owner = element[order], owner[order]
                new = np.ones(len(element), dtype=bool)
                new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                element, owner, count = element[first], owner[first], np.diff(np.append(first, len(element))).astype(float)
                lists = banded(signatures(element, count, owner, n, bands * size), bands, size).tolist()
                # texts with a repeated shingle: their unit weights too
                twice = np.zeros(n, dtype=bool)
                twice[owner[count > 1]] = True
                if twice.any():
                    mine = twice[owner]
                    place = np.cumsum(twice) - 1
                    plain = banded(signatures(element[mine], np.ones(int(mine.sum())), place[owner[mine]], int(twice.sum()), bands * size), bands, size).tolist()
                    for i, more in zip(np.flatnonzero(twice).tolist(), plain):
                        lists[i] = sorted({*lists[i], *more})
                lists = [None if e else k for e, k in zip((words.counts == 0).tolist(), lists)]
                ids = [x.tobytes() for x in np.stack((a, b), axis=1).astype(">u8")]
                take = slice(part.start, part.stop)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_key")[take], batch.column("h")[take], pa.array(ids, type=pa.binary()), pa.array(lists, type=pa.list_(pa.int64()))],
                    names=["doc_key", "h", "text_id", "bands"],
                )

    return rows.mapInArrow(released(run), "doc_key long, h long, text_id binary, bands array<long>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(text_id, label): the least text_id that links lead to; by least labels of neighbours, and labels of labels."""
    both = shared(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = shared(nodes.select("text_id", F.col("text_id").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.text_id).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.text_id == near.a, "left").select("text_id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("text_id").alias("t"), F.col("label").alias("above"))
        new = shared(low.join(up, low.label == up.t, "left").select("text_id", "was", F.least("label", "above").alias("label")))
        if new.filter("was <> label").isEmpty():
            return new.select("text_id", "label")
        labels = new.select("text_id", "label")


def alike(tried: DataFrame, sets: DataFrame, threshold: float, run_size: int = 256) -> DataFrame:
    """(a, b): of the pairs (head, text_id) those whose sets are at least so similar.

    A head's partners are dealt in runs of about ``run_size``; the head's set
    goes once to each run, ahead of its partners' sets.
    """
    runs = shared(tried.groupBy("head").agg(F.ceil(F.count("*") / F.lit(run_size)).cast("int").alias("runs")))
    dealt = tried.join(runs, "head").select("head", F.pmod(F.xxhash64("text_id"), F.col("runs")).cast("int").alias("run"), "text_id")
    heads = runs.select("head", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("head").alias("text_id"))
    sent = heads.unionByName(dealt).join(sets, "text_id").select("head", "run", "text_id", "elements")
    order = sent.withColumn("is_partner", F.col("head") != F.col("text_id")).repartition("head", "run").sortWithinPartitions("head", "run", "is_partner")

    def run(batches):
        head, own = None, None
        for batch in batches:
            a, b = [], []
            for one, text_id, elements in zip(*(batch.column(n).to_pylist() for n in ("head", "text_id", "elements"))):
                got = np.frombuffer(elements, dtype=np.int64)
                if one == text_id:
                    head, own = one, got
                    continue
                small, large = sorted((len(own), len(got)))
                both = len(np.intersect1d(own, got, assume_unique=True)) if small >= threshold * large else 0
                if both and both >= threshold * (len(own) + len(got) - both) - 1e-9:
                    a.append(min(head, text_id))
                    b.append(max(head, text_id))
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], names=["a", "b"])

    return order.select("head", "run", "text_id", "elements").mapInArrow(released(run), "a binary, b binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The number of elements that each left and each right set share, by matrix products of bounded width."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    both = np.intersect1d(x, y)
    for at in range(0, len(both), width):
        part = both[at : at + width]
        a, b = np.zeros((len(left), len(part)), dtype=np.float32), np.zeros((len(right), len(part)), dtype=np.float32)
        for m, v, row in ((a, x, i), (b, y, j)):
            col = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[col] == v
            m[row[hit], col[hit]] = 1.0
        out += a @ b.T
    return out


def block_links(members: DataFrame, sets: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(a, b): the texts of a bucket that differ in label and are at least so similar, of which one at least is no member of the largest class.

    members: (bucket, text_id, label, rest, n, n_rest). The n texts of a bucket
    are dealt in parts of about ``block``, and so are the n_rest texts outside
    its largest class; a part of these and a part of all meet in a task of
    their own. No pair is ever a row unless it is a link.
    """

    def count(n: str):
        return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(block)).cast("int"))

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0), count(n) - 1))

    key = F.xxhash64("text_id")
    columns = ["bucket", "low", "high", "side", "text_id", "label", "elements"]
    every = members.withColumn("high", F.pmod(key, count("n")).cast("int")).withColumn("low", spread("n_rest")).withColumn("side", F.lit(1))
    rest = members.filter("rest").withColumn("low", F.pmod(key, count("n_rest")).cast("int")).withColumn("high", spread("n")).withColumn("side", F.lit(0))
    dealt = every.select(columns[:-1]).unionByName(rest.select(columns[:-1])).join(sets, "text_id").select(columns)

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, labels = group.column("text_id").to_pylist(), group.column("label").to_pylist()
        sets_ = [np.frombuffer(x, dtype=np.int64) for x in group.column("elements").to_pylist()]
        one, two = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
        found = []
        if one and two:
            both = intersections([sets_[i] for i in one], [sets_[i] for i in two])
            size = np.array([len(x) for x in sets_], dtype=np.float64)
            like = both >= threshold * (size[one][:, None] + size[two][None, :] - both) - 1e-9
            for i, j in zip(*np.nonzero(like)):
                p, q = one[i], two[j]
                if labels[p] != labels[q]:
                    found.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pa.table({"a": pa.array([x for x, _ in found], type=pa.binary()), "b": pa.array([y for _, y in found], type=pa.binary())})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "a binary, b binary")


def shingle_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(text_id, elements): the sorted distinct shingle hashes of the wanted texts."""

    def run(batches):
        for batch in batches:
            items = [x.encode().lower() for x in batch.column("text").to_pylist()]
            for part in chunks(items):
                words = Words(items[part])
                element, owner = shingles(words, shingle)
                cut = np.argsort(owner, kind="stable")
                element, ends = element[cut], np.cumsum(np.bincount(owner, minlength=part.stop - part.start))
                sets = [np.unique(element[a:b]).view(np.int64).tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("text_id")[part], pa.array(sets, type=pa.binary())], names=["text_id", "elements"])

    return rows.join(wanted, ["doc_key", "h"]).select("text_id", "text").mapInArrow(released(run), "text_id binary, elements binary")


#: Stands for a null id, after all others when doc_key is compared.
NO_ID = 2**63 - 1


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, h, text): a row that is neither without an id nor repeated has its own (doc_key, h)."""
    return texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_key"), F.xxhash64("text").alias("h"), "text")


def grouped(df: DataFrame, threshold: float, bands: int, size: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_key, h, text_id) of every row, and (text_id, label, one, n) of every word sequence: its class, its first bearer (doc_key, h), its rows."""
    keyed = identified(df, id_col, text_col)
    found = shared(sketched(keyed, bands, size, shingle))
    bearer = shared(found.groupBy("text_id").agg(F.min(F.struct("doc_key", "h")).alias("one"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    banded_ = bearer.filter("bands IS NOT NULL").select("text_id", F.explode("bands").alias("bucket"))
    # what is joined with a hot bucket is a table of its own, so that the join alone is dealt anew at run time
    sizes = shared(banded_.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    crowded = shared(banded_.join(sizes, "bucket"))
    # a text's weight: how many share its buckets; what others were copied from weighs most
    weights = shared(crowded.groupBy("text_id").agg(F.sum("n").alias("weight")))
    weighed = shared(crowded.join(weights, "text_id"))
    heads = shared(weighed.groupBy("bucket").agg(F.max_by("text_id", F.struct("weight", "text_id")).alias("head")))
    buckets = shared(weighed.join(heads, "bucket").select("bucket", "text_id", "n", "head"))
    wanted = buckets.select("text_id").distinct().join(bearer, "text_id").select("text_id", "one.doc_key", "one.h")
    sets = shared(shingle_sets(keyed, wanted, shingle).dropDuplicates(["text_id"]))
    nodes = sets.select("text_id")
    tried = shared(buckets.filter("text_id <> head").select("head", "text_id").distinct())
    links = shared(alike(tried, sets, threshold).distinct())
    labels = components(nodes, links)
    named = buckets.filter("n > 2").join(labels, "text_id").select("bucket", "text_id", "label")
    kinds = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = kinds.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = shared(mixed.select("bucket", F.col("most.label").alias("main"), "n", (F.col("n") - F.col("most.c")).alias("n_rest")))
    members = named.join(mixed, "bucket").withColumn("rest", F.col("label") != F.col("main")).drop("main")
    more = shared(block_links(members, sets, threshold).distinct())
    if not more.isEmpty():
        labels = components(nodes, shared(links.union(more).distinct()))
    told = bearer.join(labels, "text_id", "left").select("text_id", F.coalesce("label", "text_id").alias("label"), "one", "n")
    return found.select("doc_key", "h", "text_id"), shared(told)


def classes(
    df: DataFrame, threshold: float = 0.8, bands: int = 20, size: int = 4, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, class_size) of every row.

    class_id is the least id of the row's class (null if all its ids are
    null), class_size the rows of the class. Texts without words (empty, null
    or blank) are copies of each other; so are texts that differ in the case
    of A-Z or in white space only. Rows of one id are told apart by their
    texts, equal rows are copies. Texts of any length are read whole, a
    similarity equal to the threshold links, and an empty table gives no rows.
    """
    found, told = grouped(df, threshold, bands, size, shingle, id_col, text_col)
    own = shared(told.groupBy("label").agg(F.min("one.doc_key").alias("class_id"), F.sum("n").alias("class_size")))
    of_text = shared(told.select("text_id", "label").join(own, "label").select("text_id", "class_id", "class_size"))
    out = found.select("doc_key", "text_id").join(of_text, "text_id")
    return out.select(F.expr(f"nullif(doc_key, {NO_ID})").alias("doc_id"), F.expr(f"nullif(class_id, {NO_ID})").alias("class_id"), "class_size")


def survivors(
    df: DataFrame, threshold: float = 0.8, bands: int = 20, size: int = 4, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """df with one row of each class of near duplicates: of the least id, else of the least hash of its text; with ``keep``, only these columns.

    Rows without an id come after all others. Of equal rows one stays.
    """
    _, told = grouped(df, threshold, bands, size, shingle, id_col, text_col)
    first = told.groupBy("label").agg(F.min("one").alias("one")).select(F.col("one.doc_key").alias("__key"), F.col("one.h").alias("__h"))
    key, h = F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(quoted(text_col), F.lit("")))
    own = df.select(*(quoted(c) for c in keep or df.columns), key.alias("__key"), h.alias("__h"))
    return own.join(first, ["__key", "__h"], "left_semi").dropDuplicates(["__key", "__h"]).drop("__key", "__h")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, class_size) of every document, null and empty texts too."""
    return classes(documents(spark, sf_dir))
