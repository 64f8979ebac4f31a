"""A typed graph: building, counting, components, splits, negatives, aggregation over neighbours."""
from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa

try:  # twice as fast on short texts as hashlib's, and the same
    from _md5 import md5
except ImportError:
    from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key

NODE_TYPES = ["technology", "inventor", "organization", "expert", "facility"]
RELATIONS = ["invented_by", "assigned_to", "investigated_by", "located_at", "affiliated_with"]


def nodes(parts: dict[str, DataFrame]) -> DataFrame:
    """(node_id, ntype, label) of (key, label) by type; of a key the label seen first stays, in the order of ``ord`` if there is one, else the least."""
    every = None
    for ntype, rows in parts.items():
        ordinal = F.col("ord") if "ord" in rows.columns else F.lit(0).cast("long")
        one = rows.select(F.concat(F.lit(ntype + ":"), F.col("key")).alias("node_id"), F.lit(ntype).alias("ntype"), "label", ordinal.alias("ord"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("node_id", "ntype").agg(F.min_by("label", F.struct("ord", "label")).alias("label"))


def from_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, ntype, label, doc_id) and (src, dst, rel) of records (doc_id, title, inventors, organizations, experts, facilities).

    A technology is known by its document; it is labelled by the title, or else
    the doc_id. Others are known by ``entity_key`` of their name and keep the
    name that the least doc_id gives, the first in its list. Each inventor is
    affiliated with each organization of the document.
    """
    ids = F.col("doc_id").cast("string")
    named = {"inventor": "inventors", "organization": "organizations", "expert": "experts", "facility": "facilities"}
    parts = {"technology": docs.select(ids.alias("key"), F.coalesce(F.nullif("title", F.lit("")), ids).alias("label"))}
    lists = {}
    for ntype, column in named.items():
        lists[ntype] = docs.select(ids.alias("doc_id"), F.posexplode(column).alias("pos", "label")).withColumn("key", entity_key(F.col("label")))
        parts[ntype] = lists[ntype].select("key", "label", F.struct("doc_id", "pos").alias("ord"))
    every = None
    for ntype, rows in parts.items():
        ordinal = F.col("ord") if "ord" in rows.columns else F.struct(F.col("key").alias("doc_id"), F.lit(0).alias("pos"))
        doc = F.col("key") if ntype == "technology" else F.lit(None).cast("string")
        one = rows.select(F.concat(F.lit(ntype + ":"), "key").alias("node_id"), F.lit(ntype).alias("ntype"), "label", doc.alias("doc_id"), ordinal.alias("ord"))
        every = one if every is None else every.unionByName(one)
    node_rows = every.groupBy("node_id", "ntype").agg(F.min_by("label", F.struct("ord", "label")).alias("label"), F.min("doc_id").alias("doc_id"))
    # pairs within a document, by its own lists: nothing is joined
    keys = F.transform("inventors", lambda x: entity_key(x)), F.transform("organizations", lambda x: entity_key(x))
    pairs = docs.select(F.explode(F.array_distinct(keys[0])).alias("s"), F.array_distinct(keys[1]).alias("o")).select("s", F.explode("o").alias("d"))
    told = [(rows.select(F.col("doc_id").alias("s"), F.col("key").alias("d")), "technology", ntype, rel) for ntype, rows, rel in (
        ("inventor", lists["inventor"], "invented_by"), ("organization", lists["organization"], "assigned_to"),
        ("expert", lists["expert"], "investigated_by"), ("facility", lists["facility"], "located_at"))]
    return node_rows, edges([*told, (pairs, "inventor", "organization", "affiliated_with")])


def named(ntype: str, key: Column) -> Column:
    """The node_id of a key."""
    return F.concat(F.lit(ntype + ":"), key.cast("string"))


def edges(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Distinct (src, dst, rel) of (rows with s and d, type of s, type of d, relation)."""
    every = None
    for rows, s, d, rel in parts:
        one = rows.select(named(s, F.col("s")).alias("src"), named(d, F.col("d")).alias("dst"), F.lit(rel).alias("rel"))
        every = one if every is None else every.unionByName(one)
    return every.distinct()


def zero_filled(counts: DataFrame, key: str, vocabulary: list[str]) -> DataFrame:
    """(key, n) of the whole vocabulary."""
    spark = counts.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, vocabulary))).alias(key))
    return names.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def meta(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation, zeros included."""
    n = zero_filled(node_rows.groupBy("ntype").agg(F.count("*").alias("n")), "ntype", NODE_TYPES)
    e = zero_filled(edge_rows.groupBy("rel").agg(F.count("*").alias("n")), "rel", RELATIONS)
    return n.select(F.lit("node").alias("kind"), F.col("ntype").alias("name"), "n").union(e.select(F.lit("edge"), "rel", "n"))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(node_id, degree), in and out, of parallel edges too."""
    return edge_rows.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def isolates(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return node_rows.join(degrees(edge_rows), "node_id", "left_anti").select("node_id")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where a session on one machine names none, as in tests, a folder of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/tessera")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """Tables as Parquet in the shared folder: a small part of what a checkpoint takes. They go at the end of the ``with``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid4()}"

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again. The shuffles behind it are of no more use; Spark removes their files once the driver has collected their plans, so this asks for it."""
        df.write.parquet(f"{self.path}/{name}")
        del df
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.parquet(f"{self.path}/{name}")


def known_edges(edge_rows: DataFrame, node_rows: DataFrame, relations: list[str] = RELATIONS) -> DataFrame:
    """The edges of these relations whose ends are both nodes."""
    ids = node_rows.select("node_id").distinct()
    kept = edge_rows.filter(F.col("rel").isin(relations))
    return kept.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "rel")


def connected_components(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(node_id, component): the least node that edges lead to, either way; labels also jump to their label's label."""
    both = edge_rows.select("src", "dst").unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = checkpointed(both.filter("src <> dst"))
    labels = checkpointed(node_rows.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.node_id).groupBy("src").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node_id == near.src, "left").select("node_id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node_id").alias("t"), F.col("component").alias("above"))
        new = checkpointed(low.join(jump, low.component == jump.t, "left").select("node_id", "was", F.least("component", "above").alias("component")))
        labels = new.select("node_id", "component")
        if new.filter("was <> component").isEmpty():
            return labels


def drawn(*parts) -> F.Column:
    """A hash of the parts, for seeded draws that any engine can repeat."""
    return F.md5(F.concat_ws("|", *parts))


def prefix(rows: DataFrame, key: list[str], order: list[str], weight) -> DataFrame:
    """rows with upto: the sum of weight over the rows before, in this order, of the same key.

    Rows are dealt by ranges of (key, order) and summed range by range; only
    the ranges' totals, a row a range and key, come together.
    """
    dealt = rows.withColumn("__weight", weight.cast("long")).repartitionByRange(*key, *order)
    dealt = checkpointed(dealt.withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range", *key).agg(F.sum("__weight").alias("t"))
    before = F.sum("t").over(Window.partitionBy(*key).orderBy("__range")) - F.col("t")
    totals = totals.select("__range", *key, before.alias("__before"))
    own = F.sum("__weight").over(Window.partitionBy("__range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.join(F.broadcast(totals), ["__range", *key]).withColumn("upto", F.coalesce(own, F.lit(0)) + F.col("__before"))
    return out.drop("__range", "__weight", "__before")


def split_edges(edge_rows: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 13) -> DataFrame:
    """(src, dst, rel, part): exactly floor(n * share) test and validation edges, the first ones by a hash."""
    rows = edge_rows.withColumn("h", drawn(F.lit(str(seed)), "src", "rel", "dst"))
    n = rows.count()
    at, n_test, n_val = F.col("upto") + 1, F.lit(int(n * test)), F.lit(int(n * val))
    part = F.when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")
    return prefix(rows, [], ["h", "src", "rel", "dst"], F.lit(1)).select("src", "dst", "rel", part.alias("part"))


def negatives(positive: DataFrame, left: DataFrame, right: DataFrame, tries: int = 3, seed: int = 17) -> DataFrame:
    """(src, dst, try): for each positive pair, drawn pairs that are no edge; what was drawn in vain is left out.

    left, right: (i, node_id), numbered from 0.
    """
    n_left, n_right = left.count(), right.count()
    rows = positive.select("src", "dst").distinct().withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))

    def pick(side: str, n: int):
        return F.conv(F.substring(drawn(F.lit(str(seed)), F.lit(side), "src", "dst", F.col("try").cast("string")), 1, 8), 16, 10).cast("long") % max(1, n)

    drawn_pairs = rows.select(F.col("try"), pick("u", n_left).alias("u"), pick("v", n_right).alias("v"))
    out = drawn_pairs.join(left.select(F.col("i").alias("u"), F.col("node_id").alias("src")), "u").join(right.select(F.col("i").alias("v"), F.col("node_id").alias("dst")), "v")
    return out.select("src", "dst", "try").filter("src <> dst").join(positive.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def relational_mean(edge_rows: DataFrame, features: DataFrame) -> DataFrame:
    """(node_id, dim, value) of every node and dimension of features: the sum over relations of the mean of the out-neighbours' features; 0 without any.

    features: (node_id, dim, value).
    """
    near = edge_rows.join(features.withColumnRenamed("node_id", "dst"), "dst")
    means = near.groupBy(F.col("src").alias("node_id"), "rel", "dim").agg(F.avg("value").alias("m"))
    every = means.select("node_id", "dim", "m").unionByName(features.select("node_id", "dim", F.lit(0.0).alias("m")))
    return every.groupBy("node_id", "dim").agg(F.round(F.sum("m"), 9).alias("value"))


def propagate(edge_rows: DataFrame, features: DataFrame, steps: int = 2) -> DataFrame:
    """Features after ``steps`` of h <- unit(h + relational mean), over edges both ways."""
    both = edge_rows.unionByName(edge_rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat("rel", F.lit("^-1")).alias("rel")))
    h = features
    for _ in range(steps):
        summed = h.unionByName(relational_mean(both, h)).groupBy("node_id", "dim").agg(F.sum("value").alias("value"))
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("node_id"))) + F.lit(1e-9)
        h = checkpointed(summed.select("node_id", "dim", (F.col("value") / norm).alias("value")))
    return h


def ranking_negatives(positive: DataFrame, candidates: DataFrame, real: DataFrame, wanted: int = 50, tries: int = 2, seed: int = 23) -> DataFrame:
    """(pid, src, dst): for each positive up to ``wanted`` drawn ends that make no edge with its src.

    positive: (pid, src, dst); candidates: (i, node_id), numbered from 0; real:
    (src, dst) of all edges. ``tries`` times as many are drawn at once, and of
    those that are no edge the first in order of drawing stay; an end may be
    drawn twice.
    """
    n = max(1, candidates.count())
    rows = positive.select("pid", "src").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(wanted * tries - 1))))
    pick = F.conv(F.substring(drawn(F.lit(str(seed)), "pid", F.col("try").cast("string")), 1, 8), 16, 10).cast("long") % n
    ends = rows.withColumn("i", pick).join(candidates.select("i", F.col("node_id").alias("dst")), "i").filter("src <> dst")
    free = ends.join(real.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("try"))
    return free.withColumn("nth", nth).filter(F.col("nth") <= wanted).select("pid", "src", "dst")


def hits_and_mrr(positive: DataFrame, negative: DataFrame, k: int = 10) -> DataFrame:
    """(n, hits, mrr): rank of each positive's score among its own negatives, ties in its favour; without positives n is 0 and the others null.

    positive: (pid, score); negative: (pid, score).
    """
    above = positive.join(negative.withColumnRenamed("score", "other"), "pid", "left").groupBy("pid", "score").agg(F.count_if(F.col("other") > F.col("score")).alias("better"))
    return above.agg(F.count("*").alias("n"), F.round(F.avg((F.col("better") < k).cast("double")), 6).alias("hits"), F.round(F.avg(F.lit(1.0) / (F.col("better") + 1)), 6).alias("mrr"))


def inner(x: str, y: str):
    """The inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)


def link_prediction(vectors: DataFrame, positive: DataFrame, negative: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(n, auc, hits, mrr) of held-out edges: by inner products of their ends' vectors.

    vectors: (node_id, v); positive: (pid, src, dst); negative: (src, dst), for
    the AUC; ranked: (pid, src, dst), the ends that each positive is held against.
    """
    from .evaluation import roc_auc

    a, b = (vectors.select(F.col("node_id").alias(end), F.col("v").alias(name)) for end, name in (("src", "x"), ("dst", "y")))
    scored = lambda rows: rows.join(a, "src").join(b, "dst").withColumn("score", F.round(inner("x", "y"), 6)).drop("x", "y")
    own = scored(positive)
    both = own.select("score", F.lit(True).alias("is_pos")).unionByName(scored(negative).select("score", F.lit(False).alias("is_pos")))
    ranks = hits_and_mrr(own.select("pid", "score"), scored(ranked).select("pid", "score"), k)
    return roc_auc(both).select("auc").join(F.broadcast(ranks), F.lit(True)).select("n", "auc", "hits", "mrr")  # one row each


def gathered(store: Store, parts: list[tuple[DataFrame, str, str, str]], seed: int = 13) -> list[tuple[DataFrame, str, str, str]]:
    """The parts of ``edges`` with (s, near) in place of (s, d), stored: near has each d of s once, with b, the first 16 bits of the hash by which edges are split.

    Keys are dealt and stored as they are: names are several times as long.
    """
    if len({rel for *_, rel in parts}) < len(parts):
        raise ValueError("each relation in one part")
    out = []
    for k, (rows, s, d, rel) in enumerate(parts):
        h = drawn(F.lit(str(seed)), named(s, F.col("s")), F.lit(rel), named(d, F.col("d")))
        b = F.conv(F.substring(h, 1, 4), 16, 10).cast("int").alias("b")
        pairs = rows.select("s", "d").repartition("s").distinct().select("s", F.struct("d", b).alias("e"))
        out.append((store.keep(pairs.groupBy("s").agg(F.collect_list("e").alias("near")), str(k)), s, d, rel))
    return out


def first_edges(parts: list[tuple[DataFrame, str, str, str]], share: float = 0.1, seed: int = 13):
    """Of gathered parts, the test edges of ``split_edges``, as a condition: a function of (src, rel, dst, b).

    Edges are counted by b, 65,536 values at most; where the share ends in the
    midst of a value, its edges are put in order. No edge is moved otherwise.
    """
    flat = [(rows.select("s", F.explode("near").alias("e")).select("s", "e.d", "e.b"), s, d, rel) for rows, s, d, rel in parts]
    every = None
    for rows, *_ in flat:
        every = rows.select("b") if every is None else every.unionByName(rows.select("b"))
    counts = sorted(map(tuple, every.groupBy("b").count().collect()))
    left = int(sum(c for _, c in counts) * share)
    if not left:
        return lambda src, rel, dst, b: F.lit(False)
    for at, c in counts:  # noqa: B007
        if left <= c:
            break
        left -= c
    tied = None
    for rows, s, d, rel in flat:
        one = rows.filter(F.col("b") == at).select(named(s, F.col("s")).alias("src"), F.lit(rel).alias("rel"), named(d, F.col("d")).alias("dst"))
        tied = one if tied is None else tied.unionByName(one)
    order = lambda src, rel, dst: F.struct(drawn(F.lit(str(seed)), src, rel, dst).alias("h"), src.alias("src"), rel.alias("rel"), dst.alias("dst"))
    last = tied.select(order(F.col("src"), F.col("rel"), F.col("dst")).alias("o")).orderBy("o").offset(left - 1).limit(1).first()["o"]
    last = F.struct(*(F.lit(x).cast("string").alias(name) for name, x in last.asDict().items()))
    return lambda src, rel, dst, b: (b < at) | ((b == at) & (order(src, rel, dst) <= last))


def places_in(have: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in have, which is sorted and has none twice; -1 where it is not."""
    if not len(have):
        return np.full(x.shape, -1)
    if have[-1] - have[0] == len(have) - 1:  # without gaps
        return np.where((x >= have[0]) & (x <= have[-1]), x - have[0], -1)
    at = np.minimum(np.searchsorted(have, x), len(have) - 1)
    return np.where(have[at] == x, at, -1)


def one_of(have: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Whether each of an array is in have, which is sorted; what a table of hashes shows to be absent is not looked up."""
    bits = max(10, (8 * len(have)).bit_length())
    slot = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, dtype=bool)
    table[slot(have)] = True

    def test(x: np.ndarray) -> np.ndarray:
        out = table[slot(x)]
        out[out] = places_in(have, x[out]) >= 0
        return out

    return test


def first_words(texts: list[bytes]) -> np.ndarray:
    """The first 32 bits of each text's md5."""
    return np.frombuffer(b"".join([md5(x).digest() for x in texts]), dtype=">u4")[::4].astype(np.int64)


def millionths(x: np.ndarray) -> np.ndarray:
    """Rounded to six decimals, halves away from 0, and times a million."""
    return (np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5)).astype(np.int64)


def dealt_draws(keys: DataFrame, n_left: int, n_right: int, blocks: int, tries: int, seed: int, at_once: int = 1 << 20) -> DataFrame:
    """(block, n, draws) of keys (key: src|dst): the pairs (u, v) that ``negatives`` draws for it, by blocks of u modulo ``blocks``.

    A pair is u // blocks * n_right + v; many are sorted and kept as differences,
    byte by byte, of 4 or 8 bytes each: a third of what rows of pairs take.
    """
    ends = [f"|{t}".encode() for t in range(tries)]

    def draw(texts: list[bytes], side: bytes) -> np.ndarray:
        head = f"{seed}|".encode() + side + b"|"
        return first_words([head + x + e for x in texts for e in ends])

    def pack(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        block, code, span = u % blocks, u // blocks * n_right + v, (n_left // blocks + 1) * n_right
        if blocks * span < 1 << 62:  # one sort of numbers in place of one by two keys
            block, code = np.divmod(np.sort(block * span + code), span)
        else:
            order = np.lexsort((code, block))
            block, code = block[order], code[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        rows = []
        for lo, hi in zip(cut, [*cut[1:], len(code)]):
            steps = np.diff(code[lo:hi], prepend=0)
            steps = steps.astype("<u4") if steps.max() < 1 << 32 else steps.astype("<i8")
            rows.append((int(block[lo]), int(hi - lo), steps.view(np.uint8).reshape(hi - lo, -1).T.tobytes()))
        b, n, d = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary())], ["block", "n", "draws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, have = [], [], 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            us.append(draw(texts, b"u") % max(1, n_left))
            vs.append(draw(texts, b"v") % max(1, n_right))
            have += len(us[-1])
            if have >= at_once:
                yield pack(np.concatenate(us), np.concatenate(vs))
                us, vs, have = [], [], 0
        if have:
            yield pack(np.concatenate(us), np.concatenate(vs))

    return keys.select("key").mapInArrow(run, "block long, n long, draws binary")


def unpacked(n: list[int], draws: list[bytes]) -> np.ndarray:
    """The pairs of rows of ``dealt_draws``."""
    out = [np.zeros(0, np.int64)]
    for k, x in zip(n, draws):
        planes = np.frombuffer(x, np.uint8).reshape(-1, k).T
        out.append(np.cumsum(np.ascontiguousarray(planes).view("<u4" if planes.shape[1] == 4 else "<i8").ravel().astype(np.int64)))
    return np.concatenate(out)


COUNTS = "kind string, high long, counts binary"


def packed_counts(kind: str, value: np.ndarray, p: np.ndarray, c: np.ndarray) -> pa.Table:
    """COUNTS of values, sorted and each once: a row for all that differ in their last 12 bits only."""
    high = value >> 12
    cut = np.flatnonzero(np.diff(high, prepend=high[:1] - 1))
    low, p, c = (value & 4095).astype("<u2"), p.astype("<u4"), c.astype("<u4")
    packed = [low[a:b].tobytes() + p[a:b].tobytes() + c[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(value)])]
    return pa.table([pa.array([kind] * len(cut), pa.string()), pa.array(high[cut], pa.int64()), pa.array(packed, pa.binary())], ["kind", "high", "counts"])


def summed_counts(rows: pa.Table) -> pa.Table:
    """(kind, value, p, c) of all COUNTS of a kind and high."""
    p, c = np.zeros(4096, dtype=np.int64), np.zeros(4096, dtype=np.int64)
    for x in rows["counts"].to_pylist():
        n = len(x) // 10
        low = np.frombuffer(x, "<u2", n)
        p[low] += np.frombuffer(x, "<u4", n, 2 * n)
        c[low] += np.frombuffer(x, "<u4", n, 6 * n)
    some = np.flatnonzero(c)
    kind = pa.array([rows["kind"][0].as_py()] * len(some), pa.string())
    return pa.table([kind, pa.array(some + (rows["high"][0].as_py() << 12), pa.int64()), pa.array(p[some]), pa.array(c[some])], ["kind", "value", "p", "c"])


def link_scores(left: DataFrame, right: DataFrame, links: DataFrame, keys: DataFrame, wanted: int = 50, more: int = 2, tries: int = 3, seeds: tuple[int, int] = (17, 23), block: tuple[int, int] = (20_000, 600_000)) -> DataFrame:
    """(kind, value, p, c): what ``link_prediction`` counts, of held-out links against the pairs that ``negatives`` and ``ranking_negatives`` draw.

    left, right: (i, node_id, v), numbered from 0, each node once; links: (i of
    left, near, held), the numbers of the right nodes that it is linked with and
    of those held out; keys: (key: src|dst) of all links, once each.
    kind "score": of the scores, in millionths, how many are held out (p) and how
    many in all (c). kind "better": the held-out links (c) by the number of their
    own drawn ends that score higher.

    A left node's links, held-out ones and drawn pairs meet in a block of
    ``block`` left nodes and links at most, or so; right is sent to every task. The ends that a link
    is held against are drawn where it is and leave nothing but a count; of the
    ``wanted * more`` tries, those after the first ``wanted`` only for links that
    need them.
    """
    ends = right.toArrow().sort_by("i")
    n_left, n_right = left.count(), ends.num_rows
    n_links = links.agg(F.sum(F.size("near"))).first()[0] or 0
    blocks = max(1, -(-n_left // block[0]), -(-n_links // block[1]))
    number, name = ends["i"].to_numpy(), ends["node_id"].to_pylist()
    y = np.array(ends["v"].to_pylist(), dtype=np.float64).reshape(n_right, -1)

    def run(rows: pa.Table) -> pa.Table:
        pick = lambda filled: rows.filter(pa.compute.is_valid(rows[filled]))
        nodes, linked, told = pick("node_id").sort_by("i"), pick("near"), pick("draws")
        own, src = nodes["i"].to_numpy(), nodes["node_id"].to_pylist()
        x = np.array(nodes["v"].to_pylist(), dtype=np.float64).reshape(len(own), -1)
        where = {z: j for j, z in enumerate(name)}

        def pairs(column: str) -> tuple[np.ndarray, np.ndarray]:
            """Places in own and number of the pairs that have both."""
            lists = linked[column].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            a = np.repeat(places_in(own, linked["i"].to_numpy()), np.diff(lists.offsets.to_numpy()))
            b = places_in(number, lists.flatten().to_numpy(zero_copy_only=False))
            both = (a >= 0) & (b >= 0)
            return a[both], b[both]

        near = pairs("near")
        itself = np.array([(j, where[z]) for j, z in enumerate(src) if z in where], dtype=np.int64).reshape(-1, 2)
        # pairs that must not be drawn: links, and a node with itself
        taken = one_of(np.unique(np.concatenate((near[0] * n_right + near[1], itself[:, 0] * n_right + itself[:, 1]))))

        def free(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a >= 0) & (b >= 0) & ~taken(a * n_right + b)

        def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.zeros(np.broadcast(a, b).shape)
            for k in range(min(x.shape[1], y.shape[1]) if len(x) and len(y) else 0):
                total += x[a, k] * y[b, k]
            return millionths(total)

        code = unpacked(told["n"].to_pylist(), told["draws"].to_pylist())
        first = int(rows["block"][0].as_py())
        a, b = np.divmod(code, max(1, n_right))
        a, b = places_in(own, a * blocks + first), places_in(number, b)
        good = free(a, b)
        negative = score(a[good], b[good])

        a, b = pairs("held")
        positive, better = score(a, b), np.zeros(len(a), dtype=np.int64)
        for lo in range(0, len(a), 4096):
            p, q, s = a[lo : lo + 4096], b[lo : lo + 4096], positive[lo : lo + 4096]
            heads = [f"{seeds[1]}|{src[j]}|{name[z]}|".encode() for j, z in zip(p.tolist(), q.tolist())]
            seen, above = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
            for turn in range(more):
                need = np.flatnonzero(seen < wanted)
                if not len(need):
                    break
                nth = [str(t).encode() for t in range(turn * wanted, (turn + 1) * wanted)]
                i = first_words([heads[j] + t for j in need for t in nth]).reshape(len(need), wanted) % max(1, n_right)
                z, u = places_in(number, i), np.broadcast_to(p[need, None], i.shape)
                ok = free(u, z)
                ok &= np.cumsum(ok, axis=1) + seen[need, None] <= wanted
                above[need] += (ok & (score(u, z) > s[need, None])).sum(axis=1)
                seen[need] += ok.sum(axis=1)
            better[lo : lo + 4096] = above

        value, inverse = np.unique(np.concatenate((positive, negative)), return_inverse=True)
        p, c = np.bincount(inverse[: len(positive)], minlength=len(value)), np.bincount(inverse, minlength=len(value))
        higher, n = np.unique(better, return_counts=True)
        return pa.concat_tables([packed_counts("score", value, p, c), packed_counts("better", higher, np.zeros(len(higher)), n)])

    of = (F.pmod("i", F.lit(blocks))).cast("long").alias("block")
    none = lambda **kinds: [F.lit(None).cast(kind).alias(column) for column, kind in kinds.items()]
    longs = "array<long>"
    nodes_ = left.select(of, "i", "node_id", F.col("v").cast("array<double>").alias("v"), *none(near=longs, held=longs, n="long", draws="binary"))
    links_ = links.select(of, "i", *none(node_id="string", v="array<double>"), "near", "held", *none(n="long", draws="binary"))
    draws_ = dealt_draws(keys, n_left, n_right, blocks, tries, seeds[0]).select("block", *none(i="long", node_id="string", v="array<double>", near=longs, held=longs), "n", "draws")
    got = nodes_.unionByName(links_).unionByName(draws_).groupBy("block").applyInArrow(run, COUNTS)
    return got.groupBy("kind", "high").applyInArrow(summed_counts, "kind string, value long, p long, c long")


def link_figures(counts: DataFrame, k: int = 10) -> DataFrame:
    """(n, auc, hits, mrr) of ``link_scores``."""
    from .evaluation import auc_of

    ranks = counts.filter("kind = 'better'").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.round(F.sum(F.when(F.col("value") < k, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("hits"),
        F.round(F.sum(F.col("c") / (F.col("value") + 1)) / F.sum("c"), 6).alias("mrr"))
    auc = auc_of(counts.filter("kind = 'score'").select(F.col("value").alias("score"), "p", "c"))
    return auc.select("auc").join(F.broadcast(ranks), F.lit(True)).select("n", "auc", "hits", "mrr")  # one row each
