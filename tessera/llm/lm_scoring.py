"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, from its highest bit. Each decision has a
node for every context of 0 to ``depth`` preceding bytes; a node counts the
zeros and ones seen there in training, and its Krichevsky-Trofimov estimate is
(n + 1/2) / (total + 1). Weighting mixes all depths: a node's weighted
probability of its training bits is half its own estimate's and half the
product of its children's, and the frozen model predicts a bit by the same
mixture, its weights being what training left at the nodes of the path. A
context that training never saw predicts 1/2.

All bytes of all training texts are counted. The counts are kept by
(depth + 1)-grams of bytes, so the model grows with the corpus and is never
held in one place: grams are dealt by their two last context bytes and come
sorted; a task holds the grams of one such context (2**24 of 16 bytes at most)
and the nodes below one context of three bytes (65,536 grams at most) at a
time, from the deepest nodes up and then, for its grams, from the root down.
Only sums by one context byte, 65,280 rows at most, a bound that no corpus
moves, pass through the driver. Texts are dealt in blocks of bounded size; a
block asks for just the distinct grams and words that it holds and gets their
values back.

The tokens of the unigram base score are found in the same pass.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, released, shared, texts
from .sentencepiece_sampling import chunks

DEPTH = 4
#: Bytes of text in a block, about.
BLOCK = 24 << 20
#: Contexts of so many bytes are dealt; the levels above pass through the driver.
TOP = 2
#: Grams whose nodes are held at a time, about: whole contexts of three bytes.
RUN = 1 << 17
#: Distinct grams in a deal, about; there are as many deals as shuffle partitions at least.
DEAL = 1 << 22
#: Bytes of text whose grams are coded at a time, about.
PIECE = 1 << 19
#: The end of a text, as a token that no text holds.
END = b" "


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x >= 0.5: Stirling's series after a shift by eight."""
    y = x + 8.0
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    r = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - math.log(math.pi) - lgamma(zeros + ones + 1.0)


class Level:
    """The nodes of one depth: their counts, and their log probabilities.

    A node is (context << 8) | (1 << k) | (the byte's k first bits); in a
    context the last byte stands highest, so that a parent is a right shift.
    """

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.node, self.zeros, self.ones = node, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.weighted = self.kt
        self.own = np.ones(len(node))

    @classmethod
    def of_grams(cls, grams: np.ndarray, counts: np.ndarray) -> Level:
        parts = [(((grams >> 8) << 8) | (1 << k) | ((grams & 255) >> (8 - k)), (grams >> (7 - k)) & 1) for k in range(8)]
        node, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        bit = np.concatenate([b for _, b in parts]).astype(bool)
        n = np.tile(counts.astype(np.float64), 8)
        return cls(node, np.bincount(where, n * ~bit, len(node)), np.bincount(where, n * bit, len(node)))

    def above(self) -> Level:
        """The level of the parents, mixed with these nodes."""
        node, where = np.unique(parents(self.node), return_inverse=True)
        out = Level(node, np.bincount(where, self.zeros, len(node)), np.bincount(where, self.ones, len(node)))
        out.weigh(np.bincount(where, self.weighted, len(node)))
        return out

    def weigh(self, below: np.ndarray) -> None:
        """Mixes in the children, given by the sum of their log probabilities at each node."""
        self.weighted = np.logaddexp(self.kt, below) - math.log(2)
        self.own = np.exp(self.kt - math.log(2) - self.weighted)

    def tree(self) -> tuple[np.ndarray, ...]:
        return self.node, self.zeros, self.ones, self.own


def parents(node: np.ndarray) -> np.ndarray:
    return ((node >> 16) << 8) | (node & 255)


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(grams, return_inverse=True)
    return keys, np.bincount(where, counts, len(keys))


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top to depth over these grams, weighted from the deepest up."""
    out = [Level.of_grams(grams, counts)]
    for _ in range(depth - top):
        out.append(out[-1].above())
    return out[::-1]


def joined(parts: list[Level]) -> Level:
    """Levels of one depth and of rising contexts as one."""
    out = Level(*(np.concatenate([getattr(x, name) for x in parts]) for name in ("node", "zeros", "ones")))
    out.weighted, out.own = (np.concatenate([getattr(x, name) for x in parts]) for name in ("weighted", "own"))
    return out


def mixture(grams: np.ndarray, trees: list[tuple[np.ndarray, ...]], depth: int) -> np.ndarray:
    """log10 probability of each gram's last byte; trees: (node, zeros, ones, own) from the root down."""
    total = np.zeros(len(grams))
    for k in range(8):
        p, left = np.zeros(len(grams)), np.ones(len(grams))
        bit = ((grams >> (7 - k)) & 1).astype(bool)
        for d, (node, zeros, ones, own) in enumerate(trees):
            want = ((grams >> (8 + 8 * (depth - d))) << 8) | (1 << k) | ((grams & 255) >> (8 - k))
            at = np.minimum(np.searchsorted(node, want), len(node) - 1) if len(node) else np.zeros(len(grams), dtype=np.int64)
            seen = (node[at] == want) if len(node) else np.zeros(len(grams), dtype=bool)
            n = np.where(seen, np.where(bit, ones[at], zeros[at]), 0.0) if len(node) else np.zeros(len(grams))
            both = np.where(seen, ones[at] + zeros[at], 0.0) if len(node) else np.zeros(len(grams))
            w = 1.0 if d == depth else np.where(seen, own[at], 0.5) if len(node) else 0.5
            p += left * w * (n + 0.5) / (both + 1.0)
            left = left * (1.0 - w)
        total += np.log10(p)
    return total


def codes(items: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of the texts (last byte lowest, then the byte before it highest), and each text's first byte."""
    pad = bytes(depth)
    joined = pad + pad.join(items)
    data = np.frombuffer(joined, dtype=np.uint8).astype(np.int64)
    n = len(data) - depth
    code = np.zeros(n, dtype=np.int64)
    for back in range(1, depth + 1):
        code = (code << 8) | data[depth - back : depth - back + n]
    code = (code << 8) | data[depth:]
    size = np.fromiter(map(len, items), dtype=np.int64, count=len(items))
    first = np.cumsum(size + depth) - size - depth
    inside = np.ones(n, dtype=bool)
    ends = first + size
    for i in range(depth):
        gap = ends + i
        inside[gap[gap < n]] = False
    return code[inside], np.cumsum(size) - size


def held_out(spec_mod: int, spec_rest: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % spec_mod == spec_rest


def asked(rows: DataFrame, depth: int) -> DataFrame:
    """(block, word, gram, n): the distinct words and grams of each block's texts, and how often they are in training texts."""
    import pandas as pd

    names = ["block", "word", "gram", "n"]

    def given(block: int, count: Counter, found: list):
        keys = list(count)
        for i in range(0, len(keys), 1 << 16):
            some = keys[i : i + (1 << 16)]
            own, n = pa.array(np.full(len(some), block, dtype=np.int32)), pa.array([count[w] for w in some], type=pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.array(some, type=pa.binary()), pa.nulls(len(some), pa.int64()), n], names=names)
        distinct, n = gathered(found) if found else (np.empty(0, dtype=np.int64),) * 2
        found.clear()
        for i in range(0, len(distinct), 1 << 16):
            some = distinct[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block, dtype=np.int32)), pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(n[i : i + (1 << 16)])], names=names)

    def run(batches):
        # rows come block by block: one block's words and grams are held at a time
        block, count, found, merged, size = None, Counter(), [], 0, 0
        waiting: dict[int, list[bytes]] = {}  # by how often the texts count in training

        def drain() -> None:
            nonlocal merged, size
            for times, items in waiting.items():
                for part in chunks(items, PIECE):
                    where, distinct = pd.factorize(codes(items[part], depth)[0])
                    found.append((distinct, np.bincount(where, minlength=len(distinct)) * times))
            waiting.clear()
            size = 0
            if sum(len(g) for g, _ in found) > 2 * merged + (1 << 18):
                found[:] = [gathered(found)]
                merged = len(found[0][0])

        for batch in batches:
            column = {name: batch.column(name).to_pylist() for name in ("block", "held_out", "times")}
            for own, held, times, text in zip(*column.values(), batch.column("text")):
                if own != block:
                    if block is not None:
                        drain()
                        yield from given(block, count, found)
                    block, count, merged = own, Counter(), 0
                raw = text.as_buffer().to_pybytes()
                times = 0 if held else times
                if times == 1:
                    count.update(raw.lower().split())
                    count[END] += 1
                else:
                    for w in [*raw.lower().split(), END]:
                        count[w] += times
                waiting.setdefault(times, []).append(raw)
                size += len(raw)
                if size >= PIECE:
                    drain()
        if block is not None:
            drain()
            yield from given(block, count, found)

    return rows.mapInArrow(released(run), "block int, word binary, gram long, n long")


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = summed(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))
    return keys, n.astype(np.int64)


def in_deals(counted: DataFrame, depth: int, deals: int, run, schema: str) -> DataFrame:
    """run over all grams of a deal, sorted, the grams with the same TOP last context bytes being in one."""
    dealt = counted.repartition(deals, F.expr(f"shiftright(gram, {8 * (depth - TOP) + 8})"))
    return dealt.sortWithinPartitions("gram").mapInArrow(released(run), schema)


def runs(grams: np.ndarray, shift: int, most: int):
    """Slices of about ``most`` sorted grams, those that agree above ``shift`` bits being in one."""
    context, at = grams >> shift, 0
    while at < len(grams):
        stop = int(np.searchsorted(context, context[min(at + most, len(grams)) - 1], side="right"))
        yield slice(at, stop)
        at = stop


def small(batches, depth: int, most: int):
    """(grams, counts) of one or more whole contexts of TOP bytes, of sorted grams: about ``most`` grams, or a larger context alone."""
    shift = 8 * (depth - TOP) + 8
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, enough = 0, most
    for batch in batches:
        held.append(tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "n")))
        size += len(held[-1][0])
        if size < enough:
            continue
        grams, n = map(np.concatenate, zip(*held))
        cut = int(np.searchsorted(grams >> shift, grams[-1] >> shift))
        if cut:
            yield grams[:cut], n[:cut]
        held = [(grams[cut:].copy(), n[cut:].copy())]
        size = len(grams) - cut
        enough = max(most, 2 * size)  # a context beyond ``most`` is not joined anew with each batch
    if size:
        grams, n = map(np.concatenate, zip(*held))
        yield grams, n


def top_level(grams: np.ndarray, n: np.ndarray, depth: int, most: int) -> Level:
    """The level TOP over sorted grams of whole contexts, with the nodes below one run of longer contexts at a time."""
    if depth == TOP:
        return Level.of_grams(grams, n)
    return joined([levels(grams[part], n[part], depth, TOP + 1)[0] for part in runs(grams, 8 * (depth - TOP), most)]).above()


def gram_scores(counted: DataFrame, depth: int, deals: int, most: int) -> DataFrame:
    """(gram, value): log10 of the frozen model's probability of the gram's last byte."""

    def upper(batches):
        for grams, n in small(batches, depth, most):
            seen = n > 0
            if seen.any():
                top = top_level(grams[seen], n[seen], depth, most)
                node, where = np.unique(parents(top.node), return_inverse=True)
                sums = [np.bincount(where, x, len(node)) for x in (top.zeros, top.ones, top.weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(node), *map(pa.array, sums)], names=["node", "zeros", "ones", "weighted"])

    sums = in_deals(counted, depth, deals, upper, "node long, zeros double, ones double, weighted double")
    got = sums.groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "weighted"))).orderBy("node").toArrow()  # 255 * 256 rows at most
    node, zeros, ones, weighted = (got.column(i).to_numpy() for i in range(4))
    low = Level(node, zeros, ones)
    if len(node):
        low.weigh(weighted)
    trees = [low.tree()]
    for _ in range(TOP - 1):
        low = low.above()
        trees.insert(0, low.tree())
    sent = counted.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        none = np.empty(0)
        empty = (none.astype(np.int64), none, none, none)
        for grams, n in small(batches, depth, most):
            seen = n > 0
            top = top_level(grams[seen], n[seen], depth, most).tree() if seen.any() else empty
            for part in runs(grams, 8 * (depth - TOP), most):
                own = seen[part]
                below = [x.tree() for x in levels(grams[part][own], n[part][own], depth, TOP + 1)] if own.any() and depth > TOP else [empty] * (depth - TOP)
                yield pa.RecordBatch.from_arrays([pa.array(grams[part]), pa.array(mixture(grams[part], [*sent.value, top, *below], depth))], names=["gram", "value"])

    return in_deals(counted, depth, deals, score, "gram long, value double")


def scored(rows: DataFrame, values: DataFrame, depth: int, unseen: float) -> DataFrame:
    import pandas as pd

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.filter(right.column("gram").is_null())
        value = dict(zip(told.column("word").to_pylist(), told.column("value").to_pylist()))
        told = right.select(["gram", "value"]).filter(right.column("gram").is_valid()).sort_by("gram")
        grams, bits = told.column("gram").to_numpy(), told.column("value").to_numpy()
        del told, right
        n, known, base, score = [], [], [], []
        end = value.get(END, unseen)
        texts_ = left.column("text")
        for part in chunks([len(x.as_buffer()) for x in texts_], PIECE, size=int):
            raw = [x.as_buffer().to_pybytes() for x in texts_[part]]
            for x in raw:
                got = list(map(value.__getitem__, x.lower().split()))
                got.append(end)
                n.append(len(got))
                known.append(len(got) - got.count(unseen))
                base.append(math.fsum(got))
            code, first = codes(raw, depth)
            where, distinct = pd.factorize(code)
            each = np.concatenate((bits[np.searchsorted(grams, distinct)][where] if len(code) else np.empty(0), [0.0]))
            sums = np.add.reduceat(each, first)
            score.extend(np.where(np.diff(np.append(first, len(code))) > 0, sums, 0.0).tolist())
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "times": left.column("times"), "n_tokens": pa.array(n, type=pa.int64()),
            "n_known": pa.array(known, type=pa.int64()), "base_score": pa.array(base, type=pa.float64()), "score": pa.array(score, type=pa.float64()),
        })

    def released_after(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    schema = "doc_id long, held_out boolean, times long, n_tokens long, n_known long, base_score double, score double"
    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(released_after, schema)


def repeated(rows: DataFrame, times: str, most: int = 1 << 16) -> DataFrame:
    """Each row ``times`` times, by arrays of ``most`` entries at most."""
    full = rows.withColumn("__run", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {most})")))
    return full.withColumn("__run", F.explode(F.expr(f"sequence(1L, least({most}L, {times} - __run * {most}))"))).drop("__run")


def score(
    df: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK, run_grams: int = RUN,
    id_col: str = "doc_id", text_col: str = "text", mod: int = 10, rest: int = 0,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text; empty for a null id) mod ``mod`` is ``rest``
    are held out, the others train. score is the model's log10 probability of
    the text's bytes: 0 for an empty or null text, which has the end as its
    only token. Without training rows every bit has the probability 1/2.
    Repeated rows count repeatedly and get equal scores, as have tied ones. A
    text of any length is scored whole. An empty table gives no rows; columns
    other than the two named are not read.
    """
    rows = texts(df, id_col, text_col).withColumn("held_out", held_out(mod, rest))
    # rows without an id are told apart by nothing but their text: copies count as one row
    alone = rows.filter("doc_id IS NULL").groupBy("doc_id", "text", "held_out").agg(F.count("*").alias("times"))
    rows = rows.filter("doc_id IS NOT NULL").withColumn("times", F.lit(1).cast("long")).unionByName(alone)
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil((size + 64 * n) / block_bytes))
    # a block is a partition: by its number, not by a hash that would put several together
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block).repartitionById(blocks, F.col("block"))
    wanted = shared(asked(rows, depth))
    words = shared(wanted.filter("gram IS NULL").groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    every = total + 0.1 * (distinct + 1)
    unseen = math.log10(0.1 / every)
    value = F.when(F.col("n") > 0, F.log10((F.col("n") + F.lit(0.1)) / F.lit(every))).otherwise(F.lit(unseen))
    # one kind after the other, so that the shuffles of the first are gone before the second
    of_words = wanted.filter("gram IS NULL").select("block", "word").join(words.select("word", value.alias("value")), "word")
    of_words = shared(of_words.select("block", "word", F.lit(None).cast("long").alias("gram"), "value"))
    grams = shared(wanted.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    deals = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(grams.count() / DEAL))
    gram_value = shared(gram_scores(grams, depth, deals, run_grams))
    of_grams = wanted.filter("gram IS NOT NULL").select("block", "gram").join(gram_value, "gram")
    back = of_words.unionByName(shared(of_grams.select("block", F.lit(None).cast("binary").alias("word"), "gram", "value")))
    del wanted, grams, words, gram_value, of_grams
    out = repeated(scored(rows, back.repartitionById(blocks, F.col("block")), depth, unseen), "times")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too: the unigram base score and the context tree's."""
    return score(documents(spark, sf_dir))
