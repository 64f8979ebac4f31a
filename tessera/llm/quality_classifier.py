"""Quality classification by a sparse rule ensemble.

Small trees are grown over statistics of the labelled texts; every path from a
root to a node is a conjunctive rule. A lasso logistic regression keeps few of
the rules, and these are compiled into one Spark column expression over the
statistics. The statistics come from one Arrow pass over the texts.

Trees and weights are fitted on at most ``fit_rows`` labelled training rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, documents, released, texts, windows
from .fitting import held_out, labelled, lasso_logistic
from .sentencepiece_sampling import chunks

FIT_ROWS, TREES, DEPTH = 20_000, 24, 3
CLASSES = {
    "symbols": b"#*$%&|<>",
    "pipes": b"|",
    "shouts": b"!",
    "upper": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "marks": b".,;:?",
    "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "space": bytes(np.flatnonzero(SPACE).tolist()),
}
STATS = ["n_bytes", "n_words", "word_bytes", *CLASSES, "line_bytes", "dup_lines", "repeats", "distinct", "stops"]


MEMBERS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    MEMBERS[list(_members), _i] = 1


def repeated(sorted_hashes: np.ndarray) -> float:
    """The share of entries that are equal to one before."""
    return float(np.count_nonzero(sorted_hashes[1:] == sorted_hashes[:-1])) / max(1, len(sorted_hashes))


def statistics_of(items: list[bytes]) -> np.ndarray:
    """One row of STATS for each text; shares are of its bytes, words or lines, and 0 where it has none."""
    out = np.zeros((len(items), len(STATS)))
    words = Words(items)
    grams = windows(words.hash, 5)
    at = 3 + len(CLASSES)
    for i, x in enumerate(items):
        seen = np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256) @ MEMBERS
        a, b = int(words.first[i]), int(words.first[i + 1])
        lines = x.split(b"\n")
        full = [y.rstrip() for y in lines]
        full = [y for y in full if y]
        out[i, 0], out[i, 1], out[i, 2] = math.log1p(len(x)), math.log1p(b - a), (len(x) - seen[-1]) / max(1, b - a)
        out[i, 3:at] = seen / max(1, len(x))
        out[i, at] = math.log1p(len(x) / len(lines))
        out[i, at + 1] = (len(full) - len(set(full))) / max(1, len(full))
        out[i, at + 2] = repeated(np.sort(grams[a : b - 4])) if b - a > 4 else 0.0
        out[i, at + 3] = repeated(np.sort(words.hash[a:b]))
        out[i, at + 4] = sum(y.endswith((b".", b"!", b"?", b":")) for y in full) / max(1, len(full))
    return out


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS...) of every row; a null or empty text has 0 in all but line_bytes, equal rows are equal, texts of any length are read whole."""

    def run(batches):
        for batch in batches:
            items = [x.encode() for x in batch.column("text").to_pylist()]
            for part in chunks(items):
                got = statistics_of(items[part])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], *(pa.array(got[:, i]) for i in range(len(STATS)))], names=["doc_id", *STATS])

    return texts(df, id_col, text_col).mapInArrow(released(run), "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


def paths(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """The paths of one tree, grown by Gini gain over a random part of the statistics."""
    if depth == 0 or len(y) < 40 or y.min() == y.max():
        return []
    best = (1e-6, -1, 0.0)
    total, n = y.sum(), len(y)
    for j in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, c = x[order, j], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        may = (v[1:] > v[:-1]) & (k >= 15) & (n - k >= 15)
        if may.any():
            gain = np.where(may, (c * c / k + (total - c) ** 2 / (n - k)) - total * total / n, 0.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(j), float((v[i] + v[i + 1]) / 2))
    _, j, threshold = best
    if j < 0:
        return []
    out = []
    for above in (False, True):
        side = (x[:, j] > threshold) == above
        mine = (*path, (j, above, threshold))
        out += [mine, *paths(x[side], y[side], depth - 1, rng, mine)]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > t) == above for j, above, t in rule])


class RuleEnsemble:
    def __init__(self, rules: list[tuple[Rule, float]], bias: float):
        self.rules, self.bias = rules, bias

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            every = F.lit(True)
            for j, above, t in rule:
                every = every & ((F.col(STATS[j]) > F.lit(t)) if above else (F.col(STATS[j]) <= F.lit(t)))
            total = total + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = 5e-4, mod: int = 3, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """Learns rules from labelled training rows; without labels the score is 1/2, with one kind only that kind's.

    Labels that are null or without a document don't count; of several labels
    of an id the greatest does. Documents that share an id are all samples.
    """
    sample = texts(df, id_col, text_col).join(F.broadcast(labelled(labels, "quality", mod, rest, fit_rows)), "doc_id")
    got = statistics(sample).join(F.broadcast(labelled(labels, "quality", mod, rest, fit_rows)), "doc_id").orderBy("doc_id", *STATS).toArrow()
    y = (got.column("label").to_numpy() == 1).astype(float)
    x = np.column_stack([got.column(s).to_numpy() for s in STATS])
    if not len(y) or y.min() == y.max():
        return RuleEnsemble([], 0.0 if not len(y) else 50.0 if y[0] else -50.0)
    rng = np.random.default_rng(0)
    rules = {}
    for _ in range(trees):
        rows = rng.choice(len(y), len(y))
        for rule in paths(x[rows], y[rows], depth, rng):
            rules.setdefault(tuple(sorted(rule)), None)
    rules = list(rules)
    # of rules that hold for the same rows, the first
    z = np.column_stack([holds(r, x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    weights, bias = lasso_logistic(z[:, first], y, penalty)
    return RuleEnsemble([(rules[i], float(w)) for i, w in zip(first, weights) if w], bias)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """One row per document, null and empty texts too, scored by the rules that the labels outside the held-out fold teach."""
    docs = documents(spark, sf_dir)
    learnt = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = statistics(docs).select("doc_id", held_out(3, 1).alias("held_out"), learnt.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
