"""Toxicity by noisy-channel deobfuscation.

A word that may be disguised (digits or signs among letters, letters
repeated, signs between letters, letters spaced apart) becomes a lattice: each
character may stand for itself, for a letter that it imitates, for a
repetition of the letter before it, or for nothing, and a sign or space between
letters also for the end of a word. Viterbi decoding finds the
most probable letters under a character trigram model, whose counts come from
all texts. A text's features are the words, and the beginnings of words, of
what it says and of what it was restored to; a sparse logistic regression over
the features that tell toxic texts best gives its score.

The regression is fitted on at most ``fit_rows`` labelled training rows.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, give_back, quoted, released, shared, texts, worker_cache
from .fitting import held_out, labelled, lasso_logistic

FIT_ROWS, FEATURES = 20_000, 1_000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
#: A character is itself, looks like a letter, repeats the one before (the second, later ones), is nothing, is a digit.
SAME, LOOKS, TWICE, AGAIN, NOTHING, DIGIT = (math.log(p) for p in (0.9, 0.2, 0.02, 0.5, 0.2, 1e-6))
SUSPECT = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[0-9@$!|+(€£¡µ][^\W\d_]|[^\W\d_][0-9@$!|+€]|([^\W\d_])\1\1")
#: What may stand for the space between two words, and how much less probable than the best a division may be.
SIGNS = re.compile(r"(?:[^\w@$!|+(€£¡µ]|_)+")
MARGIN = 8.0
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def lm_counts(rows: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts, 27**3 of them; 0 is any other byte."""

    def run(batches):
        table = np.zeros(256, dtype=np.int64)
        for i, c in enumerate(LETTERS):
            table[ord(c)] = table[ord(c.upper())] = i + 1
        total = np.zeros(27**3, dtype=np.int64)
        for batch in batches:
            column = batch.column("text")
            data = np.frombuffer(("\0\0" + "\0\0".join(column.to_pylist()) + "\0").encode(), dtype=np.uint8)
            for at in range(0, len(data), 1 << 22):
                code = table[data[at : at + (1 << 22) + 2]]
                total += np.bincount((code[:-2] * 27 + code[1:-1]) * 27 + code[2:], minlength=27**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "n"])

    got = rows.select("text").mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 19,683 rows at most
    counts = np.zeros(27**3)
    counts[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return counts


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), of trigrams backed off to bigrams and letters."""
    three = counts.reshape(27, 27, 27)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + 27)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5))


def restore(word: str, model: list) -> str:
    """The most probable letters behind a word of lower-case characters."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # by the last two letters' classes; what was read as (what came before, character)
    last, before = "", ""
    for ch in word:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        options = [(ch, SAME)] if ch.isalpha() else [(c, LOOKS) for c in LEET.get(ch, "")]
        if ch.isdigit():
            options.append((ch, DIGIT))
        nothing = (AGAIN if ch == before else TWICE) if ch == last else None if ch.isalnum() else NOTHING
        for (a, b), (p, out) in best.items():
            for c, cost in options:
                k = ord(c) - 96 if "a" <= c <= "z" else 0
                q = p + cost + model[a][b][k]
                if q > new.get((b, k), (-math.inf,))[0]:
                    new[b, k] = (q, (out, c))
            skip = nothing
            if skip is None and options and options[0][1] == LOOKS and out and out[1] in LEET.get(ch, ""):
                skip = TWICE
            if skip is not None and p + skip > new.get((a, b), (-math.inf,))[0]:
                new[a, b] = (p + skip, out)
        best = new or best
        last, before = ch, last

    def spelled(out: tuple | None) -> str:
        letters = []
        while out:
            out, c = out
            letters.append(c)
        return "".join(reversed(letters))

    ends = [(p + model[a][b][0], out) for (a, b), (p, out) in best.items()]
    top = max(p for p, _ in ends)
    return max(spelled(out) for p, out in ends if p == top)


def readings(word: str, model: list) -> list[str]:
    """A word without signs at its ends, and what it may be restored to; letters spaced apart come as one word with spaces."""
    word = word.replace(" ", "")
    core = EDGES.sub("", word)
    out = [core] if core else []
    whole = word[0] + core if word[0] in LEET and not word[0].isdigit() else core
    if len(whole) > 2 and SUSPECT.search(whole):
        out.append(restore(whole, model))
    return out


def divided(letters: str, model: list) -> list[str]:
    """The words of every division of letters that is at most MARGIN less probable than the best one."""
    n, k = len(letters), [ord(c) - 96 if "a" <= c <= "z" else 0 for c in letters]
    rest, inside, first = ([0.0] * (n + 1) for _ in range(3))  # best of letters[i:] after letters[i - 1] and a space, two letters, a space and a letter
    for i in range(n, 0, -1):
        if i < n:
            rest[i] = model[k[i - 1]][0][k[i]] + first[i + 1]
        for table, a in (inside, k[i - 2]), (first, 0):
            end = model[a][k[i - 1]][0] + rest[i]
            table[i] = max(end, model[a][k[i - 1]][k[i]] + inside[i + 1]) if i < n else end
    best = model[0][0][k[0]] + first[1]
    so_far = [0.0] + [-math.inf] * n  # best of letters[:i] and a space
    out = []
    for i in range(n):
        p, a, b = so_far[i], k[i - 1] if i else 0, 0
        if p == -math.inf:
            continue
        for j in range(i + 1, n + 1):
            p += model[a][b][k[j - 1]]
            a, b = b, k[j - 1]
            end = p + model[a][b][0]
            if end + rest[j] >= best - MARGIN:
                so_far[j] = max(so_far[j], end)
                out.append(letters[i:j])
            if j < n and p + max(model[a][b][0] + rest[j], model[a][b][k[j]] + inside[j + 1]) < best - MARGIN:
                break
    return out


def parts(word: str, model: list) -> list[str]:
    """The words that a word may hold between its signs, if there are some; of single letters, the words of their divisions."""
    chunks = [c for c in SIGNS.split(word) if c]
    out = []
    for single, group in groupby(chunks, key=lambda c: len(c) == 1) if len(chunks) > 1 else ():
        said = [r for c in (["".join(group)] if single else group) for r in readings(c, model)[-1:] if r]
        out += [w for r in said for w in divided(r, model)] if single else said
    return out


def features(words: list[str], model: list) -> set[str]:
    out = set()
    for word in words:
        for read in readings(word, model) + parts(word, model):
            out.add(read + "$")
            out.update(read[:k] for k in (4, 5, 6) if len(read) > k)
    return out


def runs(words: list[str]) -> list[list[str]]:
    """Runs of three and more words of one character."""
    short = "".join(["x" if len(w) == 1 else " " for w in words])
    return [words[m.start() : m.end()] for m in re.finditer("xxx+", short)] if "xxx" in short else []


def spaced(words: list[str]) -> list[str]:
    """What runs of three and more words of one character spell."""
    return ["".join(run) for run in runs(words)]


def all_words(text: str) -> list[str]:
    """The words, and each run of words of one character as a word with spaces."""
    words = text.lower().split()
    return words + [" ".join(run) for run in runs(words)]


def shipped(model: np.ndarray) -> bytes:
    return model.astype(np.float32).tobytes()


def unpacked(raw: bytes) -> list:
    cache = worker_cache()
    key = ("letters", hash(raw))
    if key not in cache:
        cache[key] = np.frombuffer(raw, dtype=np.float32).reshape(27, 27, 27).tolist()
    return cache[key]


class Toxicity:
    """What was learnt: the character model, and weights of features."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = shipped(model), weights, bias

    def restored(self, text: str) -> str:
        """The text with each suspect word restored."""
        model = unpacked(self.model)
        return " ".join(r[-1] for r in (readings(w, model) for w in all_words(text)) if r)

    def scores(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """(doc_id, score) of every row, 0 to 1; an empty or null text has the score of no feature.

        With ``keep``, these columns of df come with the score instead of the id.
        """
        raw, weights, bias = self.model, self.weights, self.bias

        def run(batches):
            model = unpacked(raw)
            seen: set[str] = set()
            telling: dict[str, tuple[str, ...]] = {}
            for batch in batches:
                scores = []
                for text in batch.column("__text").to_pylist():
                    words = set(all_words(text or ""))
                    for w in words - seen:
                        if got := tuple(f for f in features([w], model) if f in weights):
                            telling[w] = got
                    if len(seen) > 500_000:
                        seen.clear()
                    seen |= words
                    total = math.fsum(weights[f] for f in {f for w in words & telling.keys() for f in telling[w]})
                    scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, bias + total)))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, type=pa.float64())], names=[*batch.schema.names[:-1], "__score"])

        own = df.select(*([quoted(c) for c in keep] if keep is not None else [quoted(id_col).cast("long").alias("doc_id")]), quoted(text_col).alias("__text"))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]), "__score double"])
        return own.mapInArrow(released(run), schema)


def fit(df: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, n_features: int = FEATURES, penalty: float = 1e-4, mod: int = 4, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Learns the character model from all texts, weights from labelled training rows.

    With no labelled row, or labels of one kind only, the score is that kind's share (1/2 without any).
    """
    rows = texts(df, id_col, text_col)
    model = trigram_model(lm_counts(rows))
    raw = shipped(model)
    sample = rows.join(F.broadcast(labelled(labels, "toxic", mod, rest, fit_rows)), "doc_id").select("label", "text")

    def tally(batches):
        letters = unpacked(raw)
        counts = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                counts[label == 1].update(features(list(set(all_words(text))), letters))
                counts[label == 1][""] += 1
        names = list({**counts[0], **counts[1]})
        for at in range(0, len(names), 1 << 16):
            some = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.string()), *(pa.array([c[x] for x in some], type=pa.int64()) for c in counts)], names=["feature", "clean", "toxic"])

    counted = sample.mapInArrow(released(tally), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = shared(counted)
    totals = counted.filter("feature = ''").first()
    clean, toxic = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    if not clean or not toxic:
        return Toxicity(model, {}, 50.0 if toxic else -50.0 if clean else 0.0)

    def part(o, e):
        return F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)

    both = F.col("clean") + F.col("toxic")
    n = float(clean + toxic)
    gain = part(F.col("toxic"), both * (toxic / n)) + part(F.col("clean"), both * (clean / n)) + part(F.lit(toxic) - F.col("toxic"), (F.lit(n) - both) * (toxic / n)) + part(F.lit(clean) - F.col("clean"), (F.lit(n) - both) * (clean / n))
    best = counted.filter(f"feature <> '' AND toxic >= 3 AND toxic * {clean} > clean * {toxic}").withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(n_features)
    names = [r["feature"] for r in best.select("feature").collect()]  # n_features at most
    place = {name: i for i, name in enumerate(names)}

    def marked(batches):
        letters = unpacked(raw)
        for batch in batches:
            found = [sorted(place[f] for f in features(list(set(all_words(t))), letters) if f in place) for t in batch.column("text").to_pylist()]
            packed = pa.array([np.array(x, dtype=np.int16).tobytes() for x in found], type=pa.binary())  # n_features is less than 2**15
            yield pa.RecordBatch.from_arrays([batch.column("label"), packed], names=["label", "found"])

    # rows that have the same features and label count together; their features come as bytes, which take little of the driver's memory
    told = sample.mapInArrow(released(marked), "label int, found binary").groupBy("label", "found").agg(F.count("*").alias("n")).orderBy("label", "found").toArrow()
    x = np.zeros((told.num_rows, len(names)), dtype=np.float32)
    for i, found in enumerate(told.column("found")):
        x[i, np.frombuffer(found.as_buffer(), dtype=np.int16)] = 1.0
    y = (told.column("label").to_numpy() == 1).astype(float)
    weights, bias = lasso_logistic(x, y, penalty, times=told.column("n").to_numpy().astype(float))
    del x, told
    give_back()
    return Toxicity(model, {name: float(w) for name, w in zip(names, weights) if w}, bias)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per document, scored by what the labels outside the held-out fold teach; empty and null texts get the score of no feature."""
    docs = documents(spark, sf_dir)
    learnt = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return learnt.scores(docs).select("doc_id", held_out(4, 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
