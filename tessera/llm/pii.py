"""Personal data by weak supervision.

Candidate spans come from patterns and from context words (a gazetteer of the
names that precede secrets). Labelers then vote on each candidate, for, against
or not at all: its format's check, gazetteers, the words before it, its shape.
Expectation-maximisation over the counts of vote patterns of the whole corpus
estimates how reliable each labeler is for each kind and how probable each
candidate is; a logistic regression over the candidate's features (what its
labelers look at, and its length, alphabet and neighbours, which no labeler
sees) is trained on these probabilities and makes the final decision. Base
spans always stay; the classifier adds further ones, the more probable of two
that overlap.

The counts are of patterns (at most ``KINDS * 3**LABELERS * 2**SHAPES``, the
other features being what the votes say), so what the driver sees has a bound
that no corpus moves.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, quoted, released, shared, small_batches
from .fitting import lasso_logistic

#: As listed: the base kinds, then those of the method.
KIND_NAMES = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
KINDS, LABELERS, SHAPES = len(KIND_NAMES), 5, 5
FEATURES = LABELERS + SHAPES
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as the contract's: a match never starts within digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})")
OPAQUE = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
#: Words that, shortly before a span, speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write to", "@"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "master", "credit", "pay", "cc"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
    "secret": ("pass", "pwd", "token", "secret", "key", "auth"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "iban": ("iban", "bank", "account", "transfer"),
}
TOP_DOMAINS = frozenset("com org net edu gov io co de fr es uk us info biz eu ch at it nl".split())
#: Numbers of this form that were printed for show and belong to nobody.
VOID_NUMBERS = frozenset(("078051120", "219099999", "123456789", "111111111"))
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "30", "36", "38")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans; leftmost and non-overlapping within a kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL_SET:
            left -= 1
        if left < at and (m := DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not any(c in text for c in "0123456789"):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): base spans, and what else may be personal data.

    Only base spans keep a candidate away, and a card not the IBAN whose digits
    it is; the other candidates may overlap until the classifier has spoken.
    """
    base = base_spans(text)
    out = {(s, k, e): True for s, k, e in base}
    # of the base cards, which are apart, and of all other base spans: starts, and the greatest end so far
    cards, rest = [x for x in base if x[1] == 2], [x for x in base if x[1] != 2]
    starts, ends = [x[0] for x in rest], list(accumulate((x[2] for x in rest), max))
    firsts, lasts = [x[0] for x in cards], [x[2] for x in cards]

    def add(k: int, s: int, e: int) -> None:
        i = bisect_left(starts, e)
        if i and ends[i - 1] > s:
            return
        low, high = bisect_right(lasts, s), bisect_left(firsts, e)  # the cards that it meets
        if low < high and not (k == 6 and s <= firsts[low] and lasts[high - 1] <= e):
            return
        out.setdefault((s, k, e), False)

    if any(c in text for c in "0123456789"):
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                add(2, m.start(), m.end())
        for k, pattern in ((5, SSN), (3, LOCAL_PHONE), (6, IBAN)):
            for m in pattern.finditer(text):
                add(k, m.start(), m.end())
        for m in OPAQUE.finditer(text):
            add(4, m.start(), m.end())
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            add(4, m.start(2), m.end(2))
    return sorted((*span, is_base) for span, is_base in out.items())


def judged(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The votes (base 3: 0 none, 1 against, 2 for) and the features (bits) of a candidate."""
    span = text[start:end]
    name = KIND_NAMES[kind]
    digits = [c for c in span if "0" <= c <= "9"]
    before = text[max(0, start - 24) : start].lower()
    near = any(w in before for w in CONTEXT[name])
    joined = "".join(digits)
    if kind == 0:
        valid, known = ".." not in span and not span.startswith("."), span.rpartition(".")[2].lower() in TOP_DOMAINS
    elif kind == 1:
        valid, known = all(p == "0" or not p.startswith("0") for p in span.split(".")), not before.rstrip().endswith(("v", "version", "section"))
    elif kind == 2:
        valid, known = luhn(joined), joined.startswith(CARD_STARTS)
    elif kind == 3:
        valid, known = 10 <= len(digits) <= 15, span.startswith(("+", "("))
    elif kind == 4:
        valid, known = len(span) >= 12, len(set(span)) >= 8
    elif kind == 5:
        valid, known = not span.startswith(("000", "666", "9")) and span[4:6] != "00" and span[7:] != "0000", joined not in VOID_NUMBERS
    else:
        packed = span.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4]))
        valid, known = number % 97 == 1, len(packed) >= 15
    varied = len(set(span)) >= min(5, len(span))
    alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    votes = (2 if valid else 1, 2 if known else 1, 2 if near else 0, 2 if varied else 1, 2 if alone else 1)
    shapes = (len(span) >= 20, 2 * len(digits) >= len(span), any(c in " -." for c in span), before.rstrip()[-1:] in ("=", ":"), text[end : end + 1] in ("", " ", "\n", ".", ","))
    flags = (valid, known, near, varied, alone, *shapes)
    return sum(v * 3**i for i, v in enumerate(votes)), sum(int(f) << i for i, f in enumerate(flags))


SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,votes:int,flags:int>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("flags", pa.int32())]))
ARROW_RESULT = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def found(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns keep, and __spans: all candidates with their votes."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("__text").to_pylist():
                out.append([(s, k, e, b, *judged(text, s, k, e)) for s, k, e, b in candidates(text)] if text else [])
            lists = [[dict(zip(("start", "kind", "end", "base", "votes", "flags"), x)) for x in row] for row in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lists, type=ARROW_SPANS)], names=[*batch.schema.names[1:], "__spans"])

    own = df.select(quoted(text_col).alias("__text"), *(quoted(c) for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(released(run), f"{schema}, __spans {SPANS}")


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: each pattern's probability, and P(vote | class) of each labeler, (labelers, 2, 3)."""
    theta = np.tile(np.array([[0.3, 0.5, 0.2], [0.2, 0.2, 0.6]]), (votes.shape[1], 1, 1))
    prior = 0.5
    for _ in range(rounds):
        logs = np.log([1 - prior, prior]) + sum(np.log(theta[i][:, votes[:, i]]).T for i in range(votes.shape[1]))
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        p /= p.sum(axis=1, keepdims=True)
        mass = p * n[:, None]
        prior = min(0.999, max(0.001, (mass[:, 1].sum() + 1) / (n.sum() + 2)))
        for i in range(votes.shape[1]):
            for c in (0, 1):
                theta[i, c] = [mass[votes[:, i] == v, c].sum() + 0.5 for v in range(3)]
            theta[i] /= theta[i].sum(axis=1, keepdims=True)
    return p[:, 1], theta


def learnt(patterns: list) -> tuple[dict[tuple[int, int], float], dict[str, np.ndarray]]:
    """Of (kind, flags): the classifier's probability; of a kind: its labelers' reliabilities."""
    accepted, reliable = {}, {}
    for kind in range(KINDS):
        own = sorted((r["votes"], r["flags"], r["n"]) for r in patterns if r["kind"] == kind)
        if not own:
            continue
        votes = np.array([[v // 3**i % 3 for i in range(LABELERS)] for v, _, _ in own])
        n = np.array([x for _, _, x in own], dtype=float)
        p, reliable[KIND_NAMES[kind]] = reliabilities(votes, n)
        x = np.array([[f >> i & 1 for i in range(FEATURES)] for _, f, _ in own], dtype=float)
        w, b = lasso_logistic(x, p, 1e-4, times=n)  # soft labels
        for (_, f, _), row in zip(own, x):
            accepted[kind, f] = float(1 / (1 + math.exp(-max(-50.0, min(50.0, row @ w + b)))))
    return accepted, reliable


def resolved(spans: list[dict], accepted: dict[tuple[int, int], float], threshold: float) -> list[dict]:
    """The base spans, and of the accepted others those that overlap no more probable, or else longer, one that stays."""
    ranked = sorted((-accepted[s["kind"], s["flags"]], s["start"] - s["end"], s["start"], s["kind"], s["end"]) for s in spans if not s["base"] and accepted.get((s["kind"], s["flags"]), -1.0) >= threshold)
    out = [(s["start"], s["kind"], s["end"], True) for s in spans if s["base"]]
    taken: list[tuple[int, int]] = []  # apart, by start
    for _, _, start, kind, end in ranked:
        i = bisect_left(taken, (end,))
        if not i or taken[i - 1][1] <= start:
            taken.insert(i, (start, end))
            out.append((start, kind, end, False))
    return [dict(zip(("start", "kind", "end", "base"), s)) for s in sorted(out)]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) of every row, or with ``keep`` these columns (none called spans) and spans.

    spans is an array of (start, kind, end, base), by start and then kind: code
    points, end exclusive; further spans never overlap each other. An empty or
    null text has no spans. Equal rows get equal spans. Texts of any length are
    searched whole, in time that grows with the length. Of spans that are
    equally probable and long, the first stays. An empty table gives no rows.
    """
    if keep is None:
        df, keep, text_col = df.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("__t")), ["doc_id"], "__t"
    rows, accepted = judged_spans(df, text_col, keep)

    def run(batches):
        for batch in batches:
            lists = [resolved(row, accepted, threshold) for row in batch.column("__spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lists, type=ARROW_RESULT)], names=[*batch.schema.names[:-1], "spans"])

    own = rows.select(*(quoted(c) for c in keep), "__spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(released(run), f"{schema}, spans array<struct<start:int,kind:int,end:int,base:boolean>>")


def judged_spans(df: DataFrame, text_col: str, keep: list[str]) -> tuple[DataFrame, dict[tuple[int, int], float]]:
    """keep and __spans of every row, and what the classifier makes of (kind, flags)."""
    small_batches(df.sparkSession)
    rows = shared(found(df, text_col, keep))
    patterns = rows.select(F.explode("__spans").alias("s")).groupBy("s.kind", "s.votes", "s.flags").agg(F.count("*").alias("n")).collect()
    return rows, learnt(patterns)[0]


def redact(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with each detected span of the text replaced by its kind, as in ``[EMAIL]``; a null text stays null.

    Of overlapping spans the one that starts first, or else the longest, gives
    the name. Columns of any other name pass through; an empty table stays one.
    """
    names = df.columns
    own = df.select(F.struct(*(quoted(c) for c in names)).alias("row"), quoted(text_col).alias("text"))
    rows, accepted = judged_spans(own, "text", ["row"])

    def run(batches):
        for batch in batches:
            out = []
            row = batch.column("row")
            for text, found_ in zip(row.field(names.index(text_col)).to_pylist(), batch.column("__spans").to_pylist()):
                if text and found_:
                    parts, at = [], 0
                    for s in sorted(resolved(found_, accepted, threshold), key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at : s["start"]], f"[{KIND_NAMES[s['kind']].upper()}]"]
                        at = max(at, s["end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, type=pa.string()) if n == text_col else row.field(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(released(run), df.schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """One row per document, also of null and empty texts: counts and digest of the base spans, and all spans as text."""
    names = F.array(*(F.lit(n) for n in KIND_NAMES))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int):  # a second parameter of the inner function would be the place in the array
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{KIND_NAMES[kind]}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in range(4)]
    return detect(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
