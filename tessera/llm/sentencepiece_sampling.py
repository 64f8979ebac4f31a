"""Sampled SentencePiece segmentation, and lossless decoding.

Forward-filtering backward-sampling over the piece lattice of a public
vocabulary: the forward pass gives each node of the lattice the total weight
of all paths that reach it, the backward pass draws a path with exactly the
probability of its weight. The draws are a hash of (seed, row key, place), so
a row always gets the same segmentation, wherever it is computed.

The public model gives its pieces ranks and no probabilities, so their weights
are an assumption of ours (Zipf's law): a piece of rank r has the weight
``(r + 3) ** -theta``; a byte piece has that of twice the last rank. A larger
theta prefers fewer, more frequent pieces. No piece of the vocabulary has the
space mark after another character, so the lattice of a text falls apart into
those of its words; words that occur repeatedly share one forward pass.
"""
from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import U64, mix, released, texts, unit

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "mark " + MARK  # has a space, so no word of a text is equal to it
#: Whether a byte begins a character, and of how many bytes; 0xFF, which ends a word, does not.
HEAD = np.array([b & 0xC0 != 0x80 and b != 0xFF for b in range(256)])
WIDTH = np.array([1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) for b in range(256)])
CHUNK = 1 << 20
#: Bytes of text that are segmented at a time, about: the paths of their words take some hundred times as many.
SAMPLED = 1 << 20


def load_pieces(path: str = MODEL) -> list[tuple[bytes, int]]:
    """(bytes, kind) by id; kind 0: control, 1: normal, 2: a single byte.

    Read on the driver and shipped with the closure: its size is that of the
    vocabulary, whatever the data, and executors need no such file.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append((bytes([int(piece[3:5], 16)]), 2))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append((b"", 0))
        else:
            out.append((piece.encode(), 1))
    return out


class Vocabulary:
    """The pieces as a byte trie, with their weights."""

    def __init__(self, pieces: list[tuple[bytes, int]], theta: float):
        normal = [i for i, (_, kind) in enumerate(pieces) if kind == 1]
        mark = MARK.encode()
        normal = [i for i in normal if mark not in pieces[i][0].lstrip(mark) or not pieces[i][0].strip(mark)]
        self.weight = np.full(len(pieces), -theta * np.log(2.0 * len(pieces)))
        self.weight[normal] = -theta * np.log(np.arange(len(normal)) + 3.0)
        self.byte = np.zeros(256, dtype=np.int32)
        for i, (piece, kind) in enumerate(pieces):
            if kind == 2:
                self.byte[piece[0]] = i
        children: list[dict[int, int]] = [{}]
        ends = {}
        for i in normal:
            node = 0
            for b in pieces[i][0]:
                node = children[node].setdefault(b, len(children))
                if node == len(children):
                    children.append({})
            ends[node] = i
        # a double array: the node that byte b leads to from node n is base[n] + b, if its owner is n
        place = placed(children)
        self.base = np.zeros(int(place.max()) + 257, dtype=np.int32)
        self.owner = np.full(len(self.base), -1, dtype=np.int32)
        self.piece = np.full(len(self.base), -1, dtype=np.int32)
        for node, own in enumerate(children):
            if own:
                self.base[place[node]] = place[next(iter(own.values()))] - next(iter(own))
                self.owner[place[list(own.values())]] = place[node]
        self.piece[place[list(ends)]] = list(ends.values())
        self.first = np.zeros(256, dtype=np.int32)  # from the root
        for b, to in children[0].items():
            self.first[b] = place[to]
        plain = [p.replace(mark, b" ") if kind == 1 else p for p, kind in pieces]
        self.length = np.array([len(p) for p in plain], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(plain) or b"\0", dtype=np.uint8)
        self.offset = np.cumsum(self.length) - self.length
        self.span = np.array([len(p) for p, _ in pieces], dtype=np.int64)  # in a marked text
        self.ready()

    def ready(self) -> None:
        """What is made anew where the vocabulary is unpacked."""
        with np.errstate(over="ignore"):  # of pieces that only long words have
            self.factor = np.exp(self.weight + 4.0 * self.span)  # times e**4 a byte: see shares
        self.known = Known()

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes other than the root have a child by these bytes, and the children of those."""
        to = self.base[node] + byte
        found = np.flatnonzero(self.owner[to] == node)
        return found, to[found]

    def packed(self) -> bytes:
        """What ``unpacked`` makes the same vocabulary of: under 1 MB, beyond which Spark writes a closure to a file."""
        return zlib.compress(pickle.dumps({k: v for k, v in vars(self).items() if k not in ("factor", "known")}), 1)


def unpacked(data: bytes) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    vars(out).update(pickle.loads(zlib.decompress(data)))
    out.ready()
    return out


def placed(children: list[dict[int, int]]) -> np.ndarray:
    """The place of each node of a trie in its double array; that of the root is 0, others begin at 256."""
    place = np.zeros(len(children), dtype=np.int64)
    taken = bytearray(256 * len(children) + 512)
    low = many = 256
    for own in sorted(filter(None, children), key=len, reverse=True):
        least = min(own)
        shift = [b - least for b in own]
        if len(own) == 1 < many:
            low = 256  # these fill what the others left
        many = len(own)
        at = taken.index(0, low)
        while any(taken[at + x] for x in shift):
            at = taken.index(0, at + 1)
        low = max(low, at - 64)
        for b, to in own.items():
            place[to] = at + b - least
            taken[at + b - least] = 1
    return place


def pretokens(text: str) -> list[str]:
    """The words whose lattices are apart; joined, they are the marked text."""
    if not text:
        return []
    if MARK in text:
        parts = text.split(MARK)
        out = pretokens(parts[0]) or [MARK]
        for part in parts[1:]:
            out.append(LITERAL)
            if part:
                out.extend(split_marked(part.replace(" ", MARK)))
        return out
    if "  " in text or text[0] == " ":
        return split_marked(MARK + text.replace(" ", MARK))
    return [w for w in (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if w]


def split_marked(marked: str) -> list[str]:
    return re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n", marked)


def lattice(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, ...]:
    """Forward filtering over the lattices of distinct words.

    Returns, of the edges sorted by the node they enter and about by falling
    probability: the node they leave, the piece, the summed probability within
    their node; then each node's first edge, and each word's first and last node.
    """
    raw = [MARK.encode() if w == LITERAL else w.encode() for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    # nodes: one per byte and word, and one at each word's end; there stands a byte that no UTF-8 has
    data = np.frombuffer(b"\xff".join([*raw, b""]), dtype=np.uint8)
    last = np.cumsum(size + 1) - 1
    first = last - size
    heads = np.flatnonzero(HEAD[data])
    at = heads
    if LITERAL in words:
        own = words.index(LITERAL)
        at = heads[(heads < first[own]) | (heads > last[own])]
    covered = np.zeros(len(data), dtype=bool)
    dst, piece = [], []
    length = 1
    node = vocab.first[data[at]]
    alive = np.flatnonzero(node)
    at, node = at[alive], node[alive]
    while len(at):
        got = vocab.piece[node]
        hit = np.flatnonzero(got >= 0)
        got, to = got[hit], at[hit]
        if length <= 4:
            covered[to[WIDTH[data[to]] == length]] = True
        dst.append(to + length)
        piece.append(got)
        alive, node = vocab.step(node, data[at + length])
        at = at[alive]
        length += 1
    # a character that is no piece by itself is spelled in bytes
    lone = heads[~covered[heads]]
    if len(lone):
        width = WIDTH[data[lone]]
        lone = np.concatenate([lone[width > k] + k for k in range(4)])
        dst.append(lone + 1)
        piece.append(vocab.byte[data[lone]])
    none = np.empty(0, dtype=np.int64)
    dst, piece = np.concatenate([none, *dst]), np.concatenate([none.astype(np.int32), *piece])
    src = dst - vocab.span[piece]
    p = shares(vocab, src, dst, piece, first, size)
    rest = np.flatnonzero(p > 0)
    if len(rest) < len(p):
        src, dst, piece, p = src[rest], dst[rest], piece[rest], p[rest]
    order = falling(dst, p)
    src, dst, piece, p = src[order], dst[order], piece[order], p[order]
    into = np.concatenate(([0], np.cumsum(np.bincount(dst, minlength=len(data)))))
    # sums within a node, of its own shares alone: they don't depend on the other words
    upto = p.copy()
    rank = np.arange(len(dst)) - into[dst]
    for k in range(1, int(rank.max(initial=0)) + 1):
        e = np.flatnonzero(rank == k) if k == 1 else e[rank[np.minimum(e + 1, len(rank) - 1)] == k] + 1
        upto[e] += upto[e - 1]
    upto[into[1:][into[1:] > into[:-1]] - 1] = 2.0  # the last edge of a node takes what is left
    return src, piece, upto, into, first, last


def falling(dst: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The order by node and about by falling probability, stable."""
    rank = 255 - (p * 255).astype(np.int64)
    bits = len(dst).bit_length()
    if int(dst.max(initial=0)).bit_length() + 8 + bits > 63:
        return radix(dst, radix(rank))
    # numbers are sorted faster than their places: the place is the lowest part of each
    return np.sort((dst << 8 | rank) << bits | np.arange(len(dst))) & ((1 << bits) - 1)


def radix(key: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The order of key, stable after the given order; by 16 bits at a time."""
    for shift in range(0, max(1, int(key.max(initial=0)).bit_length()), 16):
        digit = (key >> shift).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.empty(0, dtype=np.int64) if order is None else order


#: Words of more bytes are filtered in logarithms.
SHORT = 48


def shares(vocab: Vocabulary, src, dst, piece, first, size) -> np.ndarray:
    """Each edge's share of the weight of all paths to the node that it enters.

    Weights are multiplied by e**4 a byte, which favours no path, since all paths
    to a node have the same bytes: short words then stay within float64.
    """
    alpha = np.zeros(int((first + size).max(initial=0)) + 1)
    alpha[first] = 1.0
    weight = vocab.factor[piece]
    deep = (np.arange(len(alpha)) - np.repeat(first, size + 1))[dst]
    edges = np.empty(0, dtype=np.int64)  # of long words
    if int(size.max(initial=0)) > SHORT:
        long = np.repeat(size > SHORT, size + 1)[dst]
        edges = np.flatnonzero(long)
        deep[edges] = 0
    order = radix(deep)
    counts = np.bincount(deep, minlength=1)
    s, d, w = src[order], dst[order], weight[order]
    hi = len(edges)
    for n in counts[1:].tolist():
        lo, hi = hi, hi + n
        np.add.at(alpha, d[lo:hi], alpha[s[lo:hi]] * w[lo:hi])
    with np.errstate(divide="ignore", invalid="ignore"):
        p = alpha[src] * weight / alpha[dst]
    if len(edges):
        p[edges] = 0.0
        of = np.repeat(np.arange(len(size)), size + 1)[dst]
        edges = edges[np.argsort(dst[edges], kind="stable")]
        logs: dict[int, float] = {}
        enter: dict[int, list[tuple[int, float]]] = {}
        starts = set(first[np.unique(of[edges])].tolist())
        logs.update(dict.fromkeys(starts, 0.0))
        for edge, a, b, x in zip(edges.tolist(), src[edges].tolist(), dst[edges].tolist(), vocab.weight[piece[edges]].tolist()):
            enter.setdefault(b, []).append((edge, a, x))
        for b, found in enter.items():
            found = [(edge, logs[a] + x) for edge, a, x in found if a in logs]
            if found:
                most = max(x for _, x in found)
                logs[b] = most + math.log(math.fsum(math.exp(x - most) for _, x in found))
                for edge, x in found:
                    p[edge] = math.exp(x - logs[b])
    return p


class Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Known:
    """The lattices of the words met last by this worker: of about ``most`` edges, and those of one more text or block of texts."""

    def __init__(self, most: int = 4_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.word = Numbers()
        # by edge: piece, summed probability; by node: the first edge; by word: the first node and the last
        self.held = [np.empty(0, dtype=x) for x in (np.int32, np.float64, np.int32, np.int32, np.int32)]
        self.size = [0, 0, 0]  # of edges, nodes, words

    def get(self, vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices, and the number of each of these words in them."""
        if self.size[0] > self.most:
            self.clear()
        have = len(self.word)
        which = np.fromiter(map(self.word.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.word) > have:
            _, piece, upto, into, first, last = lattice(vocab, list(islice(self.word, have, None)))
            edges, nodes, n = self.size
            new = (piece, upto, into[:-1] + edges, first + nodes, last + nodes)
            for i, (at, x) in enumerate(zip((edges, edges, nodes, n, n), new)):
                if at + len(x) > len(self.held[i]):
                    room = np.empty(max(at + len(x), 2 * len(self.held[i])), dtype=self.held[i].dtype)
                    room[:at] = self.held[i][:at]
                    self.held[i] = room
                self.held[i][at : at + len(x)] = x
            self.size = [edges + len(piece), nodes + len(into) - 1, n + len(first)]
        return *self.held, which


def sample(vocab: Vocabulary, docs: list[list[str]], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling: all ids, and where those of each text begin (and one entry more)."""
    import pandas as pd

    counts = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    flat = [w for d in docs for w in d]
    if not flat:
        return np.empty(0, dtype=np.int32), np.zeros(len(docs) + 1, dtype=np.int64)
    if "\0" in "".join(flat):  # where pandas takes a string to end
        distinct = Numbers()
        which = np.fromiter(map(distinct.__getitem__, flat), dtype=np.int64, count=len(flat))
    else:
        which, distinct = pd.factorize(np.array(flat, dtype=object))
    piece, upto, into, first, last, ids = vocab.known.get(vocab, list(distinct))
    which = ids[which]
    begin = np.cumsum(counts) - counts
    place = np.arange(len(flat)) - np.repeat(begin, counts)
    stream = mix(np.repeat(keys, counts) + mix(place.astype(U64) + U64(1)))
    at, goal = last[which], first[which]
    live = np.arange(len(flat))
    taken = np.empty(len(flat), dtype=np.int64)
    steps, drawn = [], []
    t = 0
    while len(live):
        u = unit(mix(stream + U64((0x9E3779B97F4A7C15 * (t + 1)) & (2**64 - 1))))
        edge = into[at]
        late = np.flatnonzero(u > upto[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] > upto[edge[late]]]
        steps.append(live)
        drawn.append(piece[edge])
        at = at - vocab.span[drawn[-1]]
        t += 1
        taken[live[at <= goal]] = t
        more = np.flatnonzero(at > goal)
        live, at, goal, stream = live[more], at[more], goal[more], stream[more]
    end = np.cumsum(taken)
    ids = np.empty(int(end[-1]), dtype=np.int32)
    for t, (s, d) in enumerate(zip(steps, drawn)):
        ids[end[s] - 1 - t] = d
    offsets = np.concatenate(([0], end))[np.concatenate((begin, [len(flat)]))]
    return ids, offsets


def decoded(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bytes of each text, without the mark put before it."""
    size = vocab.length[ids]
    end = np.cumsum(size)
    data = vocab.bytes[np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size - vocab.offset[ids], size)].tobytes()
    cut = np.concatenate(([0], end))[offsets]
    return [data[a + 1 : b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def chunks(items: list, limit: int = CHUNK, size: Callable = len) -> Iterator[slice]:
    """Slices of items that are of ``limit`` in all at most, or one item."""
    at, total = 0, 0
    for i, x in enumerate(items):
        if total and total + size(x) > limit:
            yield slice(at, i)
            at, total = i, 0
        total += size(x)
    if at < len(items):
        yield slice(at, len(items))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, lossless, ids) of every row.

    ids is the sampled segmentation, the empty array for an empty or null text.
    lossless says whether decoding ids gave back the whole text. The draws
    depend on (seed, id) alone: repeated rows get equal ids; a null id counts
    as 0. Texts of any length, and words of any length, are segmented whole.
    An empty table gives no rows; columns other than the two named are not
    read.
    """
    data = Vocabulary(load_pieces(model), theta).packed()

    def run(batches):
        vocab = unpacked(data)
        for batch in batches:
            items = batch.column("text").to_pylist()
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            keys = mix(keys + U64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
            for part in chunks(items, SAMPLED):
                ids, offsets = sample(vocab, [pretokens(x) for x in items[part]], keys[part])
                same = [a == b.encode() for a, b in zip(decoded(vocab, ids, offsets), items[part])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(np.diff(offsets)), pa.array(same), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "n_pieces", "lossless", "ids"],
                )

    return texts(df, id_col, text_col).mapInArrow(released(run), "doc_id long, n_pieces long, lossless boolean, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of ids; null or empty ids give the empty text."""
    from pyspark.sql import functions as F

    from .common import quoted

    data = Vocabulary(load_pieces(model), 1.0).packed()

    def run(batches):
        vocab = unpacked(data)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            out = decoded(vocab, flat, np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode() for x in out], type=pa.string())], names=["doc_id", "text"])

    return df.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(released(run), "doc_id long, text string")
