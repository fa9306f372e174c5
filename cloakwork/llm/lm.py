"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside a word model with add-one counts.

The attention decides, from the subwords before a place, how to mix distributions over the next subword: `EXPERTS` of them are
what follows one class of subwords anywhere in the training texts, one is what follows the last subword itself. A word's score
mixes the product over its subwords (and over its bytes, if it is no frequent word) with its share among all words. Long texts are scored in overlapping windows:
a block of BLOCK places sees itself, causally, and the block before, so that each place is scored once.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, mix, staged, sums, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = b"\n"  # no word holds white space
WORD_SHARE = 0.5  # of a known word's probability that comes from the counts of whole words
CACHED = 1 << 16  # words whose subwords a task keeps; the others are spelled again in each block of texts
TEXT_BYTES = 2 << 20  # of the texts that a task holds at once; a longer text is held alone
DIM, EXPERTS, BLOCK, SKETCH = 8, 16, 8, 64
GATES = EXPERTS + 1  # the last one is for the followers of a place's own subword
FREQUENT, DISCOUNT = 2048, 0.75  # subwords whose pairs are counted, and what is taken from each count
WINDOW = 2 * BLOCK
SHAPES = {"q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "far": (WINDOW,), "c": (DIM, GATES), "e": (DIM, GATES), "own": (EXPERTS, GATES), "b": (GATES,)}


def octets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words in a row, where each word begins and the last one ends)."""
    whole = words.cast(pa.large_binary())
    to = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2] or b"", np.uint8)[to[0] : to[-1]], to - to[0]


class Words:
    """The tokens of a block of texts: distinct ones, the number of each token in a row, and how many each text has, its end included."""

    def __init__(self, texts: list[bytes | None]) -> None:
        data = pa.array([t or b"" for t in texts], pa.large_binary())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.LargeStringArray.from_buffers(len(data), *data.buffers()[1:])))
        flat = lists.flatten()
        some = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(some).dictionary_encode()
        n = np.diff(np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()])
        own = coded.dictionary
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), own.buffers(), offset=own.offset)
        self.distinct = pa.concat_arrays([own, pa.array([END], pa.large_binary())])
        self.at = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(n), len(own))
        self.n = n + 1


class Subwords:
    """Spells words in subwords of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values(), default=-1) + 1
        self.heads = np.zeros(self.end + 1, bool)  # subwords that begin a word
        self.heads[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        # words that came twice in a block before, and their subwords in a row
        self.met, self.pool, self.starts = pa.array([], pa.large_binary()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(subwords of all words in a row, where each word's begin and the last one's end)."""
        if not len(words):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        # the pattern always cuts before a blank that a word follows, and no word holds one, so many words are spelled as one text
        data, to = octets(words)
        pool = self.encoding.encode_to_numpy(np.insert(data, to[:-1], ord(" ")).tobytes().decode("utf-8", "replace"), disallowed_special=()).astype(np.int32)
        starts = np.append(np.flatnonzero(self.heads[pool]), len(pool))
        if len(starts) != len(words) + 1:
            raise ValueError("the vocabulary does not spell words one by one")
        return pool, starts

    def spell(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, pieces): the subwords of all texts in a row, how many each token has and how many each text."""
        known = words.distinct.slice(0, len(words.distinct) - 1)
        at = pc.fill_null(pc.index_in(known, value_set=self.met), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = known.take(pa.array(new))
        own, cuts = self._fresh(fresh)
        pool = np.concatenate([self.pool, own, np.array([self.end], np.int32)])
        first, many = np.full(len(known) + 1, len(pool) - 1), np.ones(len(known) + 1, np.int64)
        old = np.flatnonzero(at >= 0)
        first[old], many[old] = self.starts[at[old]], np.diff(self.starts)[at[old]]
        first[new], many[new] = len(self.pool) + cuts[:-1], np.diff(cuts)
        if len(self.met) < CACHED:
            again = np.flatnonzero((np.bincount(words.at, minlength=len(first))[new] > 1) & (many[new] <= 16))[: CACHED - len(self.met)]
            size = many[new][again]
            to = np.cumsum(size)
            more = own[np.repeat(cuts[again] - to + size, size) + np.arange(size.sum())]
            self.met, self.pool, self.starts = pa.concat_arrays([self.met, fresh.take(pa.array(again))]), np.append(self.pool, more), np.append(self.starts, self.starts[-1] + to)
        size = many[words.at]
        to = np.cumsum(size)
        return pool[np.repeat(first[words.at] - to + size, size) + np.arange(to[-1] if len(to) else 0)], size, sums(size, words.n)


_subwords: dict[int, Subwords] = {}


def subwords(ranks) -> Subwords:
    key = len(ranks.value)
    return _subwords.get(key) or _subwords.setdefault(key, Subwords(ranks.value))


def _spelled(ranks, kind: str):
    """The subword ids of each whole text, begun and ended by an end sign, and how often each word stands in a block of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), words, pa.array(n, pa.int64())], names=["ids", "word", "n"])

        for _, texts in blocks(batches, TEXT_BYTES):
            sub, words = subwords(ranks), Words(texts)
            ids, _, pieces = sub.spell(words)
            to = np.cumsum(pieces)
            x = np.insert(ids, to - pieces, sub.end).astype(kind)
            ends = to + np.arange(1, len(texts) + 1)
            yield rows([x[a:b].tobytes() for a, b in zip(ends - pieces - 1, ends, strict=True)], pa.nulls(len(texts), pa.binary()), np.zeros(len(texts), np.int64))
            yield rows([None] * len(words.distinct), words.distinct.cast(pa.binary()), np.bincount(words.at, minlength=len(words.distinct)))

    return run


def _texts(batches: Iterable[pa.RecordBatch], kind: str, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of texts in a row, how many each has), some `limit` ids at a time."""
    parts: list[bytes] = []
    size = 0
    width = np.dtype(kind).itemsize

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), kind).astype(np.int32), np.fromiter(map(len, parts), np.int64) // width

    for batch in batches:
        for part in batch.column(0).to_pylist():
            parts.append(part)
            size += len(part) // width
            if size >= limit:
                yield joined()
                parts, size = [], 0
    if parts:
        yield joined()


def windows(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of WINDOW + 1 ids over each whole text; each begins with the last of the one before, so that every id after a
    text's first is a target once. -1 fills up a text's last row."""
    rows = -(-(n - 1) // WINDOW)
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), rows)
    first = starts[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows))
    spot = first[:, None] + np.arange(WINDOW + 1, dtype=np.int64)[None, :]
    return np.where(spot < (starts + n)[owner, None], x[np.minimum(spot, len(x) - 1)], -1)


def _sketch(size: int, kind: str):
    """How often each subword stands beside subwords of a hash bucket: one half of the buckets for the left, one for the right."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * SKETCH, np.int64)
        bucket = (mix(np.arange(1, size + 1, dtype=np.uint64)) % np.uint64(SKETCH // 2)).astype(np.int64)
        for x, _ in _texts(batches, kind):
            # the end of a text stands before the next one's end sign, a pair that counts for nothing
            a, b = x[:-1].astype(np.int64), x[1:].astype(np.int64)
            live = (a != size - 1) | (b != size - 1)
            a, b = a[live], b[live]
            np.add.at(total, b * SKETCH + bucket[a], 1)
            np.add.at(total, a * SKETCH + SKETCH // 2 + bucket[b], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


class Followers:
    """What follows each of the most frequent subwords, among them: discounted counts, and for the rest how often each subword stands anywhere."""

    def __init__(self, frequent: np.ndarray, context: np.ndarray, whole: np.ndarray, n: np.ndarray) -> None:
        """frequent: their ids; context: how often each subword is followed by any; whole: the share of each; n: counts of pairs, by rank."""
        self.rank = np.full(len(context), len(frequent), np.int32)  # those behind the last one have no counts
        self.rank[frequent] = np.arange(len(frequent))
        self.n = np.zeros((len(frequent) + 1, len(frequent) + 1), np.int32)
        self.n[:-1, :-1] = n
        used = np.maximum(n - DISCOUNT, 0).sum(axis=1)
        self.context, self.whole = context.astype(np.float64), whole.astype(np.float64)
        self.used = np.append(used, 0.0)[self.rank]

    def share(self, x: np.ndarray, y: np.ndarray, less: int = 0) -> np.ndarray:
        """The probability of each of `y` after `x`; with `less` 1, as if this very pair had not been counted."""
        n = self.n[self.rank[x], self.rank[y]].astype(np.float64)
        left = np.maximum(n - less - DISCOUNT, 0)
        used = self.used[x] - np.maximum(n - DISCOUNT, 0) + left
        total = np.maximum(self.context[x] - less, 1)
        return left / total + np.maximum(1 - used / total, 1e-6) * self.whole[y]


class Table:
    """The same for one `less`, ready for use: one look-up a pair."""

    def __init__(self, f: Followers, less: int = 0) -> None:
        total, last = np.maximum(f.context - less, 1), len(f.n) - 1
        self.less, self.whole, self.rest = less, f.whole.astype(np.float32), np.maximum(1 - f.used / total, 1e-6).astype(np.float32)
        self.row, self.rank = f.rank.astype(np.int64) * (last + 1), f.rank.astype(np.int64)
        frequent = np.flatnonzero(f.rank < last)
        frequent = frequent[np.argsort(f.rank[frequent])]
        n, of, used = f.n[:-1, :-1], total[frequent][:, None], f.used[frequent][:, None]
        held = np.maximum(n - less - DISCOUNT, 0)
        if less:  # what the pair's own count would have left to the rest
            lost = np.maximum(n - DISCOUNT, 0) - held
            held /= of
            held += (np.maximum(1 - (used - lost) / of, 1e-6) - np.maximum(1 - used / of, 1e-6)) * f.whole[frequent]
        else:
            held /= of
        self.held = np.zeros(f.n.shape, np.float32)
        self.held[:-1, :-1] = held

    def share(self, x: np.ndarray, y: np.ndarray, less: int = 0) -> np.ndarray:
        if less != self.less:
            raise ValueError(f"this table leaves out {self.less} of each pair, not {less}")
        out = self.rest.take(x)
        out *= self.whole.take(y)
        out += self.held.ravel().take(self.row.take(x) + self.rank.take(y))
        return out


def _pairs(size: int, kind: str, shared):
    """How often each subword follows each class of subwords and, behind these slots, each frequent subword another one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, frequent = shared.value
        total, many = np.zeros(EXPERTS * size + len(frequent) ** 2, np.int64), len(frequent)
        base, rank = classes.astype(np.int64) * size, np.full(size, -1, np.int64)
        rank[frequent] = np.arange(many)
        for x, _ in _texts(batches, kind):
            live = (x[:-1] != size - 1) | (x[1:] != size - 1)
            a, b = x[:-1][live], x[1:][live]
            np.add.at(total, base[a] + b, 1)
            a, b = rank[a], rank[b]
            some = (a >= 0) & (b >= 0)
            np.add.at(total, EXPERTS * size + a[some] * many + b[some], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


def embed(sketch: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, class) of each subword: the main directions of its neighbours' histogram, and k-means classes of them."""
    n = sketch.sum(axis=1)
    rows = np.sqrt(sketch / np.maximum(n, 1)[:, None])
    mean = (rows * n[:, None]).sum(axis=0) / max(n.sum(), 1)
    rows = np.where(n[:, None] > 0, rows - mean, 0.0)
    _, basis = np.linalg.eigh((rows * np.sqrt(n)[:, None]).T @ (rows * np.sqrt(n)[:, None]))
    vectors = rows @ basis[:, -DIM:]
    vectors *= np.sqrt(n / (n + 5.0))[:, None]  # a rare subword's histogram says little
    vectors /= max(np.sqrt((vectors**2 * n[:, None]).sum() / max(n.sum(), 1) / DIM), 1e-9)
    vectors = np.clip(vectors, -4, 4)
    centres = vectors[np.argsort(-n, kind="stable")[:: max(1, min(len(n), 40 * EXPERTS) // EXPERTS)][:EXPERTS]]
    centres = np.concatenate([centres, np.zeros((EXPERTS - len(centres), DIM))])
    for _ in range(12):
        own = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        weight = np.bincount(own, n, minlength=EXPERTS)
        for d in range(DIM):
            centres[:, d] = np.where(weight > 0, np.bincount(own, n * vectors[:, d], minlength=EXPERTS) / np.maximum(weight, 1e-9), centres[:, d])
    return vectors.astype(np.float32), own


def begin() -> dict[str, np.ndarray]:
    """Weights to start from: each place trusts its own subword's followers, then the expert of its class."""
    rng = np.random.default_rng(0)
    out = {k: rng.normal(0, 0.3, s) if len(s) == 2 else np.zeros(s) for k, s in SHAPES.items()}
    out["own"] = 3.0 * np.eye(EXPERTS, GATES)
    out["b"][-1] = 4.0
    out["c"] *= 0.3
    out["e"] *= 0.3
    return out


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


CUTS = np.cumsum([0, *(math.prod(s) for s in SHAPES.values())]).tolist()


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    return {k: x[a:b].reshape(s) for (k, s), a, b in zip(SHAPES.items(), CUTS, CUTS[1:], strict=False)}


def features(vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What a place's own subword says, a row a subword: its vector, which class it is of, 1, and room for what the place attends to."""
    size, kind = len(vectors), vectors.dtype
    return np.concatenate([vectors, np.eye(EXPERTS, dtype=kind)[own], np.ones((size, 1), kind), np.zeros((size, DIM), kind)], axis=1)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, about: np.ndarray, experts: np.ndarray, followers: Followers | Table) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the next subwords `y` (-1: none) after `x`, both windows x places, and its gradients, as exact as the
    type of the weights and of `about`, the `features` of all subwords. Each pair is left out of its own followers' counts.

    Attention is linear in the vectors `e` on both sides, so it takes means of these, and weights meet in products: e q (e k)' is
    e (q k') e', and what is seen, (a e) v c, is (a e) (v c). Gradients of q and k, and of v and c, come from those of the products."""
    kind = w["q"].dtype
    live = (y >= 0).astype(kind).ravel()
    rows, n = x.shape
    x, y = np.maximum(x, 0).ravel().astype(np.intp), np.maximum(y, 0).ravel().astype(np.intp)
    f = about.take(x, axis=0)
    flat_e = np.ascontiguousarray(f[:, :DIM])
    e = flat_e.reshape(rows, n, DIM)
    far = np.arange(n)[:, None] - np.arange(n)[None, :]
    later = np.where(far >= 0, np.clip(w["far"], -20, 20)[np.maximum(far, 0)], kind.type(-1e9))
    scale = kind.type(DIM**-0.5)
    ones, wide = np.ones(n, kind), np.ones(GATES, kind)
    a = (flat_e @ (w["q"] @ w["k"].T * scale)).reshape(rows, n, DIM) @ e.transpose(0, 2, 1)
    np.clip(a, -60, 60, out=a)  # in place of each row's maximum: no sum of exponentials, nor its inverse, leaves the range of its type
    a += later
    np.exp(a, out=a)
    part_of = (1 / (a.reshape(-1, n) @ ones))[:, None]  # what turns a place's row into shares
    seen = f[:, -DIM:]
    np.multiply((a @ e).reshape(-1, DIM), part_of, out=seen)
    through = w["v"] @ w["c"]
    g = f @ np.concatenate([w["e"], w["own"], w["b"][None, :], through])
    np.clip(g, -60, 60, out=g)
    np.exp(g, out=g)
    g /= (g @ wide)[:, None]
    part = np.empty((rows * n, GATES), kind)
    part[:, :EXPERTS] = experts.take(y, axis=0)
    part[:, EXPERTS] = followers.share(x, y, 1)
    part *= g
    p = part @ wide
    total = max(float(live.sum()), 1.0)
    part /= p[:, None]
    dz = g
    dz -= part
    dz *= (live / kind.type(total))[:, None]
    own = f.T @ dz
    out = {"c": w["v"].T @ own[-DIM:], "v": own[-DIM:] @ w["c"].T, "e": own[:DIM], "own": own[DIM : DIM + EXPERTS], "b": own[DIM + EXPERTS]}
    d = dz @ through.T
    d *= part_of
    ds = d.reshape(rows, n, DIM) @ e.transpose(0, 2, 1)
    # the sum of a * da over a place's row is the dot of what it sees and its gradient
    d *= seen
    ds -= (d @ np.ones(DIM, kind)).reshape(rows, n, 1)
    ds *= a
    out["far"] = np.bincount(np.maximum(far, 0).ravel(), np.where(far >= 0, (np.ones(rows, kind) @ ds.reshape(rows, -1)).reshape(n, n), 0).ravel(), minlength=WINDOW)
    met = flat_e.T @ (ds @ e).reshape(-1, DIM) * scale
    out["q"], out["k"] = met @ w["k"], met.T @ w["q"]
    return float(-(np.log(p) * live).sum() / total), out


def _learn(model, rate: float, kind: str, batch_rows: int = 256):
    """One pass of Adam over all windows of a partition's texts, shuffled in blocks; gives its weights, each times the number of windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vectors, own, experts, followers = model.value
        about, experts = features(vectors.astype(np.float32), own), experts.astype(np.float32)
        x, m, v, t, rows = weights.copy(), np.zeros_like(weights), np.zeros_like(weights), 0, 0
        order = np.random.default_rng(0)
        for ids, n in _texts(batches, kind):
            every = windows(ids, n)
            every = every[order.permutation(len(every))]
            for k in range(0, len(every), batch_rows):
                some = every[k : k + batch_rows]
                g = flat(gradients(shaped(x.astype(np.float32)), some[:, :-1], some[:, 1:], about, experts, followers)[1]).astype(np.float64)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                rows += len(some)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * rows), pa.array(np.full(len(x), rows))], names=["place", "v", "n"])

    return run


class Model:
    """What scoring needs: tables by subword, so that a place costs a few look-ups and its attention."""

    def __init__(self, weights: np.ndarray, vectors: np.ndarray, own: np.ndarray, experts: np.ndarray, followers: Followers) -> None:
        w = shaped(weights)
        f = np.float32
        self.table = Table(followers)
        self.q, self.k, self.v = ((vectors @ w[n] * (DIM**-0.5 if n == "q" else 1)).astype(f) for n in "qkv")
        # no attention score leaves the range of exp, so that none needs its row's maximum
        self.q, self.k = (x * np.minimum(1, 6 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(f) for x in (self.q, self.k))
        gate = vectors @ w["e"] + w["own"][own] + w["b"]
        self.gate = np.clip(gate - gate.mean(axis=1, keepdims=True), -30, 30).astype(f)
        self.c = w["c"].astype(f)
        self.targets = np.concatenate([experts, followers.whole[:, None]], axis=1).astype(f)
        far = BLOCK + np.arange(BLOCK)[:, None] - np.arange(WINDOW)[None, :]
        self.far = np.where(far >= 0, np.clip(w["far"], -20, 20)[np.clip(far, 0, WINDOW - 1)], -1e9).astype(f)

    @property
    def experts(self) -> np.ndarray:
        return self.targets[:, :EXPERTS]

    def logs(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 of each subword's probability. `x`: the subwords of all texts, each begun by the end sign; `n`: how many
        each text has with it. The first of a text is context only, so a text gives n - 1 numbers, in a row."""
        cells = -(-(n - 1) // BLOCK)
        starts = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), cells)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        first = starts[owner] + number * BLOCK
        left = (starts + n - 1)[owner] - first  # places of the block and after it
        place = np.arange(BLOCK)[None, :]
        ones, wide = np.ones(WINDOW, np.float32), np.ones(GATES, np.float32)
        out = []
        x = x.astype(np.intp)
        for a in range(0, len(owner), 512):
            b = min(a + 512, len(owner))
            here = x.take(np.minimum(first[max(a - 1, 0) : b, None] + place, len(x) - 1))
            if not a:
                here = np.concatenate([here[:1], here])
            # places of a block and the one before it stand in a row
            k, v = (np.lib.stride_tricks.as_strided(t, (b - a, WINDOW, DIM), (BLOCK * DIM * 4, DIM * 4, 4), writeable=False) for t in (self.k.take(here, axis=0), self.v.take(here, axis=0)))
            here = here[1:]
            score = self.q.take(here, axis=0) @ k.transpose(0, 2, 1)
            score += self.far
            score[number[a:b] == 0, :, :BLOCK] = -1e9  # a text's first block has none before it
            np.exp(score, out=score)
            context = score @ v
            context /= (score.reshape(-1, WINDOW) @ ones).reshape(b - a, BLOCK, 1)
            z = context.reshape(-1, DIM) @ self.c
            z += self.gate.take(here.ravel(), axis=0)
            np.exp(z, out=z)
            whole = z @ wide
            target = x.take(np.minimum(first[a:b, None] + place + 1, len(x) - 1))
            part = self.targets.take(target.ravel(), axis=0)
            part[:, EXPERTS] = self.table.share(here.ravel(), target.ravel())
            z *= part
            out.append(np.log10((z @ wide) / whole)[(place < left[a:b, None]).ravel()])
        return np.concatenate(out) if out else np.empty(0, np.float32)


LETTERS = 257  # bytes, and what stands at both ends of a word


def _byte_pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, starts): the pairs of bytes of all words in a row, both ends included, and where each word's begin."""
    data, to = octets(words)
    codes = np.insert(data.astype(np.int64), to[1:], LETTERS - 1)
    return np.r_[LETTERS - 1, codes[:-1]] * LETTERS + codes, to[:-1] + np.arange(len(words))


def _letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows another in distinct words."""
    total = np.zeros(LETTERS**2, np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(_byte_pairs(batch.column(0))[0], minlength=LETTERS**2)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def _score(ranks, model, frequent):
    """Scores of each text by both models; words outside `frequent` are given out with their subwords' log10, for a join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, logs, letters), m = frequent.value, model.value
        tag = int.from_bytes(os.urandom(7), "little")
        for keys, texts in blocks(batches, TEXT_BYTES):
            words = Words(texts)
            found = pc.fill_null(pc.index_in(words.distinct, value_set=often), len(often)).to_numpy()
            value = logs[found][words.at]  # the last is that of a word that isn't there
            rare = value > 0
            known = sums((~rare).astype(np.int64), words.n)
            ids, sizes, pieces = subwords(ranks).spell(words)
            x = np.insert(ids, np.cumsum(pieces) - pieces, subwords(ranks).end)
            by_piece = m.logs(x, pieces + 1).astype(np.float64)
            spelled = np.add.reduceat(by_piece, np.cumsum(sizes) - sizes) if len(sizes) else by_piece
            mixed = value + np.log10(WORD_SHARE + (1 - WORD_SHARE) * 10.0 ** np.minimum(spelled - value, 300))
            base, score = sums(np.where(rare, 0.0, value), words.n), sums(np.where(rare, 0.0, mixed), words.n)
            cuts = pa.array(np.r_[0, np.cumsum(words.n - known)].astype(np.int32))
            odd = words.distinct.take(pa.array(words.at[rare])).cast(pa.binary())
            own = spelled[rare]
            if letters is not None and len(own):  # a word outside the table may be a number or a hash, which its bytes tell better
                new = np.flatnonzero(found == len(often))
                slots, starts = _byte_pairs(words.distinct.take(pa.array(new)))
                by_byte = np.zeros(len(found))
                by_byte[new] = np.add.reduceat(letters[slots], starts)
                other = by_byte[words.at[rare]]
                own = np.maximum(own, other) + np.log10(0.5 + 0.5 * 10.0 ** -np.abs(own - other))
            tags = [(tag + i) & (2**62 - 1) for i in range(len(texts))]
            tag += len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tags), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(words.n), pa.array(known), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(cuts, odd), pa.ListArray.from_arrays(cuts, pa.array(own)),
                ],
                names=["tag", "id", "held_out", "n_tokens", "known", "base", "score", "words", "spelled"],
            )

    return run


SCORED = "tag long, id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, spelled array<double>"


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_frequent: int = 100_000, passes: int = 1, rate: float = 0.03) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs`; rows where `held` is true are
    not learned from.

    The training texts are spelled once, whole, into a table of subword ids in the shared folder, beside the word counts. The
    neighbour sketch, the counts of classes and pairs and the attention learn from all of it: each partition runs Adam over all windows of
    its texts and the weights are averaged, `passes` times. The driver holds tables bounded by the vocabulary alone. Words
    at or above a count that at most `max_frequent` words reach are broadcast; the others meet their counts in a join.

    A null or empty text is its end alone; a very long one is spelled and scored in windows like any other; every row gives
    one row, repeated ones and those with a null id too; equal texts have equal scores; other columns, whatever their names,
    are left alone; without training texts every subword is as likely; an empty table gives an empty one."""
    spark = docs.sparkSession
    context = spark.sparkContext
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        table_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    ranks, size = context.broadcast(table_of), max(table_of.values(), default=-1) + 2
    kind = "uint16" if size <= 1 << 16 else "int32"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    spelled = staged(rows.where("not held").select("id", "text").mapInArrow(_spelled(ranks, kind), "ids binary, word binary, n long"))
    texts = spelled.where("ids is not null").select("ids")
    near = texts.mapInArrow(_sketch(size, kind), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(size * SKETCH)
    sketch[near.column("slot").to_numpy()] = near.column("n").to_numpy()
    vectors, own = embed(sketch.reshape(size, SKETCH))
    frequent = np.argsort(-sketch.reshape(size, SKETCH).sum(axis=1), kind="stable")[:FREQUENT]
    pairs = texts.mapInArrow(_pairs(size, kind, context.broadcast((own, frequent))), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    follow = np.zeros(EXPERTS * size + len(frequent) ** 2)
    follow[pairs.column("slot").to_numpy()] = pairs.column("n").to_numpy()
    follow, counts = follow[: EXPERTS * size].reshape(EXPERTS, size), follow[EXPERTS * size :].reshape(len(frequent), -1)
    whole = (follow.sum(axis=0) + 0.01) / (follow.sum() + 0.01 * size)
    experts = ((follow + 200 * whole) / (follow.sum(axis=1, keepdims=True) + 200)).T.copy()
    followed = sketch.reshape(size, SKETCH)[:, SKETCH // 2 :].sum(axis=1)  # what stands to the right of each
    followers = Followers(frequent, followed, whole, counts)
    weights = flat(begin())
    for turn in range(passes):
        shared = context.broadcast((weights, vectors, own, experts, Table(followers, 1)))
        mean = texts.mapInArrow(_learn(shared, rate / (1 + 2 * turn), kind), "place int, v double, n long").groupBy("place").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if mean.num_rows:
            weights = weights.copy()
            weights[mean.column("place").to_numpy()] = mean.column("v").to_numpy()
    words = staged(spelled.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, denominator = total[0], total[0] + total[1] + 1
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    least, room = None, max_frequent
    for k, many in words.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect():
        if many > room:
            break
        least, room = k, room - many
    most = words.where(F.col("n") >= least).toArrow() if least else None
    often = most.column("word").cast(pa.large_binary()).combine_chunks() if most else pa.array([], pa.large_binary())
    logs = np.r_[np.log10((most.column("n").to_numpy() + 1) / denominator) if most else [], 1.0]
    letters = None
    if total[1]:
        met = words.select("word").mapInArrow(_letters, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        letters = np.zeros(LETTERS**2)
        letters[met.column("slot").to_numpy()] = met.column("n").to_numpy()
        letters = letters.reshape(LETTERS, LETTERS) + 0.1
        letters = np.log10(letters / letters.sum(axis=1, keepdims=True)).ravel()
    model = context.broadcast(Model(weights, vectors, own, experts, followers))
    scored = staged(rows.select("id", "text", "held").mapInArrow(_score(ranks, model, context.broadcast((often, logs, letters))), SCORED))
    odd = scored.select("tag", F.explode(F.arrays_zip("words", "spelled")).alias("w")).select("tag", F.col("w.words").alias("word"), F.col("w.spelled").alias("spelled"))
    fewer = words.where(F.col("n") < least) if least else words
    share = (F.coalesce("n", F.lit(0)) + 1) / F.lit(denominator)
    # all new words have one share of the counts between them, which their subwords deal out
    mixed = F.when(F.col("n") > 0, F.log10(WORD_SHARE * share + (1 - WORD_SHARE) * F.pow(F.lit(10.0), "spelled"))).otherwise(F.col("spelled") + F.log10(WORD_SHARE * share + (1 - WORD_SHARE)))
    found = odd.join(fewer, "word", "left").groupBy("tag").agg(F.sum(F.log10(share)).alias("more"), F.sum(mixed).alias("more_score"), F.count_if(F.col("n") > 0).alias("more_known"))
    return scored.drop("words", "spelled").join(found, "tag", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' log10 probabilities of the whole documents table; a seventh is held out."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).withColumnRenamed("id", "doc_id")
