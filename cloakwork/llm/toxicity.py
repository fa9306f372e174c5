"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary texts, compared by length-normalised likelihoods.

Each class has discounted counts of words and of pairs of words. What the discount takes away goes, for pairs, to the class's
words and, for words, to counts that both classes share: in how many contexts a word stands, whoever wrote it. A rare
expression so counts about alike in both classes and says little.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, sums, table
from .divergence import TERMS
from .lm import Words

PER_CLASS = 8000  # labelled rows of each class that are learned from, the least by a hash of their id
LEAST_DOCS, LEAST_SHARE = 5, 0.001  # of the texts learned from hold a word or pair, or it is rare
MAX_EXPRESSIONS = 1 << 18  # words, and as many pairs, most frequent first
DISCOUNT, SHARED, PASSAGE = 0.75, 0.5, 2
BINS, WIDTH = 2048, 0.01  # of log ratios from -BINS/2 * WIDTH upwards, for the calibration
FOLDS = 4  # of the texts learned from; each is compared by a model of the others
COUNTS = [f"n{fold}{label}" for fold in range(FOLDS) for label in (0, 1)]


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words, number of each word in a row, how many each text has): letters, A-Z as a-z."""
    words = Words([(t or b"").translate(TERMS) for t in texts])
    n = words.n - 1  # without the end
    inner = np.delete(words.at, np.cumsum(words.n) - 1)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.distinct.to_pylist()[:-1]), np.uint64, len(words.distinct) - 1).view(np.int64), inner, n


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by fold and label of each word (prev null) and pair of words of a block of texts, and how many texts hold it."""
    for keys, texts in blocks(batches):
        hashes, at, n = tokens(texts)
        if not len(at):
            continue
        group = np.array([2 * fold + label for label, fold in keys], np.int64)
        owner, size = np.repeat(np.arange(len(n)), n), len(hashes)
        pairs = owner[1:] == owner[:-1]
        for prev, code, of in ((False, at, owner), (True, (at[:-1] * size + at[1:])[pairs], owner[1:][pairs])):
            found, inverse = np.unique(code, return_inverse=True)
            counts = np.bincount(inverse * len(COUNTS) + group[of], minlength=len(COUNTS) * len(found)).reshape(-1, len(COUNTS))
            texts_of = np.bincount(np.unique(inverse * len(n) + of) // len(n), minlength=len(found))
            first = pa.array(hashes[found // size]) if prev else pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([first, pa.array(hashes[found % size]), *(pa.array(c) for c in counts.T), pa.array(texts_of)], names=["prev", "word", *COUNTS, "texts"])


class Model:
    """Log ratios of toxic over ordinary: of each kept word, of what its context leaves to the words, and of each kept pair."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray, n: np.ndarray, pairs: np.ndarray, m: np.ndarray, discount: float = DISCOUNT) -> None:
        """words: sorted hashes; contexts: in how many each stands; n, m: counts by label of the words and of the `pairs` (their places in `words`)."""
        self.words, shared = words, (contexts + 1) / max(1, (contexts + 1).sum())
        total = np.maximum(n.sum(axis=0), 1)
        left = np.maximum(n - discount, 0)
        p = (left + (total - left.sum(axis=0)) * shared[:, None]) / total
        used = np.maximum(m - discount, 0)
        of = np.maximum(n[pairs[:, 0]], 1)
        rest = np.ones(n.shape)
        np.subtract.at(rest, pairs[:, 0], used / of)
        rest = np.maximum(rest, 1e-6)
        pooled = (m.sum(axis=1) / np.maximum(n[pairs[:, 0]].sum(axis=1), 1))[:, None]
        both = used / of + rest[pairs[:, 0]] * ((1 - SHARED) * p[pairs[:, 1]] + SHARED * pooled)
        ratio = lambda x: np.log(x[:, 1] / x[:, 0]) if len(x) else np.zeros(0)
        code = pairs[:, 0] * max(1, len(words)) + pairs[:, 1]
        order = np.argsort(code)
        self.word, self.context, self.code, self.pair = ratio(p), ratio(rest), code[order], ratio(both)[order]

    def ratios(self, texts: list[bytes | None], passage: int = PASSAGE) -> np.ndarray:
        """Log of the mean, over all passages of so many words of a text, of the passage's likelihood ratio; 0 without words.

        That is the likelihood ratio of texts in which one passage, anywhere, is toxic: length takes no side."""
        hashes, at, n = tokens(texts)
        if not len(self.words) or not len(at):
            return np.zeros(len(texts))
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        place = np.where(self.words[spot] == hashes, spot, -1)[at]
        before = np.r_[-1, place[:-1]]
        starts = np.cumsum(n) - n
        before[starts[n > 0]] = -1
        r = np.where(place >= 0, self.word[place], 0.0)
        live = (place >= 0) & (before >= 0)
        r[live] += self.context[before[live]]
        if len(self.code):
            code = before[live] * len(self.words) + place[live]
            near = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            same = self.code[near] == code
            r[np.flatnonzero(live)[same]] = self.pair[near[same]]
        within = np.arange(len(r)) - np.repeat(starts, n)
        total = np.r_[0.0, np.cumsum(r)]
        size = np.minimum(within + 1, passage)  # a passage ends at each word; those that begin before the text count only where it is shorter
        whole = (within + 1 >= passage) | (within + 1 == np.repeat(n, n))
        end = np.arange(1, len(r) + 1)
        odds = np.where(whole, np.exp(np.clip(total[end] - total[end - size], -40, 40)), 0.0)
        return np.log(np.maximum(sums(odds, n), 1e-30) / np.maximum(sums(whole.astype(np.float64), n), 1)) * (n > 0)


def _binned(models):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BINS, np.int64)
        for keys, texts in blocks(batches):
            fold = np.array([k[1] for k in keys])
            x = np.zeros(len(texts))
            for own in range(FOLDS):
                at = np.flatnonzero(fold == own)
                x[at] = models.value[own].ratios([texts[i] for i in at])
            counts += np.bincount(np.clip(x / WIDTH + BINS / 2, 0, BINS - 1).astype(np.int64) * 2 + np.array([k[0] for k in keys]), minlength=2 * BINS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    return run


def rising(counts: np.ndarray) -> np.ndarray:
    """The share of label 1 in each cell of counts by label, never falling from cell to cell (least squares, pool of adjacent violators).

    Cells are drawn a little to the share of all, and between cells with counts the share runs straight."""
    base = (counts[:, 1].sum() + 0.5) / (counts.sum() + 1)
    at = np.flatnonzero(counts.sum(axis=1) > 0)
    pools: list[list[float]] = []  # label 1, all, cells
    for i in at:
        pools.append([counts[i, 1] + base * 0.01, counts[i].sum() + 0.01, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    shares = np.repeat([x[0] / x[1] for x in pools], [int(x[2]) for x in pools])
    return np.interp(np.arange(len(counts)), at, shares) if len(at) else np.full(len(counts), base)


class Scorer:
    """A model and its calibration; `base` instead where only one class, or none, has labelled texts."""

    def __init__(self, model: Model | None, shares: np.ndarray | None = None, base: float = 0.0) -> None:
        self.model, self.shares, self.base = model, shares, base

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.base)
        return np.interp(self.model.ratios(texts) / WIDTH + BINS / 2 - 0.5, np.arange(BINS), self.shares)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> Scorer:
    """Learn from `docs` that `labels` (id, 0 or 1) covers, from at most `per_class` ids of each class: those of the least hash.

    These ids are few by that bound, so they are broadcast and no text is shuffled. Words and pairs that fewer texts hold than
    `least_docs`, or than `least_share` of them, are rare. An id with several labels counts as toxic if one says so; labels
    other than 0 and 1 and null texts teach nothing. Each fold of the texts is compared by a model of the others, and
    a rising curve of the toxic share, weighted back to the classes' true sizes, turns ratios into scores. The driver receives at most
    2 * MAX_EXPRESSIONS counts and 2 * BINS sums."""
    spark = docs.sparkSession
    ruled = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("of")).agg(F.max(label_col).cast("int").alias("label"))
    n_of = {r[0]: r[1] for r in ruled.groupBy("label").count().collect()}
    if len(n_of) < 2:
        return Scorer(None, base=float(1 in n_of))
    hashed = F.xxhash64("of", F.lit(11))
    picked = [ruled.where(F.col("label") == k).orderBy(hashed, "of").limit(per_class) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1]).withColumn("fold", F.pmod(F.xxhash64("of", F.lit(12)), F.lit(FOLDS)).cast("int"))
    read = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("of"), F.col(text_col).alias("text"))
    texts = read.join(F.broadcast(sample), "of").select("label", "text", "fold")
    schema = ", ".join(["prev long", "word long", *(f"{c} long" for c in COUNTS), "texts long"])
    counted = texts.mapInArrow(_count, schema).groupBy("prev", "word").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "texts"))).persist()
    least = max(least_docs, math.ceil(least_share * sum(min(n, per_class) for n in n_of.values())))
    contexts = counted.where("prev is not null").groupBy("word").agg(F.count("*").alias("contexts"))
    often = counted.where(F.col("texts") >= least)
    top = lambda df: df.orderBy(F.col("texts").desc(), *(c for c in ("prev", "word") if c in df.columns)).limit(MAX_EXPRESSIONS).toArrow()
    words, pairs = top(often.where("prev is null").drop("prev").join(contexts, "word", "left")), top(often.where("prev is not null"))
    counted.unpersist()
    hashes = words.column("word").to_numpy()
    order = np.argsort(hashes)
    hashes, stands = hashes[order], words.column("contexts").fill_null(0).to_numpy()[order]
    n = np.stack([words.column(c).to_numpy()[order] for c in COUNTS], axis=1).astype(np.float64)
    ends = np.stack([pairs.column(c).to_numpy() for c in ("prev", "word")], axis=1)
    spot = np.minimum(np.searchsorted(hashes, ends), max(0, len(hashes) - 1))
    known = (hashes[spot] == ends).all(axis=1) if len(hashes) else np.zeros(len(ends), bool)
    spot, m = spot[known], np.stack([pairs.column(c).to_numpy() for c in COUNTS], axis=1).astype(np.float64)[known]
    n, m = (x.reshape(len(x), FOLDS, 2) for x in (n, m))
    folds = [Model(hashes, stands, n.sum(axis=1) - n[:, k], spot, m.sum(axis=1) - m[:, k]) for k in range(FOLDS)]
    cells = texts.mapInArrow(_binned(spark.sparkContext.broadcast(folds)), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    binned = np.zeros((BINS, 2))
    for cell, count in cells:
        binned[cell // 2, cell % 2] = count * max(1.0, n_of[cell % 2] / per_class)
    return Scorer(Model(hashes, stands, n.sum(axis=1), spot, m.sum(axis=1)), rising(binned))


def _score(scorer):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer.value.scores(texts))], names=["id", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of `docs`, from 0 to 1. The model, of bounded size, is broadcast; there is no shuffle.

    A null text, an empty one and one without words or with rare words alone have the score of no evidence. Very long texts
    are taken whole; repeated rows have one score each, the same for the same text; other columns are left out, whatever
    their names; an empty table gives an empty one. If no label or only label 0 was learned, every score is 0; if only label 1, 1."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_score(shared), "id long, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole documents table, learned from the labels of four fifths of it."""
    docs = table(spark, sf_dir, "documents")
    scorer = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, scorer).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
