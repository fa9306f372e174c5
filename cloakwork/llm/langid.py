"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in sparse numpy batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, sums, table

LETTER = regex.compile(r"\p{L}")
MAX_LANGUAGES = 256
BLOCK_BYTES = 1 << 19  # of texts at once; n-grams take some 100 bytes for each


class Model:
    """Languages in sorted order, and the log-probability of each bucket in each of them (buckets x languages)."""

    def __init__(self, languages: list[str], logp: np.ndarray, orders: tuple[int, ...]) -> None:
        self.languages, self.logp, self.orders = languages, logp, orders


def grams(texts: list[bytes | None], n_buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of the lower-cased texts, a blank at either end, and how many each text has."""
    codes = [np.frombuffer(f" {(t or b'').decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, codes), np.int64)
    text = np.concatenate(codes).astype(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))  # characters from here to the text's end
    out, hashed = [], np.zeros(len(text), np.uint64)
    for n in range(1, max(orders) + 1):
        step = text[n - 1 :]
        hashed = (hashed[: len(step)] + step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if n in orders:
            bucket = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % n_buckets
            out.append((bucket, left[: len(step)] >= n))
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros(len(texts), np.int64)
    for bucket, fits in out:
        counts += np.bincount(owner[: len(bucket)][fits], minlength=len(texts))
    buckets = np.concatenate([b[fits] for b, fits in out])
    owners = np.concatenate([owner[: len(b)][fits] for b, fits in out])
    return buckets[np.argsort(owners, kind="stable")], counts


def _count(n_buckets: int, orders: tuple[int, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for langs, texts in blocks(batches, BLOCK_BYTES):
            for lang in set(langs):
                own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
                total[lang] = total.get(lang, 0) + np.bincount(grams(own, n_buckets, orders)[0], minlength=n_buckets)
            if len(total) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", n_buckets: int = 1 << 15, orders: tuple[int, ...] = (1, 2, 3)) -> Model:
    """Counts of hashed n-grams over every labelled row, added up per language and bucket; rows without label or text are skipped.

    The driver receives at most MAX_LANGUAGES x `n_buckets` sums, however large the input is. Smoothing adds one half."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    counts = rows.mapInArrow(_count(n_buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table_of = np.full((n_buckets, len(languages)), 0.5)
    column = {k: i for i, k in enumerate(languages)}
    table_of[counts.column("bucket").to_numpy(), [column[k] for k in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
    return Model(languages, np.log(table_of / table_of.sum(axis=0)).astype(np.float32), orders)


def _score(model, id_names: list[str], sharpness: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for ids, texts in blocks(batches, BLOCK_BYTES):
            letters = [bool(t) and LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if m.languages:
                buckets, counts = grams(texts, len(m.logp), m.orders)
                mean = sums(m.logp[buckets], counts) / np.maximum(counts, 1)[:, None]
                odds = np.exp(sharpness * (mean - mean.max(axis=1, keepdims=True)))
                best = mean.argmax(axis=1)
                score = odds.max(axis=1) / odds.sum(axis=1)
            known = [x and bool(m.languages) for x in letters]
            lang = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], names=id_names)

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 10.0) -> DataFrame:
    """(id_col, lang_pred, lang_score) for each row: the language of greatest likelihood (ties: the first in sorted order)
    and its share of the likelihoods, per n-gram and raised to `sharpness`, from 0 to 1.

    `und` and 0 for a null text, a text without a letter, and every text if no language was learned. Very long texts are
    scored whole; every row gives one row, repeated ones and those with a null id too; other columns are left out, whatever
    their names; an empty table gives an empty one. The matrix is
    broadcast; its size is bounded by MAX_LANGUAGES and the buckets. There is no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_score(shared, schema.names, sharpness), schema)


def _keep(model, text_at: int, least: float):
    predict_texts = _score(model, ["id", "lang", "score"], 10.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(text_at)], names=["id", "text"])
            seen = pa.Table.from_batches(predict_texts([rows]))
            keep = [lang != "und" and score >= least for lang, score in zip(seen.column("lang").to_pylist(), seen.column("score").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without the rows predicted `und` or with a score under `least`; its columns are unchanged, empty tables stay empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, docs.columns.index(text_col), least), docs.schema) if docs.columns else docs


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of the whole documents table, learned from four fifths of it."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
