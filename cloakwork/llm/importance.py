"""Target-distribution importance resampling: hashed word n-grams, log-ratio gains to a target set, and a Gumbel draw.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes, `bytes.split` yields the words, chained
`zlib.crc32` seeds extend a run by one word at a time, and Counters add up the buckets of a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, staged, table

#: Digits, letters and all bytes beyond ASCII stay, A-Z as a-z; every other byte is a blank.
BLANK = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
N_BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42


def runs(text: bytes | None) -> tuple[int, list[int]]:
    """How many words a text has, and the CRC-32 of each run of one, two and three of them, joined by blanks."""
    words = (text or b"").translate(BLANK).split()
    tails = [b" " + w for w in words[1:]]
    one = list(map(crc32, words))
    two = list(map(crc32, tails, one))  # a checksum goes on where the shorter run's ended
    return len(words), one + two + list(map(crc32, tails[1:], two))


def _buckets(found: list[int], n_buckets: int) -> np.ndarray:
    return (np.array(found, np.uint32) % np.uint32(n_buckets)).astype(np.int64)


def _count(n_buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for _, texts in blocks(batches):
            for text in texts:
                total.update(_buckets(runs(text)[1], n_buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: a task gives at most `n_buckets` sums, and so many reach the driver."""
    rows = docs.select(F.lit(0), text_col).mapInArrow(_count(n_buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of target over source share of each bucket, one added to each count, rounded down."""
    size, of, to = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * of / ((float(source[i]) + 1) * to))) for i in range(size)], np.int64)


def _weigh(gain_of):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gain_of.value
        for ids, texts in blocks(batches):
            n_words, n_features, weights = [], [], []
            for text in texts:
                n, found = runs(text)
                n_words.append(n)
                n_features.append(len(found))
                weights.append(int(gain[_buckets(found, len(gain))].sum()) if found else 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n_words, n_features, weights)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = N_BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): the rows of `docs` drawn to be like `target`, in the order of the draw.

    A text's weight is the sum of its features' gains; its score adds Gumbel noise of a hash of the seed and the id, so
    that the highest scores are a draw without replacement by weight, the same on every run. Of the N rows with at least
    `least_words` words, floor(percent * N / 100) are drawn; the others' rank is null. Ties go to the smaller id, then to
    fewer features. A null or empty text has no feature and weight 0; very long texts are taken whole; each of several
    rows of an id is weighed and drawn by itself; a null id comes after others of its score and has the noise of an empty one;
    other columns are left out, whatever their names; an empty table gives an empty one, and an empty target evens all gains out.

    Texts are read twice and never shuffled: what leaves a task is at most a sum for each bucket, then a narrow row for each
    text. Rows are ranked by a range partitioning, whose parts are numbered and moved on by the sizes of those before."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, target_col, n_buckets)))
    weighed = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_weigh(shared), "doc_id long, n_words long, n_features long, weight long")
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((hashed + 0.5) / 4294967296)))
    rows = staged(weighed.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*"), F.count(F.when(able, 1))).collect())  # a row for each part
    drawn, before, starts = percent * sum(x[2] for x in sizes) // 100, 0, []
    for number, size, _ in sizes:
        starts.append((number, before + 1))
        before += size
    start = docs.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(start), part == F.col("part")).select(F.col("doc_id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(able & (rank <= drawn), rank).alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw a twentieth of the whole documents table towards the benchmark's texts."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of distinct features, a byte a step with a table made by its own rule (polynomial 0xEDB88320).
OP13_SQL = r"""
with recursive bits(b, x, k) as (
  select b, b::ubigint, 0 from range(256) t(b)
  union all select b, case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end, k + 1 from bits where k < 8),
crc as (select list(x order by b) as step from bits where k = 8),
texts as (
  select 0 as kind, doc_id, text from documents union all select 1, row_number() over (), text from benchmark),
words as (
  select kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
found as (
  select kind, doc_id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as feature
  from words),
terms as (select kind, doc_id, feature, count(*) as n from found group by all),
hexes as (select feature, hex(encode(feature)) as h from (select distinct feature from terms)),
hashed as (
  select feature, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint)),
    lambda c, b: xor(c >> 8, crc.step[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 10000 as bucket
  from hexes, crc),
held as (select kind, doc_id, bucket, sum(n) as n from terms join hashed using (feature) group by all),
sums as (select b as bucket, coalesce(sum(n) filter (where kind = 0), 0)::double as s, coalesce(sum(n) filter (where kind = 1), 0)::double as t from range(10000) r(b) left join held on bucket = b group by b),
gain as (
  select bucket, floor(1000 * ln((t + 1) * ((select sum(s) from sums) + 10000) / ((s + 1) * ((select sum(t) from sums) + 10000))))::bigint as gain from sums),
weights as (select doc_id, sum(n * gain)::bigint as weight from held join gain using (bucket) where kind = 0 group by doc_id),
scored as (
  select w.doc_id, len(w.w) as n_words, (len(w.w) + greatest(len(w.w) - 1, 0) + greatest(len(w.w) - 2, 0))::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words w left join weights using (doc_id) where kind = 0),
ranked as (select *, row_number() over (order by n_words >= 20 desc, score desc, doc_id) as r from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= (select 5 * count(*) // 100 from scored where n_words >= 20) then r end as rank from ranked
"""
