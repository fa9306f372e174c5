"""Byte-level BPE: each partition encodes its distinct words by a recursive DuckDB query and decodes its texts' ids by ordered aggregation."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, sums, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Rows of a word are its tokens by position. A step gives each the token that follows, joins them with the merge table, finds
#: each word's pair of least rank (the leftmost of equals), puts the merged token in its place and drops the position after
#: it. A word without a pair is final and leaves the recursion.
ENCODE = """
with recursive step(w, p, t, fin) as (
  select w, p, t, false from pieces
  union all
  (with near as (select w, p, t, lead(t) over x as n, lag(p) over x as before from step where not fin window x as (partition by w order by p)),
    ranked as (select s.w, s.p, s.t, s.before, (m.merged::bigint << 32) + s.p as k from near s left join merges m on s.t = m.l and s.n = m.r),
    best as (select w, min(k) as k from ranked group by w)
  select s.w, s.p, case when s.p = (b.k & 4294967295) then (b.k >> 32)::int else s.t end, b.k is null
  from ranked s join best b on s.w = b.w where b.k is null or s.before is null or s.before <> (b.k & 4294967295)))
select w, t from step where fin order by w, p
"""
#: The same for long words, several merges of a word at once, STEPS times. A pair whose rank nothing undercuts within `reach`
#: bytes, twice the longest token, is merged before anything that could touch it: what grows from further away does not get
#: there. Of pairs of that rank the leftmost goes first. Pairs that overlap form a run, of which every second one merges,
#: counted from its start. A pair is put off if one of its rank before it, within reach, may still set off a merge that comes
#: first: one that is put off itself, or whose token makes a pair of less rank with what stands beside it.
STEPS = 8
ENCODE_LONG = """
with recursive step(w, p, t, n, d) as (
  select w, p, t, lead(t) over (partition by w order by p), 0 from pieces
  union all
  (with ranked as (select s.w, s.p, s.t, s.d, m.merged as r from step s left join merges m on s.t = m.l and s.n = m.r where s.d < {steps}),
    lows as (
      select *, coalesce(r = min(r) over (partition by w order by p range between {reach} preceding and {reach} following), false) as low,
        lag(r) over x is distinct from r as starts, row_number() over x as i, lead(t, 2) over x as after, lag(t) over x as before
      from ranked window x as (partition by w order by p)),
    runs as (
      select *, max(case when starts then i end) over x as first_i, max(case when starts then 2 * i + low::int end) over x % 2 = 1 as first_low
      from lows window x as (partition by w order by p rows unbounded preceding)),
    able as (select *, low and first_low and (i - first_i) % 2 = 0 as hit from runs),
    beside as (select *, case when coalesce(lag(hit, 2) over x, false) then lag(r, 2) over x else before end as left_t from able window x as (partition by w order by p)),
    checked as (
      select b.*, b.r is not null and case when low and first_low then hit and (coalesce(ml.merged < b.r, false) or coalesce(mr.merged < b.r, false)) else true end as open
      from beside b left join merges ml on b.hit and ml.l = b.left_t and ml.r = b.r left join merges mr on b.hit and mr.l = b.r and mr.r = b.after),
    chosen as (
      select w, p, t, d, r, hit and coalesce(min(case when open then r end) over (partition by w order by p range between {reach} preceding and 1 preceding) > r, true) as hit from checked),
    cut as (select w, p, d, case when hit then r else t end as t, lag(hit, 1, false) over (partition by w order by p) as gone from chosen)
  select w, p, t, lead(t) over (partition by w order by p), d + 1 from cut where not gone))
select w, p, t from step where d = {steps} order by w, p
"""
#: One thread keeps the order of the subquery.
DECODE = "select d, string_agg(h, '') as h from (select e.d, v.h from encoded e join vocabulary v on e.t = v.id order by e.i) group by d"
LONG = 64  # bytes of a word


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank pairs."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Pool:
    """Numbered strings and the ids of each."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbers in a row, and how many each has."""
        start, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        to = np.cumsum(size)
        return self.ids[np.repeat(start - to + size, size) + np.arange(to[-1] if len(to) else 0)], size


class Codec:
    """The tables of one vocabulary and the words seen lately, in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int) -> None:
        self.ranks, self.find, self.keep = ranks, regex.compile(pattern).findall, keep
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.long = ENCODE_LONG.format(steps=STEPS, reach=2 * max(map(len, ranks)))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        left, right, merged = (pa.array(c, pa.int32()) for c in zip(*merges, strict=True)) if merges else [pa.array([], pa.int32())] * 3
        self.fill("merges", l=left, r=right, merged=merged)
        self.fill("vocabulary", id=pa.array(ranks.values(), pa.int32()), h=pa.array([t.hex() for t in ranks]))
        self.words, self.older = Pool(), Pool()

    def fill(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode new words and keep their ids."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(r, -1) for r in raw), np.int32, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        place = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        parts = [(np.flatnonzero(whole >= 0).astype(np.int32), whole[whole >= 0])]  # a word that is a token itself needs no merge
        for long in (False, True):
            some = (whole[word] < 0) & ((sizes[word] > LONG) == long)
            if some.any():
                parts.append((self.merge_long if long else self.merge)(word[some], place[some], self.single[data[some]]))
        w, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(w, kind="stable")
        self.words.add(words, t[order], np.bincount(w, minlength=len(words)))

    def merge(self, w: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.fill("pieces", w=pa.array(w), p=pa.array(p), t=pa.array(t))
        done = self.db.sql(ENCODE).to_arrow_table()
        return done.column(0).to_numpy(), done.column(1).to_numpy()

    def merge_long(self, w: np.ndarray, p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(w) + 1
        while len(w) < n:
            n = len(w)
            self.fill("pieces", w=pa.array(w), p=pa.array(p), t=pa.array(t))
            w, p, t = (c.to_numpy() for c in self.db.sql(self.long).to_arrow_table().columns)
        return w, t

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if len(self.words.at) > self.keep // 2:  # words that come again before the next turn move on, the others are forgotten
            self.older, self.words = self.words, Pool()
        split = list(map(self.find, texts))
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        found = list(map(self.words.at.get, words))
        odd = [i for i, k in enumerate(found) if k is None]
        new = list(dict.fromkeys(map(words.__getitem__, odd)))
        if again := [w for w in new if w in self.older.at]:
            self.words.add(again, *self.older.spell(np.array([self.older.at[w] for w in again], np.int64)))
            new = [w for w in new if w not in self.older.at]
        for k in range(0, len(new), 100_000):
            self.learn(new[k : k + 100_000])
        for i in odd:
            found[i] = self.words.at[words[i]]
        ids, size = self.words.spell(np.array(found, np.int64))
        return ids, sums(size, n)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of each list of `n` ids."""
        self.fill("encoded", d=pa.array(np.repeat(np.arange(len(n)), n)), i=pa.array(np.arange(len(ids))), t=pa.array(ids))
        out = [b""] * len(n)
        for d, h in zip(*(c.to_pylist() for c in self.db.sql(DECODE).to_arrow_table().columns), strict=True):
            out[d] = bytes.fromhex(h)
        return out


_codecs: dict[tuple, Codec] = {}


def _encode(ranks, pattern: str, keep: int, names: list[str], extra_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = ranks.value
        key = (len(table_of), hash(next(iter(table_of), b"")), pattern)
        codec = _codecs.get(key) or _codecs.setdefault(key, Codec(table_of, pattern, keep))
        for ids, texts in blocks(batches):
            flat, n = codec.encode([(t or b"").decode("utf-8", "replace") for t in texts])
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
            decoded = pa.array(codec.decode(flat, n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), tokens, decoded, *[pa.array(texts, pa.binary()).cast(pa.string())] * extra_text], names=names)

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep_words: int = 600_000, extra_text: bool = False) -> DataFrame:
    """(id_col, token_ids, decoded) for each row of `docs`: byte-level BPE of every match of `pattern` on its own, no
    special tokens, and the bytes that the ids decode to; with `extra_text` also the text.

    `path`: a rank file (base64 and rank a line), read on the driver and broadcast, about 1 MB; over 64 MB is refused.
    `keep_words` bounds the words that a Python worker remembers; beyond it they are encoded anew. A null or empty text
    gives no ids and no bytes; very long texts and words are encoded whole, long words by several merges a step; of pairs
    with the same rank the leftmost goes first; every row gives one row, repeated ones too; other columns are left alone,
    whatever their names; an empty table gives an empty one. There is no shuffle."""
    ranks = load_ranks(path or public_tokenizers.path(VOCABULARY))
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()), *[T.StructField("text", T.StringType())] * extra_text])
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_encode(spark.sparkContext.broadcast(ranks), pattern, keep_words, schema.names, extra_text), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and the decoded bytes of the whole documents table, as digests."""
    rows = encode_decode(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
