"""Substring dedup by recompression: rounds name runs and pairs of tokens, so that equal substrings get equal inner symbols;
symbols that several texts share reveal long repeats, which are then verified by 128-bit hashes of all their words.

Names are hashes of what they stand for, so that a task names a text's runs and pairs as every other task does: the rounds
need no shuffle and no table of names, and only symbols that may be shared ever meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, join_facts, mix, staged, table

ROUNDS = 4
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
BASES = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of `length` words from `start`: two polynomials over independent scramblings of the words."""
    out = []
    with np.errstate(over="ignore"):
        for k, base in enumerate(BASES):
            power = np.cumprod(np.full(len(words) + 1, base, np.uint64)) * U(pow(int(base), -1, 1 << 64))  # base ** i
            # sum of w[i] / base ** i, so that a difference, times base ** start, names the run wherever it stands
            inverse = U(pow(int(base), -1, 1 << 64))
            down = np.cumprod(np.full(len(words) + 1, inverse, np.uint64)) * base
            total = np.r_[U(0), np.cumsum(mix(words ^ (GOLD * U(k + 1))) * down[:-1])]
            out.append(mix((total[start + length] - total[start]) * power[start] + U(k)))
    return out[0], out[1]


def rounds(words: np.ndarray, doc: np.ndarray, n_rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, start, lo, hi) of the symbols of each level: words [lo, hi) alone decide that the symbol is there.

    A round first names each run of one symbol by symbol and length, then cuts the symbols in two halves by a bit of
    their hash and names each pair of a left and a right one. A name depends on what it stands for and nothing else, so
    all tasks give one substring the same names without asking each other. A run needs both neighbours to be known to be
    whole; a symbol that stays single needs the neighbour that might have joined it. Symbols never cross documents."""
    n = len(words)
    name, start = mix(words + GOLD), np.arange(n)
    lo, hi, owner = start.copy(), start + 1, doc.copy()
    levels = [(name, start, lo, hi)]
    with np.errstate(over="ignore"):
        for r in range(n_rounds):
            if len(name) < 2:
                break
            salt = mix(np.array([r + 1], np.uint64) * GOLD)[0]
            # runs; a document's edge is no neighbour, and an edge can't be told from within, so what needs it is marked
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])
            length = np.diff(np.r_[first, len(name)])
            end = first + length - 1
            before, after = np.maximum(first - 1, 0), np.minimum(end + 1, len(name) - 1)
            own_before, own_after = (first > 0) & (owner[before] == owner[first]), (end + 1 < len(name)) & (owner[after] == owner[end])
            run_lo = np.where(own_before, lo[before], -1)
            run_hi = np.where(own_after, hi[after], n + 1)
            run_lo[~own_before & (run_lo < 0)] = -1
            name = np.where(length > 1, mix((name[first] ^ salt) + length.astype(np.uint64) * GOLD), name[first])
            start, owner = start[first], owner[first]
            lo, hi = np.minimum(run_lo, lo[first]), np.maximum(run_hi, hi[end])
            # pairs
            right = (mix(name ^ salt) >> U(63)).astype(bool)
            joins = np.zeros(len(name), bool)
            joins[:-1] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
            taken = np.r_[False, joins[:-1]]
            near = np.where(right, np.maximum(np.arange(len(name)) - 1, 0), np.minimum(np.arange(len(name)) + 1, len(name) - 1))
            same = (owner[near] == owner) & (near != np.arange(len(name)))
            new_lo = np.where(joins, lo, np.where(right, np.where(same, np.minimum(lo, lo[near]), -1), lo))
            new_hi = np.where(~right, np.where(same, np.maximum(hi, hi[near]), n + 1), hi)
            keep = ~taken
            second = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
            paired = mix(mix(name ^ salt) * GOLD + name[second])
            name = np.where(joins, paired, name)[keep]
            start, owner = start[keep], owner[keep]
            lo, hi = new_lo[keep], np.where(joins, np.maximum(hi, hi[second]), new_hi)[keep]
            levels.append((name, start, lo, hi))
    return levels


def anchors(words: np.ndarray, doc: np.ndarray, last: np.ndarray, width: int, n_rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, name, at): for each window start, a symbol within it that the window alone decides, and where that starts.

    The highest level that has such a symbol counts, there the longest, of these the least name, then the leftmost; equal
    windows choose alike.
    `last`: the window starts of a document end there."""
    window = np.flatnonzero(np.arange(len(words)) < last)
    name, at = np.zeros(len(window), np.uint64), np.full(len(window), -1)
    open_ = np.arange(len(window))
    for names, start, lo, hi in reversed(rounds(words, doc, n_rounds)):
        if not len(open_):
            break
        fit = np.flatnonzero((lo >= 0) & (hi <= len(words)) & (hi - lo <= width))
        if not len(fit):
            continue
        # bounds never run backwards along a level, so a window's symbols are consecutive
        a = np.searchsorted(np.maximum.accumulate(lo[fit]), window[open_], side="left")
        b = np.searchsorted(np.minimum.accumulate(hi[fit][::-1])[::-1], window[open_] + width, side="right")
        has = np.flatnonzero(b > a)
        if len(has):
            best = fit[_least(np.lexsort((names[fit], start[fit] - np.r_[start, len(words)][fit + 1])), a[has], b[has])]
            name[open_[has]], at[open_[has]] = names[best], start[best]
            open_ = np.delete(open_, has)
    return window, name, at


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first in `order`, a stable sort, of the indexes in each [a, b): a table of minima over powers of two."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # equal values keep their order, so the least rank is the leftmost of the least
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out, best = np.empty(len(a), np.int64), rank
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            best = np.minimum(best[:-half], best[half:])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(best[a[own]], best[b[own] - (1 << k)])
    return order[out]


class Texts:
    """Word hashes of a block of texts in one row, with document numbers and the end of each document's window starts."""

    def __init__(self, texts: list[bytes | None], width: int) -> None:
        split = [(t or b"").split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.words = word_hashes([w for s in split for w in s])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.last = np.repeat(self.starts + np.maximum(self.sizes - width + 1, 0), self.sizes)


def _find(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, 1 << 20):
            x = Texts(texts, width)
            window, name, at = anchors(x.words, x.doc, x.last, width)
            # windows that follow each other and choose the same symbol are one row: a chunk
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]) if len(window) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(window)])
            begin = window[first]
            h1, h2 = window_hashes(x.words, begin, n + width - 1)
            offset = (at[first] - begin).astype(np.uint64)
            chunk = mix(h1 ^ mix(offset + U(1)) ^ (n.astype(np.uint64) << U(32))) ^ mix(h2)
            doc = x.doc[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[first].view(np.int64)), pa.array(chunk.view(np.int64)), pa.array(np.array(ids, np.int64)[doc]), pa.array((begin - x.starts[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["symbol", "chunk", "id", "at", "n"],
            )

    return run


def _windows(width: int):
    """Hashes of the single windows of the wanted chunks of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, packed in blocks(batches, 1 << 18):
            wanted = [k[1] or [] for k in keys]
            x = Texts([unpack(t) if w else None for t, w in zip(packed, wanted, strict=True)], width)
            d, at, n = (np.array(v, np.int64) for v in zip(*((d, c["at"], c["n"]) for d, w in enumerate(wanted) for c in w if c["at"] + c["n"] + width - 1 <= x.sizes[d]), strict=True)) if any(wanted) else [np.empty(0, np.int64)] * 3
            row = np.repeat(np.arange(len(d)), n)
            at = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            h1, h2 = window_hashes(x.words, (x.starts[d])[row] + at, width)
            ids = np.array([k[0] for k in keys], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[d][row]), pa.array(at.astype(np.int32))], names=["h1", "h2", "id", "at"])

    return run


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = [None if t is None else squeeze(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["id", "packed"])


def unpack(packed: bytes | None) -> bytes | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, spans): for each id, runs (at, n) of window starts whose words also start in a text with a smaller id.

    Chunks, the windows that choose one symbol, are named by all their words. Symbols of one text alone go first. Copies
    of a passage share its chunks, so a chunk that has been seen under a smaller id is a repeat as a whole, and only its
    smallest id goes on. Where one symbol stands in different chunks, at the edges of passages, the windows of one text
    for each chunk are compared one by one. All counts are minima and maxima, added up before they are shuffled."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = staged(texts.mapInArrow(_find(width), "symbol long, chunk long, id long, at int, n int"))
    total = chunks.count()
    span = [F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")]
    often = staged(chunks.groupBy("symbol").agg(*span).where("a < b").select("symbol", "n"))
    shared = staged(join_facts(chunks, often, ["symbol"], "id", total))
    heads = shared.groupBy("symbol", "chunk").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("n"))
    mixed = heads.groupBy("symbol").agg(F.min("head").alias("a"), F.max("head").alias("b"), F.count("*").alias("n")).where("a < b").select("symbol", "n")
    edges = join_facts(heads.withColumnRenamed("n", "rows"), mixed, ["symbol"], "chunk", total).select("symbol", "chunk", "head", F.col("rows").alias("n"))
    wanted = join_facts(shared, edges, ["symbol", "chunk"], "id", total).where("id = head").groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("chunks"))
    packed = texts.mapInArrow(_pack, "id long, packed binary")
    windows = staged(packed.join(wanted.hint("shuffle_hash"), "id").select("id", "packed", "chunks").mapInArrow(_windows(width), "h1 long, h2 long, id long, at int"))
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("most > least").drop("most")
    part = join_facts(windows, least, ["h1", "h2"], "id", windows.count()).where("id > least").select("id", "at", F.lit(1).alias("n"))
    whole = join_facts(shared, heads.where("last > head").drop("last"), ["symbol", "chunk"], "id", total).where("id > head").select("id", "at", "n")
    return whole.unionByName(part).groupBy("id").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _remove(width: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches):
            kept, n_words, n_removed = [], [], []
            for (_, spans), packed in zip(keys, texts, strict=True):
                words = (unpack(packed) or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    if s["at"] + s["n"] + width - 1 <= len(words):
                        gone[s["at"]] += 1
                        gone[s["at"] + s["n"] + width - 1] -= 1
                out = np.cumsum(gone)[:-1] > 0
                kept.append(b" ".join([w for w, g in zip(words, out.tolist(), strict=True) if not g] if spans else words))
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    return run


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id_col, kept, n_words, n_removed): each text's words, one blank between, without those in a window of `width` words
    that also starts in a text with a smaller id; windows are those of the input, not of what is left.

    A null, empty or wordless text keeps nothing; texts under `width` words stay whole; rows with a null id are left
    alone; very long texts are taken whole, in a task's memory; equal passages within one document stay, unless a smaller id has
    them; columns other than these two are left out, whatever their names; repeated rows of one id are judged as one document if their texts are equal (with different texts, a span
    found in one is looked for in all); an empty table gives an empty one."""
    spans = repeated_windows(docs, id_col, text_col, width).withColumnRenamed("id", "span_id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack, "id long, packed binary")
    rows = rows.join(spans.hint("shuffle_hash"), F.col("id") == F.col("span_id"), "left").select("id", "packed", "spans")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(_remove(width, schema.names), schema)


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that repeat across the whole documents table, removed; texts as digests."""
    kept = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as s from documents),
windows as (select doc_id, i, md5(array_to_string(s[i:i + 49], ' ')) as h from (select doc_id, s, unnest(range(1, len(s) - 48)) as i from w)),
firsts as (select h, min(doc_id) as first_doc from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as k from windows join firsts using (h) where doc_id > first_doc),
one as (select doc_id, unnest(s) as x, generate_subscripts(s, 1) as k from w),
kept as (select o.doc_id, count(g.k) as n_removed, string_agg(x, ' ' order by o.k) filter (where g.k is null) as kept from one o left join gone g on g.doc_id = o.doc_id and g.k = o.k group by o.doc_id)
select w.doc_id, len(s)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)
"""
