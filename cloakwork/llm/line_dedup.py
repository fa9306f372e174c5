"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, fresh, join_facts, staged, table


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the stripped, ASCII-lower-cased line, or None if it has fewer than `min_chars` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _explode(min_chars: int):
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            out_ids, out_keys = [], []
            for i, text in zip(ids, texts, strict=True):
                keys = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                out_ids += [i] * len(keys)
                out_keys += keys
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, pa.binary()), pa.array(out_ids, pa.int64())], names=["line_hash", "line_doc"])

    return explode


def _reassemble(text_at: int, drop_at: int, min_chars: int, names: list[str]):
    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, dropped = [], [], []
            for text, drop in zip(batch.column(text_at).cast(pa.large_binary()).to_pylist(), batch.column(drop_at).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept))
            columns = [batch.column(i) for i in range(batch.num_columns) if i != drop_at]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return reassemble


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with every line removed whose key is in at least `min_docs` documents, except in the largest id that holds it.

    A key is the line without white space at its ends and with A-Z in lower case; keys under `min_chars` code points
    always stay. Result: the columns of `docs` with the shortened text, then n_lines and n_dropped (input columns of
    these two names are replaced). A null text counts one empty line and stays null; an empty text is one empty line;
    very long texts and lines are taken whole;
    rows with a null id count for nothing and keep their lines; other columns stay, whatever their names; repeated rows of an id count as one document and lose
    the same lines; an empty table gives an empty table.

    Counting needs sums alone, so a line that a third of all documents share is added up before the shuffle. Only
    (hash, id) of lines that reach the count meet their counts again; those of a hot hash meet a broadcast row and are
    dealt out by id."""
    docs = docs.drop("n_lines", "n_dropped")
    keys = docs.select(F.col(id_col).cast("long"), text_col).where(F.col(id_col).isNotNull()).mapInArrow(_explode(min_chars), "line_hash binary, line_doc long")
    often = staged(keys.groupBy("line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = staged(join_facts(keys, often, ["line_hash"], "line_doc", total).select("line_hash", "line_doc"))
    last = held.distinct().groupBy("line_hash").agg(F.count("*").alias("n"), F.max("line_doc").alias("last_doc")).where(F.col("n") >= min_docs)
    drops = join_facts(held, last, ["line_hash"], "line_doc", total).where(F.col("line_doc") < F.col("last_doc"))
    # columns of the input may have any name, so they travel in one struct beside the id
    drops = drops.groupBy("line_doc").agg(F.collect_set("line_hash").alias("line_drop"))
    whole = docs.select(F.col(id_col).cast("long").alias("line_doc"), F.struct(*docs.columns).alias("row"))
    joined = whole.join(drops, "line_doc", "left").select("row.*", F.col("line_drop").alias(fresh("line_drop", docs.columns)))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_reassemble(docs.columns.index(text_col), len(docs.columns), min_chars, schema.names), schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over the whole documents table, texts as digests."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9_SQL = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents),
lines as (select doc_id, i, s[i] as line,
    translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k
  from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from split)),
often as (select k, max(doc_id) as last_doc from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.*, coalesce(l.doc_id < o.last_doc, false) as gone from lines l left join often o on l.k = o.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
