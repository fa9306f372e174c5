"""Source divergence audit: how far the terms of one source of a language are from those of its other sources, and which terms stand out.

Partitions fold whole documents into stripes: a hash table from a term to its document frequency and its count in each
source. Stripes are given out when they fill the memory allowed, merged by term, and the merged stripes give the divergences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, staged, table

#: Letters and all bytes beyond ASCII stay, A-Z as a-z; every other byte is a blank.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
HELD_BYTES = 160 << 20  # of the stripes that a task holds, about
GROUP_ENTRIES = 1 << 16  # of the merged stripes that one call compares
CELLS = 1 << 20  # of a table of terms by sources
SHARE = 1_000_000_000
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
NAMES = ["lang", "term", "df", "sources", "counts"]


def _rows(rows: list[tuple[bytes, bytes | None, int, dict[bytes, int]]]) -> pa.RecordBatch:
    offsets = pa.array(np.r_[0, np.cumsum([len(r[3]) for r in rows])], pa.int32())
    sources = pa.array([s for r in rows for s in r[3]], pa.binary()).cast(pa.string())
    counts = pa.array([n for r in rows for n in r[3].values()], pa.int64())
    text = lambda i: pa.array([r[i] for r in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([text(0), text(1), pa.array([r[2] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, counts)], names=NAMES)


def _batches(rows: Iterable[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield _rows(part)
            part = []
    if part:
        yield _rows(part)


def _fold(held_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[bytes, dict[bytes, dict]] = {}  # of a language and a term: the count in each source, at None the document frequency
        held = 0

        def given() -> Iterator[pa.RecordBatch]:
            for lang, own in stripes.items():
                yield from _batches((lang, term, stripe.pop(None), stripe) for term, stripe in own.items())
            stripes.clear()

        groups: dict[bytes, dict[bytes, int]] = {}
        for keys, texts in blocks(batches):
            for (lang, source), text in zip(keys, texts, strict=True):
                lang, source = lang.encode(), source.encode()
                groups.setdefault(lang, {})[source] = 0
                own = stripes.setdefault(lang, {})
                for term, n in Counter((text or b"").translate(TERMS).split()).items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = {None: 1, source: n}
                        held += 400 + len(term)
                    else:
                        stripe[None] += 1
                        if source in stripe:
                            stripe[source] += n
                        else:
                            stripe[source] = n
                            held += 60
                if held > held_bytes:
                    yield from given()
                    held = 0
        yield from given()
        yield from _batches((lang, None, 0, own) for lang, own in groups.items())  # a group may be without terms

    return run


def _merge(least: int):
    """Rows come sorted by language and term; one stripe is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> Iterator[tuple]:
            key, df, stripe = None, 0, {}
            for batch in batches:
                lists = [(c.offsets.to_pylist(), c.flatten()) for c in (batch.column(3), batch.column(4))]
                at, sources, counts = lists[0][0], lists[0][1].cast(pa.binary()).to_pylist(), lists[1][1].to_pylist()
                first = at[0]
                columns = (batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())
                for i, (lang, term, n) in enumerate(zip(*columns, strict=True)):
                    if (lang, term) != key:
                        if key and (key[1] is None or df >= least):
                            yield *key, df, stripe
                        key, df, stripe = (lang, term), 0, {}
                    df += n
                    for j in range(at[i] - first, at[i + 1] - first):
                        stripe[sources[j]] = stripe.get(sources[j], 0) + counts[j]
            if key and (key[1] is None or df >= least):
                yield *key, df, stripe

        yield from _batches(merged())

    return run


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 1) / total), exactly, for totals below 9 * 10**15: three decimal digits at a time."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def _diverge(top: int):
    def run(stripes: pa.Table, facts: pa.Table) -> pa.Table:
        lang, names, held, v = (facts.column(c)[0] for c in ("of", "sources", "counts", "v"))
        names, held, v = names.values, held.values.to_numpy().astype(np.int64), v.as_py()
        total = held + v
        terms = stripes.filter(pc.is_valid(stripes.column("term"))).combine_chunks()
        terms = terms.take(pc.sort_indices(terms.column("term"))) if terms.num_rows else terms
        pair, out = np.zeros((len(names), len(names)), np.int64), []
        step = max(1, CELLS // len(names))
        best: list[list[np.ndarray]] = [[] for _ in range(len(names))]
        for a in range(0, terms.num_rows, step):
            part = terms.slice(a, step).combine_chunks()
            lists, numbers = (part.column(c).combine_chunks() for c in ("sources", "counts"))
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
            count = np.zeros((part.num_rows, len(names)), np.int64)
            count[row, pc.index_in(lists.flatten(), value_set=names).to_numpy()] = numbers.flatten().to_numpy()
            p, q = shares(count, total[None, :]), shares(count.sum(axis=1), held.sum() + v)
            for i in range(len(names)):
                pair[i] += ((p[:, i, None] - p) ** 2 // p).sum(axis=0)
                at = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
                best[i].append(np.stack([at + a, (p[at, i] - q[at]) ** 2 // q[at]]))
        for i, name in enumerate(names.to_pylist()):
            others = [j for j in range(len(names)) if j != i]
            out.append(("pair", name, [names[j].as_py() for j in others], pair[i, others]))
            if best[i]:
                at, f = np.concatenate(best[i], axis=1)
                first = np.argsort(-f, kind="stable")[:top]  # of equals the first in order of bytes
                out.append(("term", name, terms.column("term").take(pa.array(at[first])).to_pylist(), f[first]))
        n = [len(x[2]) for x in out]
        return pa.table({
            "lang": pa.array([lang.as_py()] * sum(n), pa.string()), "source": pa.array(np.repeat(np.array([x[1] for x in out], object), n), pa.string()), "part": pa.array(np.repeat(np.array([x[0] for x in out], object), n), pa.string()),
            "item": pa.array([i for x in out for i in x[2]], pa.string()), "value": pa.array(np.concatenate([x[3] for x in out]), pa.int64()),
        })

    return run


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top: int = 200, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source of a language how far its terms are from each other source's
    (part `pair`), and the `top` terms that it has more of than the language (part `term`).

    A language keeps the terms of at least `least_docs` of its documents. A group's share of a term is a whole number of
    billionths, one added to each count, so that a term it lacks has one too; the divergence of a term is the squared
    difference of two shares over the second, rounded down. Rank goes by value, then by the item's bytes.

    Nulls in text, language or source are read as ''. A language without kept terms gives its pairs with value 0; a group
    with an empty text, or a source that is alone, counts all the same. Very long texts are taken whole; every one of
    repeated rows counts as a document; other columns are left out, whatever their names; an empty table gives an empty one.

    A term that every document holds is one stripe of each task, whatever its documents; merging reads the stripes of a
    term in order and holds one. Merged stripes of a language are dealt by a hash in groups of some GROUP_ENTRIES counts,
    and each group meets the totals of that language alone. The result has a row for each ordered pair of sources of a
    language, so a call holds that many sums; a hot source or language is split like any other."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, text_col, source_col)]
    folded = docs.select(read[0].alias("lang"), read[1].alias("text"), read[2].alias("source")).mapInArrow(_fold(held_bytes), STRIPE)
    kept = staged(folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least_docs), STRIPE))
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("term").alias("v"), (F.sum(F.size("sources")) / GROUP_ENTRIES).cast("long").alias("deals"))
    totals = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("own")).join(sizes, "lang")
    facts = totals.select(F.col("lang").alias("of"), F.col("own.source").alias("sources"), F.col("own.n").alias("counts"), "v", "deals", F.explode(F.sequence(F.lit(0).cast("long"), "deals")).alias("at"))
    dealt = kept.join(sizes.select("lang", "deals"), "lang").withColumn("deal", F.pmod(F.xxhash64("term"), F.col("deals") + 1)).select("lang", "deal", "term", "sources", "counts")
    parts = "lang string, source string, part string, item string, value long"
    found = staged(dealt.groupBy("lang", "deal").cogroup(facts.groupBy("of", "at")).applyInArrow(_diverge(top), parts))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence audit of the whole documents table."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
words as (select lang, source, i, unnest(w) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct i) >= 3),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
n as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint as n from groups g left join counts using (lang, source) group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (n.n + v.v) as p
  from groups g join n using (lang, source) join v using (lang) join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c) + 1)) // (nl.n + v.v) as q
  from p join v using (lang) join (select lang, sum(n) as n from n group by lang) nl using (lang) group by lang, term, nl.n, v.v),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as other, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
    on f.lang = a.lang and f.source = a.source and f.other = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where c > 0 and p > q),
every as (select * from pair union all select * from term)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every
qualify part = 'pair' or rank <= 200
"""
