"""SimHash near-dedup: fingerprints of word shingles, linked through pivot distance tables, grouped into components."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, join_facts, mix, staged, sums, table

SMALL = 32  # groups up to this size are compared by shifting the sorted rows


def _fingerprints(width: int, seed: int, n_words: int):
    def count(hashes: np.ndarray, word: int) -> np.ndarray:
        hashes = mix(hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)) if word else hashes
        return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def ones(parts: list[np.ndarray], n: np.ndarray, word: int) -> np.ndarray:
        if n.sum() <= 1_000_000:
            return sums(count(np.concatenate(parts), word), n)
        # a very long text: its bits are added up piece by piece
        return np.array([sum((count(p[k : k + 200_000], word).sum(axis=0, dtype=np.int64) for k in range(0, len(p), 200_000)), np.zeros(64, np.int64)) for p in parts])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            parts = []
            for text in texts:
                words = (text or b"").lower().split()
                grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)] if words else []
                parts.append(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64))
            n = np.fromiter(map(len, parts), np.int64)
            bits = np.concatenate([2 * ones(parts, n, k) > n[:, None] for k in range(n_words)], axis=1)
            prints = np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(">u8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in prints], pa.binary())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, n_words: int = 1) -> DataFrame:
    """(id, fp): SimHash of 64 * `n_words` bits, each word big-endian, over the XXH64 of `width`-word shingles of the
    ASCII-lower-cased text, repeats included; the second and later words scramble the same hashes.

    A bit is set if more than half of the shingle hashes have it. Fewer words than `width` make one shingle; no word,
    an empty or a null text give 0. Every row gives one row."""
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_fingerprints(width, seed, n_words), "id long, fp binary")


def pivot_fingerprints(n: int) -> np.ndarray:
    """`n` fixed reference fingerprints."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint, all words added up."""
    far = np.zeros((len(fps), len(pivots)), np.int16)
    for word in range(fps.shape[1]):
        far += np.bitwise_count(fps[:, word, None] ^ pivots[None, :])
    return far


class Sets:
    """Union-find over the few ids that have a link; the root is the smallest id."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            x, up[x] = up.get(x, x), root
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _close(i: np.ndarray, j: np.ndarray, fps: np.ndarray, far: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (i, j) are within `radius`: the largest difference of their pivot distances may not exceed it; survivors are verified."""
    at = np.flatnonzero(np.abs(far[i] - far[j]).max(axis=1) <= radius)
    return at[np.bitwise_count(fps[i[at]] ^ fps[j[at]]).sum(axis=1, dtype=np.int64) <= radius]


def link_groups(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int, pivots: np.ndarray) -> Sets:
    """Links within each run of equal keys, as sets of ids.

    Small groups: the rows are shifted against each other. Large ones: a search from row to row that never compares a
    row again once it has joined a set, so that a dense group of near copies costs little more than its size."""
    found, far = Sets(), distance_table(fps, pivots)
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.repeat(np.diff(edges), np.diff(edges))
    for s in range(1, SMALL):
        i = np.flatnonzero((keys[:-s] == keys[s:]) & (size[:-s] <= SMALL)) if s < len(keys) else np.empty(0, np.int64)
        if not len(i):
            break
        for a in i[_close(i, i + s, fps, far, radius)]:
            found.join(int(ids[a]), int(ids[a + s]))
    for g in np.flatnonzero(np.diff(edges) > SMALL):
        rest = np.arange(edges[g], edges[g + 1])
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                a = todo.pop()
                near = _close(np.full(len(rest), a), rest, fps, far, radius)
                if len(near):
                    for b in rest[near]:
                        found.join(int(ids[a]), int(ids[b]))
                    todo += rest[near].tolist()
                    rest = np.delete(rest, near)
    return found


def words_of(prints: pa.Array) -> np.ndarray:
    """A row of unsigned 64-bit words for each fingerprint."""
    data = b"".join(prints.to_pylist())
    return np.frombuffer(data, ">u8").reshape(len(prints), -1).astype(np.uint64)


def _choices(prints: np.ndarray, radius: int, n_blocks: int) -> np.ndarray:
    """Keys of all choices of n_blocks - radius blocks of a 64-bit fingerprint; a pair within `radius` shares one at least."""
    cuts = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    block = [(prints[:, 0] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(range(n_blocks), n_blocks - radius)):
        key = np.full(len(prints), n, np.uint64)
        for k in chosen:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + block[k] + np.uint64(1))
        keys.append(key)
    return np.stack(keys, axis=1)


def _bands(prints: np.ndarray) -> np.ndarray:
    """Keys of the bands of 16 bits."""
    bands = prints.view("<u2").astype(np.uint64)
    return mix(bands + (np.arange(1, bands.shape[1] + 1, dtype=np.uint64) << np.uint64(16))[None, :])


def _deal(radius: int, n_blocks: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(k, 5000) for k in range(0, batch.num_rows, 5000)):
                prints = words_of(piece.column(1))
                keys = _choices(prints, radius, n_blocks) if n_blocks else _bands(prints)
                row = np.repeat(np.arange(len(prints)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), piece.column(1).take(pa.array(row)), piece.column(0).take(pa.array(row))], names=["key", "fp", "id"])

    return run


def _link(radius: int, n_pivots: int):
    def linked(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        sets = link_groups(keys, prints, ids, radius, pivot_fingerprints(n_pivots))
        pairs = [(x, sets.find(x)) for x in list(sets.up)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(0).to_numpy(), words_of(batch.column(1)), batch.column(2).to_numpy()]
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0  # the last key may go on in the next batch
            if cut:
                yield linked(*(x[:cut] for x in rows))
            kept = [x[cut:] for x in rows]
        if kept:
            yield linked(*kept)

    return run


MOST_HOT = 100_000  # keys, some 2 MB


def parted(rows: DataFrame, part_rows: int) -> DataFrame:
    """(key, fp, id) with keys of more than `part_rows` rows cut into parts of about that size by a hash of the id: any two
    parts of a key meet under a key of their own, so each pair of rows still meets, and no group has many more than two parts.

    The table of such keys is counted first: at most MOST_HOT of them are broadcast, more meet the rows in a plain join, whose
    large partitions Spark splits."""
    hot = rows.groupBy("key").count().where(F.col("count") > part_rows).select("key", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    hot = staged(hot)
    table = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: t != F.col("mine"))
    met = F.transform(others, lambda t: F.xxhash64("key", F.least("mine", t), F.greatest("mine", t)))
    keys = F.when(F.col("parts").isNull(), F.array("key")).otherwise(met)
    return rows.join(table, "key", "left").withColumn("mine", mine).select(F.explode(keys).alias("key"), "fp", "id")


def near_links(prints: DataFrame, radius: int = 4, n_blocks: int | None = 6, n_pivots: int = 16, part_rows: int = 4096) -> DataFrame:
    """(src, dst) with dst < src: links between ids whose distinct fingerprints are within `radius` bits.

    `prints`: (id, fp), each fp once. With `n_blocks`, for one word of 64 bits: two fingerprints that differ in `radius`
    bits agree in n_blocks - radius blocks at least, so rows that share such a choice of blocks meet in one partition,
    and the components are exactly those of all pairs. With None: rows meet that share a band of 16 bits, for which a
    long fingerprint is needed; pairs well within the radius share one almost surely. Where rows meet, the pivot tables
    discard pairs and the survivors are verified. A group of near copies sends a spanning forest, never all pairs.
    Keys of more than `part_rows` rows are dealt in parts, so that no task holds a whole hot key."""
    if n_blocks and not radius < n_blocks <= 64:
        raise ValueError("n_blocks must exceed radius")
    rows = parted(prints.select("id", "fp").mapInArrow(_deal(radius, n_blocks), "key long, fp binary, id long"), part_rows)
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link(radius, n_pivots), "src long, dst long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    Alternates large-star and small-star steps until no link changes; every step is a minimum per id, added up before the
    shuffle, and a join in which the links of a hub meet a broadcast row. Each step is written to the shared folder."""
    edges = staged(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before, n_edges = None, edges.count()
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")).select("src", F.least("src", "m").alias("m"), "n")
        large = join_facts(both, least, ["src"], "dst", 2 * n_edges).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"))
        small = join_facts(large, down, ["src"], "dst", n_edges).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        small = small.union(down.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        edges = staged(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        n_edges = now[0]
        if now == before:
            return edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        before = now


def blocks_for(rows: int, radius: int) -> int:
    """How many blocks to cut a 64-bit fingerprint into: the fewest whose keys are some bits longer than the row count, so that
    unlike rows seldom meet at any size."""
    need = rows.bit_length() + 2
    return next((b for b in range(radius + 1, 3 * radius + 3) if 64 * (b - radius) // b >= need), 3 * radius + 2)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42, n_words: int = 1) -> DataFrame:
    """(id, fp, component) for every row of `docs`: the smallest id of all documents that links of at most `radius`
    differing bits lead to, its own included.

    A pair is linked wherever it meets, so ties need no rule; very long texts are hashed in pieces; other columns are left out,
    whatever their names. Texts with one fingerprint are first gathered under their smallest id, so that exact copies cost one row. Rows with
    a null id get a null component; repeated rows of an id give repeated rows, and the texts of one id are tied
    together where it is the smallest of a fingerprint; an empty table gives an empty one."""
    prints = staged(fingerprints(docs, id_col, text_col, width, seed, n_words))
    heads = staged(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("head")))
    found = components(near_links(heads.select(F.col("head").alias("id"), "fp"), radius, blocks_for(heads.count(), radius) if n_words == 1 else None))
    labels = heads.join(found.withColumnRenamed("id", "head"), "head", "left").select("fp", F.coalesce("component", "head").alias("component"))
    return prints.join(labels, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


LEVEL_BITS = 22  # of a shingle's hash: so many counts, 4 MB, say how frequent it is about
MET_BITS = 26  # of a shingle's hash: so many bits, 8 MB, say whether another set may hold it too
CHUNKS = 64
PARITIES = 8  # words of 64 bits that bound how many shingles of two sets differ


def _shingles(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; fewer words than `width` make one, none make none."""
    words = (text or b"").lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) > width else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64))


def _name(shingles: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed=seed)).view(np.int64))


def _counted(width: int, seed: int):
    """(chunk, counts): how many shingles of a task's texts begin with each value of LEVEL_BITS bits, a byte each, in chunks of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LEVEL_BITS, np.int32)
        for _, texts in blocks(batches):
            for text in texts:
                np.add.at(counts, _shingles(text, width, seed) >> np.uint64(64 - LEVEL_BITS), 1)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(CHUNKS, -1)
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[k].tobytes() for k in held], pa.binary())], names=["chunk", "counts"])

    return run


def _levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, levels): the sums of the counts, eight levels for each doubling."""
    sums_: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(counts, np.uint8).astype(np.int64)
            sums_[chunk] = sums_[chunk] + own if chunk in sums_ else own
    for chunk, own in sums_.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.minimum(8 * np.log2(1 + own), 255).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "levels"])


def _joined(parts: DataFrame, n_bytes: int):
    """The chunks (chunk, bytes) of a table of `n_bytes` bytes, as a broadcast."""
    table = np.zeros((CHUNKS, n_bytes // CHUNKS), np.uint8)
    for chunk, data in parts.collect():
        table[chunk] = np.frombuffer(data, np.uint8)
    return parts.sparkSession.sparkContext.broadcast(table.ravel())


def _prefixes(width: int, seed: int, similarity: float, levels):
    """(id, fp, size, keys): the name of each text's shingle set, its size, and the first 1 - similarity of its shingles, in one
    order for all texts: by level, so that rare ones come first, and by hash. Two sets of that similarity share one of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            sets = [(i, x) for i, x in zip(ids, (_shingles(t, width, seed) for t in texts), strict=True) if len(x)]
            first = [x[np.argsort(levels.value[x >> np.uint64(64 - LEVEL_BITS)], kind="stable")[: len(x) - int(np.ceil(len(x) * similarity - 1e-9)) + 1]].view(np.int64) for _, x in sets]
            columns = [pa.array([i for i, _ in sets], pa.int64()), pa.array([_name(x, seed) for _, x in sets], pa.int64()), pa.array([len(x) for _, x in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "size", "keys"])

    return run


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bits) of (chunk, key): a bit for each value of MET_BITS bits of the keys."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        chunks, slots = batch.column(0).to_numpy(), (batch.column(1).to_numpy() // CHUNKS) & ((1 << MET_BITS) // CHUNKS - 1)
        for chunk in np.unique(chunks).tolist():
            bits.setdefault(chunk, np.zeros((1 << MET_BITS) // CHUNKS, bool))[slots[chunks == chunk]] = True
    for chunk, own in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["chunk", "bits"])


def _met_keys(bits):
    """(key, fp, size, place) of (fp, size, keys): the keys whose bit is set, with their place from 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().to_numpy()
            keys = lists.flatten().to_numpy()
            at = (keys % CHUNKS) * ((1 << MET_BITS) // CHUNKS) + ((keys // CHUNKS) & ((1 << MET_BITS) // CHUNKS - 1))
            kept = np.flatnonzero(bits.value[at >> 3] & (128 >> (at & 7)).astype(np.uint8))
            row = np.repeat(np.arange(len(n)), n)[kept]
            place = kept - (np.cumsum(n) - n)[row] + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place.astype(np.int32))], names=["key", "fp", "size", "place"])

    return run


def _named_sets(width: int, seed: int):
    """(fp, shingles) of the texts whose shingle set has the name that is asked for; rows of one id may have several texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted, texts in blocks(batches):
            sets = [(w, x) for w, x in zip(wanted, (_shingles(t, width, seed) for t in texts), strict=True) if _name(x, seed) == w]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in sets], pa.int64()), pa.array([x.view(np.int64) for _, x in sets], pa.list_(pa.int64()))], names=["fp", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have that Jaccard similarity or more."""
    one, two = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(s)) for c, s in (("src", "a"), ("dst", "b")))
    both = F.size(F.array_intersect("a", "b"))
    # rounding in the product may not part pairs exactly at the limit
    return pairs.join(one, "src").join(two, "dst").where(both >= similarity * (F.size("a") + F.size("b") - both) - 1e-9).select("src", "dst")


def _enough(similarity: float) -> Column:
    """Whether two sets may have the similarity whose first shared shingle has these places: what stands behind it in either must do."""
    behind = 1 + F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    return behind >= (F.col("size") + F.col("size2")) * (similarity / (1 + similarity)) - 1e-9


def _may_have_others(rows: DataFrame, total: int, similarity: float) -> DataFrame:
    """(fp, component) of the sets that may be similar to one of another component, by bounds on all of a shingle that are near in
    size; of (key, fp, component, size, place). No pair is made."""
    near = rows.withColumn("step", F.floor(F.log("size") / F.lit(math.log(1 / similarity) + 1e-6)))  # similar sets are one step apart at most
    facts = near.groupBy("key", "step").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("size").alias("size2"), F.max(F.col("size") - F.col("place")).alias("behind2"), F.count("*").alias("n"))
    reach = facts.withColumn("by", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).groupBy("key", (F.col("step") + F.col("by")).alias("step")).agg(
        F.min("x").alias("x"), F.max("y").alias("y"), F.min("size2").alias("size2"), F.max("behind2").alias("behind2"), F.sum(F.when(F.col("by") == 0, F.col("n")).otherwise(0)).alias("n")
    )
    behind = 1 + F.least(F.col("size") - F.col("place"), F.col("behind2"))
    met = join_facts(near, reach, ["key", "step"], "fp", total)
    return met.where(((F.col("x") != F.col("component")) | (F.col("y") != F.col("component"))) & (behind >= (F.col("size") + F.col("size2")) * (similarity / (1 + similarity)) - 1e-9)).select("fp", "component").distinct()


def _with_sets(sets: DataFrame | None, asked: DataFrame, own: DataFrame, texts: DataFrame, width: int, seed: int) -> DataFrame:
    """`sets` (fp, shingles) with those that are asked for; only their texts are hashed again, for the sets of all would be larger than the texts."""
    asked = asked.select("fp").distinct()
    heads = own.join(asked if sets is None else asked.join(sets, "fp", "left_anti"), "fp", "left_semi").select("fp", "id")
    more = staged(heads.join(texts, "id").select("fp", "text").mapInArrow(_named_sets(width, seed), "fp long, shingles array<long>").dropDuplicates(["fp"]))
    return more if sets is None else sets.union(more)


def _parities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, p0, p1 ...) of (fp, shingles): each shingle flips one of 64 * PARITIES bits, so two sets differ in as many shingles at least as in bits."""
    for batch in batches:
        for piece in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
            n, flat = piece.column(1).value_lengths().to_numpy(), piece.column(1).flatten().to_numpy().view(np.uint64)
            slots = np.repeat(np.arange(len(n)), n) * (64 * PARITIES) + (mix(flat) % np.uint64(64 * PARITIES)).astype(np.int64)
            odd = (np.bincount(slots, minlength=len(n) * 64 * PARITIES) & 1).astype(np.uint8).reshape(len(n), -1)
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(words[:, k]) for k in range(PARITIES))], names=["fp", *(f"p{k}" for k in range(PARITIES))])


def _may_be_similar(sets: DataFrame, similarity: float) -> DataFrame:
    """(fp, fp2) of different components that may have the similarity, of (fp, component, shingles): a bound, no pair is lost.

    With the shingles of each set in one order, the rarest among these sets first, two similar sets share one of the first
    1 - similarity of both, and what stands behind the first shared one in either set is enough for the overlap that is
    called for. Texts that are alike but not similar differ in rare shingles, which come first, so few of them meet; of those
    that do, the parities of the sets part most."""
    own = sets.select("fp", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    counts = own.groupBy("key").agg(F.count("*").alias("n")).withColumn("rarity", F.col("n"))
    total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    ranked = join_facts(own, counts, ["key"], "fp", total)
    place = F.row_number().over(Window.partitionBy("fp").orderBy("rarity", "key"))
    first = ranked.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1)
    words = [f"p{k}" for k in range(PARITIES)]
    marks = sets.select("fp", "shingles").mapInArrow(_parities, "fp long, " + ", ".join(f"{w} long" for w in words))
    first = staged(first.join(marks, "fp").select("key", "fp", "component", "size", "place", *words))
    a, b = first.alias("a"), first.select("key", *(F.col(c).alias(c + "2") for c in ("fp", "component", "size", "place", *words))).alias("b")
    differ = reduce(add, (F.bit_count(F.col(w).bitwiseXOR(F.col(w + "2"))) for w in words))
    close = differ <= (F.col("size") + F.col("size2")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("component") < F.col("component2")) & _enough(similarity) & close).select("fp", "fp2")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42, stars: int = 2) -> DataFrame:
    """(id, component) of each row with an id and a word: the smallest id of all documents that links lead to, a link being
    a Jaccard similarity of at least `similarity` of two sets of `width`-word shingles. No link is lost.

    Two such sets share one of the first 1 - `similarity` of their shingles, in any order that is the same for all texts. Here
    rare ones come first, by a table of counts of fixed size that every text adds to, so that few unlike texts meet. Equal
    sets are one row. In the first rounds the texts of a shingle are compared with one of them, another in each shingle and
    round; then, of texts that may yet have a link, the pairs that `_may_be_similar` leaves. The sets themselves decide. So a dense group costs about its size. Groups meet in joins and partial sums alone, never whole in one task."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    counts = texts.mapInArrow(_counted(width, seed), "chunk int, counts binary")
    levels = _joined(counts.repartition("chunk").mapInArrow(_levels, "chunk int, levels binary"), 1 << LEVEL_BITS)
    rows = staged(texts.mapInArrow(_prefixes(width, seed, similarity, levels), "id long, fp long, size int, keys array<long>"))
    own = staged(rows.dropDuplicates(["fp"]))
    often = staged(own.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # most shingles are in one set alone: their rows need no shuffle
    bits = _joined(often.select(F.pmod("key", F.lit(CHUNKS)).cast("int").alias("chunk"), "key").repartition("chunk").mapInArrow(_marked, "chunk int, bits binary"), (1 << MET_BITS) // 8)
    met = own.select("fp", "size", "keys").mapInArrow(_met_keys(bits), "key long, fp long, size int, place int")
    members = staged(join_facts(met, often, ["key"], "fp", own.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]))
    n_members, tested, sets, links, found = members.count(), None, None, None, None
    for turn in range(stars + 1):
        if found is None:
            now = members.withColumn("component", F.col("fp"))
        else:
            now = members.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(*members.columns, F.coalesce("component", "fp").alias("component"))
        if turn < stars:
            one = F.min_by(F.struct("fp", "component", "size", "place"), F.xxhash64("fp", "key", F.lit(turn)))
            other = now.groupBy("key").agg(one.alias("h"), F.count("*").alias("n")).select("key", *(F.col(f"h.{c}").alias(c + "2") for c in ("fp", "component", "size", "place")), "n")
            near = join_facts(now, other, ["key"], "fp", n_members).where((F.col("component") != F.col("component2")) & _enough(similarity))
        else:
            # groups whose members are all linked are done
            open_keys = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
            left = staged(_may_have_others(join_facts(now, open_keys, ["key"], "fp", n_members), n_members, similarity))
            sets = _with_sets(sets, left, own, texts, width, seed)
            near = _may_be_similar(staged(left.join(sets, "fp")), similarity)
        pairs = near.select(F.greatest("fp", "fp2").alias("src"), F.least("fp", "fp2").alias("dst")).distinct()
        pairs = staged(pairs.join(tested, ["src", "dst"], "left_anti") if tested is not None else pairs)
        tested = pairs if tested is None else tested.union(pairs)
        sets = _with_sets(sets, pairs.select(F.col("src").alias("fp")).union(pairs.select("dst")), own, texts, width, seed)
        new = staged(_verified(pairs, sets, similarity))
        links = new if links is None else links.union(new)
        found = components(links)
    named = staged(rows.select("id", "fp").join(found.withColumnRenamed("id", "fp"), "fp", "left").select("id", F.coalesce("component", "fp").alias("group")))
    return join_facts(named, named.groupBy("group").agg(F.min("id").alias("component"), F.count("*").alias("n")), ["group"], "id", named.count()).select("id", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each group left, the one with the smallest id; rows with a null id and texts without
    words (null, empty, blank) stay. Two texts are near duplicates if their sets of `width`-word shingles have that Jaccard
    similarity. Very long texts count whole; repeated rows of an id stay or go together; all columns stay, whatever their
    names; an empty table gives an empty one."""
    out = similar_groups(docs, id_col, text_col, width, similarity).where("id <> component").select(F.col("id").alias("near_id")).distinct()
    return docs.join(out, docs[id_col].cast("long") == out["near_id"], "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components over the whole documents table."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
