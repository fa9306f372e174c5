"""Quality rules: base counts, then Jensen-Shannon distances of character-class and common-word histograms to language references."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, staged, sums, table

#: Common words of four languages; a text's other words share one further cell.
COMMON = {
    "en": "the of and to in is that for it with as on are this be at by not have from or an they which you were her all their one".split(),
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au avec ce il elle par plus ou son sont nous mais".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem es an werden aus er hat dass sie".split(),
    "es": "el la los las de y en que un una es por con no para su al lo como más pero se del ha fue este ser son entre".split(),
}
CLASSES = ("vowel", "consonant", "upper", "digit", "blank", "newline", "stop", "symbol", "two-byte", "longer")
MAX_LANGUAGES = 256


def _class_of() -> np.ndarray:
    """Class of the character that each lead byte begins; continuation bytes are one past the last class."""
    out = np.full(256, len(CLASSES), np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c in "aeiou" else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".,;:!?'\"()-" else 7
    out[0xC0:0xE0], out[0xE0:] = 8, 9
    return out


def repeated_words(numbers: np.ndarray) -> int:
    """How many words lie in 3-word windows that occur twice or more in the text."""
    if len(numbers) < 4:
        return 0
    top = int(numbers.max()) + 1
    pairs = np.unique(numbers[:-1] * top + numbers[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * top + numbers[2:], return_inverse=True, return_counts=True)
    often = n[at] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : len(often) + k] |= often
    return int(covered.sum())


def _measure(common: list[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, n_classes = _class_of(), len(CLASSES) + 1
        symbol, white = np.zeros(256, bool), np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")], white[[32, *range(9, 14)]] = True, True
        cell = {w: i for i, w in enumerate(common)}
        for keys, texts in blocks(batches):
            texts = [t or b"" for t in texts]
            size = np.fromiter(map(len, texts), np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            owner = np.repeat(np.arange(len(texts)), size)
            classes = np.bincount(owner * n_classes + class_of[data], minlength=len(texts) * n_classes).reshape(-1, n_classes)[:, :-1]
            blanks = sums(white[data].view(np.uint8), size)
            base, hist = [], []
            for text in texts:
                words = text.split()
                seen: dict[bytes, int] = {}
                numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
                lines, earlier = 0, set()
                if b"\n" in text:
                    for line in text.split(b"\n"):
                        if line in earlier:
                            lines += bool(line.strip())
                        else:
                            earlier.add(line)
                base.append((len(words), lines, repeated_words(numbers)))
                hist.append(np.bincount(np.fromiter((cell.get(w, len(common)) for w in text.lower().split()), np.int64, len(words)), minlength=len(common) + 1))
            n = np.array(base, np.int64).reshape(-1, 3)
            counts = np.concatenate([classes, np.array(hist).reshape(len(texts), -1)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array(n[:, 0]), pa.array(classes.sum(axis=1) - blanks), pa.array(sums(symbol[data].view(np.uint8), size)), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array([c.tobytes() for c in counts], pa.binary())],
                names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "counts"],
            )

    return run


def _counts(column) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int32)


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            counts, langs = _counts(batch.column(1)), np.array(batch.column(0).to_pylist())
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + counts[langs == lang].sum(axis=0, dtype=np.int64)
    for lang, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["lang", "cell", "n"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of `p` to each row of `q`, both histograms of counts."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    plog = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0.0)
    out = np.stack([plog((p + r) / 2).sum(axis=1) for r in q], axis=1) if len(q) else np.zeros((len(p), 0))
    return np.sqrt(np.maximum(0, (plog(p).sum(axis=1)[:, None] + plog(q).sum(axis=1)[None, :]) / 2 - out))


def _judge(references, max_class: float, max_words: float, min_chars: int, min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, k = references.value, len(CLASSES)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = _counts(batch.column("counts")).astype(np.float64)
            n_words, n_repeat = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            far, apart = js_distance(counts[:, :k], ref[:, :k]), js_distance(counts[:, k:], ref[:, k:])
            nearest = (far + apart).argmin(axis=1) if len(ref) else np.zeros(len(counts), np.int64)
            far, apart = (x[np.arange(len(x)), nearest] if len(ref) else np.zeros(len(x)) for x in (far, apart))
            far, apart = np.where(counts[:, :k].sum(axis=1) >= min_chars, far, 0.0), np.where(n_words >= min_words, apart, 0.0)
            failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
            kept = ~failed & (far <= max_class) & (apart <= max_words)
            columns = [batch.column(c) for c in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept), pa.array(far), pa.array(apart)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

    return run


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = 0.25, max_words: float = 0.335, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """(id, counts, base_failed, kept, class_distance, word_distance) for each row of `docs`.

    A language's reference is the sum of the histograms of all texts with that label (all texts where none has one). A text
    is compared with its nearest reference; its own label plays no part. Histograms of fewer than `min_chars` characters
    or `min_words` words count as distance 0. A null or empty text has no word and fails the base rules; very
    long texts are measured whole; of references at the same distance the first by name counts; every row gives one row,
    repeated ones and those with a null id too; other columns are left out, whatever their names; an empty table gives an
    empty one. The text is read once: its histogram, some 130 numbers, is staged."""
    common = [w.encode() for w in dict.fromkeys(w for ws in COMMON.values() for w in ws)]
    schema = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, counts binary"
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = staged(docs.select(F.col(id_col).cast("long"), text_col, lang).mapInArrow(_measure(common), schema))
    total = rows.select("lang", "counts").mapInArrow(_total, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for lang_of, cell, n in total.limit((MAX_LANGUAGES + 1) * (len(CLASSES) + len(common) + 1) + 1).collect():
        found.setdefault(lang_of, np.zeros(len(CLASSES) + len(common) + 1))[cell] = n
    if len(found) > MAX_LANGUAGES + 1:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    named = [found[k] for k in sorted(found) if k] or list(found.values())
    references = docs.sparkSession.sparkContext.broadcast(np.array(named).reshape(len(named), len(CLASSES) + len(common) + 1))
    out = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return rows.mapInArrow(_judge(references, max_class, max_words, min_chars, min_words), out)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on the whole documents table."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
