"""Arrow functions on a batch's distinct names and values: how even the bytes of a value are, and what the words of a name say."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import CONFIG_TERMS, NEVER_PUBLIC, PUBLIC_PREFIX, SECRET_TERMS, WEAK_TERMS

ROWS = 2048  # histograms held at once

SINGLE = frozenset(t for t in SECRET_TERMS if "_" not in t)
LONG = [t for t in SINGLE if len(t) >= 4]
STRONG, WEAK = ({w: kind for kind, words in table.items() for w in words.split()} for table in (CONFIG_TERMS, WEAK_TERMS))
NEVER = frozenset(NEVER_PUBLIC)
FLAGS = ("secret", "known", "long", "public")
EVENNESS = T.StructType([T.StructField("distinct", T.IntegerType()), T.StructField("entropy", T.DoubleType())])
DECIDES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("weak", T.BooleanType())]))
READING = T.StructType([T.StructField("decides", DECIDES), *(T.StructField(c, T.BooleanType()) for c in FLAGS)])


def histogram_facts(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct bytes, Shannon entropy in bits per byte) of each value, from one histogram of bytes a value."""
    distinct, entropy = np.zeros(len(values), np.int32), np.zeros(len(values))
    for a in range(0, len(values), ROWS):
        part = values[a : a + ROWS]
        size = np.fromiter(map(len, part), np.int64)
        owner = np.repeat(np.arange(len(part)), size)
        counts = np.bincount(owner * 256 + np.frombuffer(b"".join(part), np.uint8), minlength=256 * len(part))
        at = np.flatnonzero(counts)
        share = counts[at] / size[at // 256]
        distinct[a : a + ROWS] = np.bincount(at // 256, minlength=len(part))
        entropy[a : a + ROWS] = np.bincount(at // 256, -share * np.log2(share), minlength=len(part))
    return distinct, entropy


@F.arrow_udf(EVENNESS)
def evenness(values: pa.Array) -> pa.Array:
    coded = values.cast(pa.large_binary()).fill_null(b"").dictionary_encode()
    distinct, entropy = histogram_facts(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy()
    return pa.StructArray.from_arrays([pa.array(distinct[at]), pa.array(entropy[at])], names=["distinct", "entropy"])


def words_of(name: str) -> list[str]:
    """Upper-case words of a name: cut at marks and at changes of case."""
    cut = re.sub("([A-Z])([A-Z][a-z])", "\\1\u0001\\2", re.sub("([a-z0-9])([A-Z])", "\\1\u0001\\2", name))
    return [w.upper() for w in re.split("\u0001|[_\\-./: \\t]", cut) if w]


def terms_of(name: str) -> list[str]:
    """Candidate terms from the right: at each word the pair with the word before it, then the word itself, a plural secret word as one."""
    words, out = words_of(name), []
    for i in range(len(words) - 1, -1, -1):
        w = words[i]
        out += ([f"{words[i - 1]}_{w}"] if i else []) + [w[:-1] if len(w) > 3 and w[-1] == "S" and w[:-1] in SINGLE else w]
    return out


def _read(name: str) -> dict:
    found = terms_of(name)
    decides: list[dict] = []
    for t in found:
        if t in SECRET_TERMS:
            decides.append({"kind": "secret", "weak": False})
        else:
            decides += [{"kind": table[t], "weak": weak} for table, weak in ((STRONG, False), (WEAK, True)) if t in table]
    secret = any(d["kind"] == "secret" for d in decides)
    public = re.search(PUBLIC_PREFIX, name) is not None and not NEVER.intersection(found)
    return {"decides": decides, "secret": secret, "known": bool(decides), "long": any(t in name.upper() for t in LONG), "public": public}


@F.arrow_udf(READING)
def reading(names: pa.Array) -> pa.Array:
    """What each name says: its terms that decide, from the right, and whether any is secret, known, long within a word, or opened by a public prefix."""
    coded = names.fill_null("").dictionary_encode()
    kind = pa.struct([("decides", pa.list_(pa.struct([("kind", pa.string()), ("weak", pa.bool_())]))), *((c, pa.bool_()) for c in FLAGS)])
    return pa.array(list(map(_read, coded.dictionary.to_pylist())), kind).take(coded.indices)


def verdict(read: Column, fits: Column) -> Column:
    """secret, config-kind or silent: the rightmost term that decides; then any secret word; then a long secret word within the name.

    `read`: the name's `reading`; `fits`: the kinds that the value agrees with. A setting's term decides if the value is of
    its kind, a weak one only in a name without a secret word."""
    rules = F.filter(read["decides"], lambda d: (d["kind"] == "secret") | (F.array_contains(fits, d["kind"]) & ~(d["weak"] & read["secret"])))
    first = F.get(rules, 0)["kind"]
    named = F.when(first == "secret", "secret").when(first.isNotNull(), F.concat(F.lit("config-"), first))
    return F.coalesce(named, F.when(read["secret"], "secret"), F.when(read["known"], "silent"), F.when(read["long"], "secret"), F.lit("silent"))
