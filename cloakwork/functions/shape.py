"""Column expressions on the shape of a value: length, alphabet, entropy, and whether it looks random. Offsets and lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(words: list[str]) -> Column:
    """Fixed words as one array, parsed in one go: a call a word makes building a plan slow."""
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def stripped(v: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(v, r"(?U)\A\s+|\s+\z", "")


def octets(v: Column) -> Column:
    """The bytes as two hex digits each."""
    return F.regexp_extract_all(F.hex(F.encode(v, "UTF-8")), F.lit(".."), F.lit(0))


def charset(v: Column) -> Column:
    """The first that fits: empty, hex, alnum, base64, ascii, mixed."""
    return (
        F.when(v == "", "empty").when(v.rlike(r"\A[0-9a-fA-F]+\z"), "hex").when(v.rlike(r"\A[0-9A-Za-z]+\z"), "alnum")
        .when(v.rlike(r"\A[0-9A-Za-z+/=_-]+\z"), "base64").when(v.rlike(r"\A[\x00-\x7F]+\z"), "ascii").otherwise("mixed")
    )


def entropy(v: Column) -> Column:
    """Shannon entropy in bits per byte, terms added in order of size so that every run gives the same sum.

    Its work grows with the length times the distinct bytes; tables are measured by `kernels.evenness`."""
    b = octets(v)
    share = F.transform(F.array_distinct(b), lambda x: F.size(F.filter(b, lambda y: y == x)) / F.size(b))
    return F.aggregate(F.array_sort(F.transform(share, lambda p: -p * F.log2(p))), F.lit(0.0), lambda a, x: a + x)


def alphabet(v: Column) -> Column:
    """Size of the token alphabet; null for what is no token: digits alone or any other byte."""
    k = sum((F.when(v.rlike(p), n).otherwise(0) for p, n in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[+/=_-]", 5))), F.lit(0))
    return F.when(v.rlike(r"\A[0-9A-Za-z+/=_-]+\z") & v.rlike("[^0-9]"), F.when(v.rlike(r"\A([0-9a-f]+|[0-9A-F]+)\z"), 16).otherwise(k))


def least_distinct(n: Column, k: Column) -> Column:
    """Half of the distinct symbols that a random token has on average."""
    return F.floor(k * (1 - F.pow(1 - 1 / k, n)) / 2)


def least_entropy(n: Column, k: Column) -> Column:
    """Entropy that a random token of `n` symbols out of `k` falls short of once in a thousand times (Wilson and Hilferty)."""
    d = (k - 1).cast("double")
    t = 1 - 2 / (9 * d) + F.lit(3.090232) * F.sqrt(2 / (9 * d))
    return F.log2(k.cast("double")) - d * t * t * t / (2 * n * F.log(F.lit(2.0)))


def is_path(v: Column) -> Column:
    """Three parts or more between slashes, none over 64 bytes, two or more of them lower-case words, which make up half of the parts' bytes.

    In a word no letter follows a digit. Without this and that half, a long token with two slashes is a path once in 15 000 times:
    its short parts have no capital by chance."""
    parts = F.split(v, "/")
    words = F.filter(parts, lambda p: p.rlike(r"\A[a-z0-9._-]+\z") & ~p.rlike("[0-9][a-z]") & (F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= 3))
    size = lambda ps: F.octet_length(F.array_join(ps, ""))
    return (F.size(parts) >= 3) & ~F.exists(parts, lambda p: F.octet_length(p) > 64) & (F.size(words) >= 2) & (size(words) * 2 >= size(parts))


def parts_of(v: Column, split: str = "[_\\-./+=]") -> Column:
    """Pieces between the marks of `split` and at changes of case; a digit never splits by itself."""
    spaced = F.regexp_replace(F.regexp_replace(v, "([a-z0-9])([A-Z])", "$1\u0001$2"), "([A-Z])([A-Z][a-z])", "$1\u0001$2")
    return F.filter(F.split(spaced, f"\u0001|{split}"), lambda p: p != "")


def is_identifier(v: Column) -> Column:
    """Words joined by marks or case: three parts or more, none mixed, at most one single, three quarters words, long enough.

    In a name of both cases words that can be spoken make up two thirds of the bytes: with a vowel, without five consonants in a
    row, not in capitals alone. Without them a long token of letters is a name once in a million times."""
    parts = parts_of(v)
    n = F.size(parts)
    words = F.size(F.filter(parts, lambda p: F.length(F.regexp_replace(p, "[^A-Za-z]", "")) >= 3))
    size = lambda ps: F.aggregate(ps, F.lit(0), lambda a, p: a + F.octet_length(p))
    total = size(parts)
    spoken = size(F.filter(parts, lambda p: p.rlike(r"\A[A-Za-z]{3,}\z") & p.rlike("[a-z]") & p.rlike("[aeiouyAEIOUY]") & ~p.rlike("(?i)[b-df-hj-np-tv-xz]{5}")))
    return (
        (F.octet_length(v) <= 128) & (n >= 3) & F.forall(parts, lambda p: p.rlike(r"\A([A-Za-z]+|[0-9]+)\z"))
        & (F.size(F.filter(parts, lambda p: F.length(p) == 1)) <= 1) & (words * 4 >= n * 3) & (words >= 3) & (total * 2 >= n * 7)
        & (~v.rlike("[a-z]") | ~v.rlike("[A-Z]") | (spoken * 3 >= total * 2))
    )


def looks_random(v: Column, even: Column) -> Column:
    """A token of 80 bits or more that is no path or identifier and whose symbols are as even as chance makes them.

    `even`: `kernels.evenness` of the same value, so that many values are measured in one batch."""
    n, k = F.octet_length(v), alphabet(v)
    cheap = (n >= 20) & ~v.rlike("[ \\t\\n\\r]") & ~F.contains(v, F.lit("://")) & k.isNotNull()
    rest = (n * F.log2(k.cast("double")) >= 80) & (even["distinct"] >= least_distinct(n, k)) & (even["entropy"] >= least_entropy(n, k)) & ~is_path(v) & ~is_identifier(v)
    return F.coalesce(F.when(cheap, rest), F.lit(False))
