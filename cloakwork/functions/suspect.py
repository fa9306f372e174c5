"""Why a value that stays open deserves a second look."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import alphabet, is_identifier, is_path, listed, parts_of, stripped

# How vendors' credentials begin.
VENDOR_STARTS = "sk- sk_live_ sk_test_ rk_live_ rk_test_ pk_live_ npm_ xox ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- glptt- AKIA ASIA AIza SG. SK shp sq0 key- eyJ -----BEGIN".split()


def suspect_reason(value: Column) -> Column:
    """Why an open value deserves a second look, never quoting it; null if it doesn't."""
    v = stripped(value)
    n = F.octet_length(v)
    pieces = parts_of(v)
    words = is_path(v) | is_identifier(v) | ((F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(r"\A[a-z]{3,}\z")))
    token = (n >= 12) & ~v.rlike("[ \\t]") & ~F.contains(v, F.lit("://")) & alphabet(v).isNotNull() & ~words
    begins = F.exists(listed(VENDOR_STARTS), lambda s: F.startswith(v, s))
    return F.when(begins, "vendor-start").when(token & (n >= 16), "long").when(token & v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"), "mixed-case-digits")
