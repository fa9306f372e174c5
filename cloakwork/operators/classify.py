"""Classify key/value rows: open, partial or veiled, with the rule that decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import evenness, reading, verdict
from ..functions.names import KINDS, agrees, host_label
from ..functions.shape import looks_random, stripped
from ..functions.suspect import suspect_reason

# Shapes of vendors' credentials in order, their names, and how many leading bytes stay visible.
SHAPES = [
    (r"\AAKIA[0-9A-Z]{16}\z", "aws-access-key-id", 4),
    (r"\AASIA[0-9A-Z]{16}\z", "aws-temp-key-id", 4),
    (r"\Ask-[A-Za-z0-9_-]{20,}\z", "openai-key", 0),
    (r"\Ask_live_[A-Za-z0-9]{20,}\z", "stripe-live-key", 0),
    (r"\Ask_test_[A-Za-z0-9]{20,}\z", "stripe-test-key", 0),
    (r"\Ark_(live|test)_[A-Za-z0-9]{20,}\z", "stripe-restricted-key", 0),
    (r"\Agh[pousr]_[A-Za-z0-9]{36,}\z", "github-token", 0),
    (r"\Aglpat-[A-Za-z0-9_-]{20,}\z", "gitlab-token", 0),
    (r"\Anpm_[A-Za-z0-9]{36,}\z", "npm-token", 0),
    (r"\Axox[bpsarae]-[0-9A-Za-z-]{10,}\z", "slack-token", 0),
    (r"\Ahttps://hooks\.slack\.com/services/[^\t\n\f\r ]+\z", "slack-webhook", 0),
    (r"\Ahttps://discord\.com/api/webhooks/[^\t\n\f\r ]+\z", "discord-webhook", 0),
    (r"\Ahttps://discordapp\.com/api/webhooks/[^\t\n\f\r ]+\z", "discord-webhook", 0),
    (r"\AAIza[0-9A-Za-z_-]{35,}\z", "google-api-key", 0),
    (r"\ASG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\z", "sendgrid-key", 0),
    (r"\ASK[0-9a-fA-F]{32}\z", "twilio-signing-key", 0),
    (r"\Asq0(atp|csp|idp)-[A-Za-z0-9_-]{20,}\z", "square-token", 0),
    (r"\Ashp(at|ca|pa|ss)_[0-9a-fA-F]{32,}\z", "shopify-token", 0),
    (r"\Akey-[0-9a-fA-F]{32}\z", "mailgun-key", 0),
    (r"\AeyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\z", "jwt", 0),
    (r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----", "private-key", 0),
]
# Composite forms; the second group is the secret.
COMPOSITES = [
    ("url-password", "_password", r"\A([a-zA-Z][a-zA-Z0-9+.-]*://[^:/@\t\n\f\r ]+:)([^@/\t\n\f\r ]+)@"),
    ("connection-string-password", "_password", r"(?i)((?:\A|;)[\t\n\f\r ]*(?:password|pwd)[\t\n\f\r ]*=[\t\n\f\r ]*)([^;]+)"),
    ("bearer-token", "_token", r"(?i)\A(Bearer[\t\n\f\r ]+)([^\t\n\f\r ]+)\z"),
    ("url-query-credential", "_param", r"(?i)([?&](?:token|key|api_key|apikey|password|secret|sig|signature|access_token|auth)=)([^&\t\n\f\r #]+)"),
]
COMPOSED = r"(?i)://|password|pwd|bearer|[?&]"  # every composite value holds one of these
REFERENCE = r"\A(\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*)\z"


def ref_of(key: Column) -> Column:
    """A vault reference from a name: lower case, one underscore for each other character, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9_.-]", "_"), r"\A_+|_+\z", "")


def composite_spans(value: Column) -> Column:
    """Secret parts of composite values: (start, stop, suffix, rule), characters from 0, in the order of the forms.

    The first form to claim a stretch keeps it; a suffix that comes again is numbered from 2."""
    groups = lambda pattern, n, get: [get(value, F.lit(rf"(?s)(.*?){pattern}"), F.lit(i)) for i in range(1, n + 1)]
    found = []
    for rule, suffix, pattern in COMPOSITES[:3]:
        before, lead, secret = (F.regexp_extract(value, rf"(?s)\A(.*?){pattern}", i) for i in (1, 2, 3))
        start = F.length(before) + F.length(lead)
        found.append(F.when(secret != "", F.struct(start.alias("start"), (start + F.length(secret)).alias("stop"), F.lit(suffix).alias("suffix"), F.lit(rule).alias("rule"))))
    rule, suffix, pattern = COMPOSITES[3]
    before, lead, secret = groups(pattern, 3, F.regexp_extract_all)
    sizes = F.zip_with(F.zip_with(before, lead, lambda a, b: F.length(a) + F.length(b)), secret, lambda a, b: F.struct(a.alias("lead"), F.length(b).alias("own")))
    upto = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x["lead"] + x["own"])
    many = F.transform(sizes, lambda x, i: F.struct((upto(i) + x["lead"]).alias("start"), (upto(i) + x["lead"] + x["own"]).alias("stop"), F.lit(suffix).alias("suffix"), F.lit(rule).alias("rule")))
    kind = "array<struct<start:int,stop:int,suffix:string,rule:string>>"

    def claim(kept: Column, s: Column) -> Column:
        nth = F.size(F.filter(kept, lambda k: F.startswith(k["suffix"], s["suffix"]))) + 1
        own = F.struct(s["start"], s["stop"], F.concat(s["suffix"], F.when(nth > 1, nth.cast("string")).otherwise("")).alias("suffix"), s["rule"])
        return F.when(F.exists(kept, lambda k: (s["start"] < k["stop"]) & (k["start"] < s["stop"])), kept).otherwise(F.concat(kept, F.array(own)))

    return F.aggregate(F.concat(F.array_compact(F.array(*found)), many), F.array().cast(kind), claim)


DECIDED = ("class", "rule", "spans", "review", "reason", "value_entropy")


def decide(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """`df` with `class`, `rule`, `spans` (start, stop, suffix of each secret part), `review`, `reason` and `value_entropy` (bits a byte).

    The first rule of a ladder that applies decides. A part that is a handle or a variable reference is none; without any other
    the row is open. An open value that no rule has checked and that reads like a credential is marked for review. A null
    value is an empty one. Shared parts are columns of their own, so that the plan stays small and each is computed once."""
    k, v = F.coalesce(F.col(key), F.lit("")), F.coalesce(F.col(value), F.lit(""))
    shape = F.coalesce(*(F.when(v.rlike(p), F.lit("value-" + name)) for p, name, _ in SHAPES))
    label, last = (F.regexp_extract(v, r"\A([A-Za-z0-9._-]{1,32}[:|])([^:|]+)\z", i) for i in (1, 2))
    early = F.when(stripped(v) == "", "empty").when(stripped(v).rlike(REFERENCE), "variable-reference")
    none = F.array().cast("array<struct<start:int,stop:int,suffix:string,rule:string>>")
    parts = F.when(v.rlike(COMPOSED), composite_spans(v)).otherwise(none)
    measured = df.withColumns({"_read": reading(k), "_even": evenness(v), "_label_even": evenness(host_label(v)), "_last_even": evenness(last)})
    own = measured.withColumns({"_early": early, "_parts": parts, "_shape": shape, "_random": looks_random(v, F.col("_even")), "_label_random": looks_random(host_label(v), F.col("_label_even")), "_last_random": looks_random(last, F.col("_last_even"))})
    asked = F.col("_read.decides.kind")  # a kind that no term of the name calls for is not looked at
    own = own.withColumn("_fits", F.array_compact(F.array(*(F.when(F.array_contains(asked, kind) & agrees(kind, v, F.col("_random"), F.col("_label_random")), kind) for kind in KINDS))))
    own = own.withColumn("_name", verdict(F.col("_read"), F.col("_fits")))
    composite = F.array_join(F.array_distinct(F.transform("_parts", lambda s: s["rule"])), "+")
    first = (
        F.coalesce("_early", F.when(F.size("_parts") > 0, composite), "_shape", F.when(F.col("_read.public"), "public-prefix"))
    )
    rule = (
        F.when(first.isNotNull(), first)
        .when(F.col("_name") == "secret", "name-secret")
        .when(F.startswith("_name", F.lit("config")), "name-not-secret")
        .when(F.col("_last_random"), "labelled-token")
        .when(F.col("_random"), "entropy")
        .otherwise("default-open")
    )
    ruled = own.withColumn("rule", rule)
    kept = F.coalesce(*(F.when(F.col("rule") == f"value-{name}", keep) for _, name, keep in SHAPES if keep), F.when(F.col("rule") == "labelled-token", F.length(label)), F.lit(0))
    opens = F.col("rule").isin("empty", "variable-reference", "public-prefix", "name-not-secret", "default-open")
    composed = F.col("_early").isNull() & (F.size("_parts") > 0)
    whole = F.array(F.struct(kept.alias("start"), F.length(v).alias("stop"), F.lit("").alias("suffix")))
    parts = F.transform("_parts", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["suffix"].alias("suffix")))
    spans = F.when(opens, F.array().cast("array<struct<start:int,stop:int,suffix:string>>")).when(composed, parts).otherwise(whole)
    classed = ruled.withColumns({"spans": spans, "class": F.when(opens, "open").when(composed | (kept > 0), "partial").otherwise("veiled")})
    text = lambda s: v.substr(s["start"] + 1, s["stop"] - s["start"])
    variable = F.exists("spans", lambda s: text(s).rlike(REFERENCE))
    live = F.filter("spans", lambda s: ~F.startswith(text(s), F.lit("sv://")) & ~text(s).rlike(REFERENCE))
    seen = classed.withColumns({"spans": live, "_veiled": (F.size("spans") > 0) & (F.size(live) == 0), "_variable": variable})
    seen = seen.withColumns({"class": F.when(F.col("_veiled"), "open").otherwise(F.col("class")), "rule": F.when(F.col("_veiled"), F.when(F.col("_variable"), "variable-reference").otherwise("already-veiled")).otherwise(F.col("rule"))})
    proven = F.startswith("_name", F.lit("config")) & (F.col("_name") != "config-any")
    marked = seen.withColumn("reason", F.when((F.col("class") == "open") & ~proven, suspect_reason(v))).withColumn("review", F.col("reason").isNotNull())
    named = F.when(F.col("review") & (F.col("rule") == "default-open"), "unrecognised").otherwise(F.col("rule"))
    return marked.withColumn("rule", named).withColumn("value_entropy", F.col("_even.entropy")).select(*[c for c in df.columns if c not in DECIDED], *DECIDED)


def settled(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows of `df` where a condition on computed columns holds.

    A plain filter, and that of an explode, is pushed below the projections that compute its columns, and their expressions
    are copied into it again and again: planning takes minutes. One on what a generator gives stays where it is."""
    held = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumn("_keep", F.explode_outer(F.when(held, F.array(F.lit(True))))).where("_keep is not null").drop("_keep")


def classify(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """`df` with `class` (open, partial, veiled), `rule` and `review`; see `decide`."""
    return decide(df, key, value).drop("spans", "reason", "value_entropy")


#: A key's first line, and what follows it within 400 characters.
PEM = r"(?s)(-----BEGIN (?:(?!-----).){0,40}-----)(?=(.{0,400}))"


def scan_candidates(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Runs of 16 or more token characters in a text, and first lines of keys with the longest run that follows, if that
    looks random: one row each, beside the columns `keep`."""
    source = F.coalesce(text, F.lit(""))
    words = lambda t, n: F.regexp_extract_all(t, F.lit(f"[A-Za-z0-9_+/=.-]{{{n},}}"), F.lit(0))
    longest = lambda t: F.aggregate(words(t, 1), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    plain = F.transform(words(source, 16), lambda v: F.struct(F.lit("").alias("head"), v.alias("body")))
    heads, rests = (F.regexp_extract_all(source, F.lit(PEM), F.lit(i)) for i in (1, 2))
    keys = F.when(F.contains(source, F.lit("-----BEGIN ")), F.zip_with(heads, rests, lambda h, r: F.struct(h.alias("head"), longest(r).alias("body")))).otherwise(F.array().cast("array<struct<head:string,body:string>>"))
    found = docs.select(*keep, F.explode(F.concat(plain, keys)).alias("_found")).select(*keep, "_found.*")
    return found.where((F.col("head") == "") | looks_random(F.col("body"), evenness(F.col("body")))).select(*keep, F.concat("head", "body").alias("value"))
