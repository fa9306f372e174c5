"""Settings files as records, and records as files again: dotenv and npmrc, byte for byte where nothing changes.

One row of the input is one file: (repo, path, content). A null or empty content has no records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = r"[A-Za-z_][A-Za-z0-9_.-]*"
QUOTED = r"\"[^\"\\]*+(?:\\(?s:.)[^\"\\]*+)*+\"|'[^']*+'"
HEAD = rf"(?:\A\uFEFF)?+[ \t]*(?:export[ \t]+)?+{KEY}[ \t]*=[ \t]*"
#: A quoted value may run over lines; a quote that never closes is part of a one-line value.
RECORD = rf"{HEAD}(?:{QUOTED})[^\n]*\n?|[^\n]*\n|[^\n]+"
# Escapes inside double quotes.
ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')]
NPMRC_REF = "npmrc_"
VARIABLE = "SV_"
MARKER = r"\$\{(" + VARIABLE + r"[A-Z0-9_]+)\}"


def _unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\0"), F.lit("\\"))


def _escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _numbered(files: DataFrame, pattern: str) -> DataFrame:
    """(repo, path, record_no, line_no, raw): the records of each file, from 1, and the line on which each starts."""
    rows = files.select("repo", "path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("k", "raw")).where("raw != ''")
    before = Window.partitionBy("repo", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    return rows.select("repo", "path", (F.col("k") + 1).alias("record_no"), (F.coalesce(F.sum(lines).over(before), F.lit(0)) + 1).cast("long").alias("line_no"), "raw")


def parse_dotenv(files: DataFrame) -> DataFrame:
    """(repo, path, record_no, line_no, kind, key, value, quote, export, prefix, suffix, raw).

    `kind` is blank, comment, assignment or other. An assignment is `prefix`, its value as written, and `suffix`; other kinds have
    null in these columns. Within double quotes \\n, \\r, \\t, \\\\ and \\" are escapes; a NUL there reads as a backslash. A byte
    order mark at the start is part of the first record's prefix."""
    rows = _numbered(files, RECORD)
    bare = F.regexp_replace("raw", r"\r?\n\z", "")
    whole = rows.withColumns({"bare": bare, "head": F.regexp_extract(bare, rf"\A{HEAD}", 0)}).withColumn("body", F.expr("substr(bare, length(head) + 1)"))
    quoted = F.regexp_extract("body", rf"\A(?:{QUOTED})", 0)
    plain = F.regexp_replace(F.regexp_replace("body", r"(?s)(?:\A|(?<=[ \t]))#.*\z", ""), r"[ \t]+\z", "")
    assigned = F.col("head") != ""
    kind = F.when(F.col("bare").rlike(r"\A\uFEFF?[ \t]*\z"), "blank").when(F.col("bare").rlike(r"\A\uFEFF?[ \t]*#"), "comment").when(assigned, "assignment").otherwise("other")
    read = whole.withColumns({"kind": kind, "quoted": quoted, "plain": plain})
    has = F.col("quoted") != ""
    written = F.when(has, F.expr("substr(quoted, 2, length(quoted) - 2)")).otherwise(F.col("plain"))
    quote = F.when(has, F.col("quoted").substr(1, 1)).otherwise("")
    value = F.when(quote == '"', _unescaped(written)).otherwise(written)
    only = lambda c: F.when(F.col("kind") == "assignment", c)
    return read.select(
        "repo", "path", "record_no", "line_no", "kind",
        only(F.regexp_extract("head", rf"\A\uFEFF?[ \t]*(?:export[ \t]+)?+({KEY})", 1)).alias("key"),
        only(value).alias("value"), only(quote).alias("quote"),
        only(F.col("head").rlike(rf"\A\uFEFF?[ \t]*export[ \t]+{KEY}")).alias("export"),
        only(F.col("head")).alias("prefix"),
        only(F.expr("substr(raw, length(head) + length(if(quoted != '', quoted, plain)) + 1)")).alias("suffix"),
        "raw",
    )


def parse_npmrc(files: DataFrame) -> DataFrame:
    """The same columns for npmrc: a line each, `;` and `#` begin a comment at the start or after a blank, nothing is quoted."""
    rows = _numbered(files, r"[^\n]*\n|[^\n]+").withColumn("bare", F.regexp_replace("raw", r"\r?\n\z", ""))
    head = F.regexp_extract("bare", r"(?s)\A[ \t]*(?![#; \t])[^=]*[^=\s][^=]*=[ \t]*", 0)
    whole = rows.withColumn("head", head).withColumn("body", F.expr("substr(bare, length(head) + 1)"))
    value = F.regexp_replace(F.regexp_replace("body", r"(?s)(?:\A|(?<=[ \t]))[#;].*\z", ""), r"[ \t]+\z", "")
    kind = F.when(F.col("bare").rlike(r"\A[ \t]*\z"), "blank").when(F.col("bare").rlike(r"\A[ \t]*[#;]"), "comment").when(F.col("head") != "", "assignment").otherwise("other")
    only = lambda c: F.when(F.col("kind") == "assignment", c)
    return whole.withColumns({"kind": kind, "read": value}).select(
        "repo", "path", "record_no", "line_no", "kind",
        only(F.trim(F.regexp_extract("head", r"(?s)\A\s*(.*?)\s*=[ \t]*\z", 1))).alias("key"),
        only(F.col("read")).alias("value"), only(F.lit("")).alias("quote"), only(F.lit(False)).alias("export"), only(F.col("head")).alias("prefix"),
        only(F.expr("substr(raw, length(head) + length(read) + 1)")).alias("suffix"), "raw",
    )


def render(records: DataFrame, new_value: str = "new_value", new_comment: str = "new_comment") -> DataFrame:
    """(repo, path, content): raw records, those with a non-null `new_value` rewritten in the quotes that they had.

    A value that its quotes can't hold is put in double quotes. A non-null `new_comment`, if there is such a column, replaces
    the comment that this library wrote, or is written where a line has none; an empty one leaves no comment."""
    new = F.col(new_value)
    fits = F.when(F.col("quote") == "'", ~new.rlike("'")).when(F.col("quote") == "", ~new.rlike(r"[\s#'\"\\]")).otherwise(False)
    written = F.when(fits, F.concat("quote", new, "quote")).otherwise(F.concat(F.lit('"'), _escaped(new), F.lit('"')))
    suffix = F.col("suffix")
    if new_comment in records.columns:
        say, end = F.col(new_comment), F.regexp_extract("suffix", r"\r?\n?\z", 0)
        ours = suffix.rlike(r"\A[ \t]*(# sv: [^\n]*)?\r?\n?\z")
        suffix = F.when(say.isNull() | ~ours, suffix).when(say == "", end).otherwise(F.concat(F.lit(" # "), say, end))
    line = F.when(new.isNotNull() & (F.col("kind") == "assignment"), F.concat("prefix", written, suffix)).otherwise(F.col("raw"))
    parts = F.array_sort(F.collect_list(F.struct("record_no", line.alias("line"))))
    return records.groupBy("repo", "path").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("content"))


def is_npmrc_credential(key: Column, value: Column) -> Column:
    """A registry credential in the clear: a token that needs no quotes and is no variable."""
    return key.rlike(r"(?i)\A(//[^\s=]*:)?_(authToken|auth|password)\z") & value.rlike(r"\A[^\s\"'#;]+\z") & ~value.rlike(r"\$\{[^}]*\}")


def npmrc_ref(key: Column) -> Column:
    """The vault reference of an npmrc key: runs of other characters are one underscore."""
    return F.concat(F.lit(NPMRC_REF), F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), r"\A_+|_+\z", ""))


def marker(ref: Column) -> Column:
    """What stands in an npmrc file for a secret: a variable of the environment."""
    return F.concat(F.lit("${" + VARIABLE), F.upper(ref), F.lit("}"))


def marked_refs(text: Column) -> Column:
    """The distinct npmrc references whose markers a text holds, in order."""
    names = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda v: F.lower(v.substr(F.lit(len(VARIABLE) + 1), F.length(v))))
    return F.array_distinct(F.filter(names, lambda r: F.startswith(r, F.lit(NPMRC_REF))))
