"""What a person reads: the plan, each file as a reader would see it, counts and manifests. No report quotes a hidden value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import charset
from .classify import SHAPES, settled
from .files import CREDENTIAL_FILES
from .veil import comment

LISTED = 8  # places that one finding names


def shape_text(value: Column, entropy: Column) -> Column:
    """`entropy`: what `veil` measured. Another Arrow function on top of its plan would be copied through all of it: no end of planning."""
    return F.format_string("%d chars, %s, entropy %.1f", F.octet_length(value), charset(value), entropy)


def plan_report(veiled: DataFrame) -> DataFrame:
    """(repo, path, record_no, key, class, rule, shape, prefix) of what `veil` gave: the shape of hidden values, a mark on those
    to review, and the vendor's mark at the start of a value that stays in sight."""
    shape = F.when(F.col("review"), "<- read this one").when(F.col("class") != "open", shape_text(F.col("value"), F.col("value_entropy"))).otherwise("")
    prefix = F.coalesce(*(F.when(F.col("rule") == f"value-{name}", F.col("value").substr(1, keep)) for _, name, keep in SHAPES if keep), F.lit(""))
    return veiled.select("repo", "path", "record_no", "key", "class", "rule", shape.alias("shape"), prefix.alias("prefix"))


def plan_json(veiled: DataFrame) -> DataFrame:
    """(repo, path, record_no, line): the same as JSON, with the projected text and the refs."""
    refs = F.transform("secrets", lambda s: s["ref"])
    return veiled.select("repo", "path", "record_no", F.to_json(F.struct("key", "class", "rule", "review", "projected", refs.alias("refs"))).alias("line"))


def projection(veiled: DataFrame) -> DataFrame:
    """(repo, path, content): each file as a reader sees it, hidden values with a comment on their shape."""
    line = F.concat("key", F.lit("="), "projected", F.when(F.col("class") != "open", F.concat(F.lit("    # "), comment(F.col("value")))).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("record_no", line.alias("line"))))
    return veiled.groupBy("repo", "path").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))


def unrecognised(veiled: DataFrame) -> DataFrame:
    """(repo, path, key) of values that stay open and that no rule knows."""
    return settled(veiled.select("repo", "path", "key", "review"), "review").drop("review")


def first_places(places: Column, n: int = LISTED) -> Column:
    """The first places in order, then how many more there are."""
    ordered = F.array_sort(places)
    return F.when(F.size(places) <= n, ordered).otherwise(F.concat(F.slice(ordered, 1, n), F.array(F.format_string("and %d more", F.size(places) - n))))


def backup_manifest(files: DataFrame, run: str) -> DataFrame:
    """(run_id, repo, path, n_bytes, sha256) of each file that is to be rewritten by one run, whose name finds its backup again."""
    return files.select(F.lit(run).alias("run_id"), "repo", "path", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def summary(veiled: DataFrame) -> DataFrame:
    """(repo, n_secrets, n_files, n_entries): refs moved to the vault, files rewritten, entries changed."""
    taken = veiled.select("repo", "path", "record_no", F.explode_outer("secrets.ref").alias("ref")).where("ref is not null")
    return taken.groupBy("repo").agg(
        F.count_distinct("ref").alias("n_secrets"), F.count_distinct("path").alias("n_files"), F.count_distinct("path", "record_no").alias("n_entries")
    )


def restore_summary(restored: DataFrame) -> DataFrame:
    """(repo, n_handles, n_files): what `restored` puts back."""
    return restored.where("new_value is not null").groupBy("repo").agg(F.sum("n_handles").alias("n_handles"), F.count_distinct("path").alias("n_files"))


def finding_kinds(findings: DataFrame) -> DataFrame:
    """(kind, place, n): the distinct kinds of credential files among the findings, with their place in the list of kinds."""
    place = F.create_map(*(F.lit(x) for i, (k, _, _) in enumerate(CREDENTIAL_FILES) for x in (k, i)))
    return findings.groupBy("kind").agg(F.count("*").alias("n")).select("kind", place[F.col("kind")].alias("place"), "n")
