"""The environment that a program gets: settings files with their handles resolved, on top of what it has already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settings import VARIABLE, marked_refs
from .vault import resolve, used_refs


def load_place(path: Column) -> Column:
    """.env first, .env.local last, others between them by name."""
    return F.when(path == ".env", 0).when(path == ".env.local", 2).otherwise(1)


def skipped_names(records: DataFrame, npmrc: DataFrame, parent: DataFrame) -> DataFrame:
    """(repo, name): keys of `records`, and variables of npmrc markers, that the parent environment (repo, name, value) holds already, which wins."""
    keys = records.select("repo", F.col("key").alias("name")).union(marker_variables(npmrc).select("repo", "name")).distinct()
    return keys.join(parent.select("repo", "name").distinct(), ["repo", "name"], "left_semi")


def marker_variables(npmrc: DataFrame) -> DataFrame:
    """(repo, name, ref): one variable for each marker of npmrc texts (repo, path, text)."""
    refs = npmrc.select("repo", F.explode(marked_refs(F.col("text"))).alias("ref")).distinct()
    return refs.select("repo", F.concat(F.lit(VARIABLE), F.upper("ref")).alias("name"), "ref")


def live_records(records: DataFrame, parent: DataFrame) -> DataFrame:
    held = parent.select("repo", F.col("name").alias("key")).distinct()
    return records.join(held, ["repo", "key"], "left_anti")


def missing(records: DataFrame, npmrc: DataFrame, vault: DataFrame, parent: DataFrame) -> DataFrame:
    """(repo, ref) that some live record or marker asks for and the vault lacks; variables of the parent ask for nothing."""
    asked = used_refs(live_records(records, parent), "value").select("repo", "ref")
    marks = marker_variables(npmrc).join(parent.select("repo", "name").distinct(), ["repo", "name"], "left_anti").select("repo", "ref")
    return asked.union(marks).distinct().join(vault, ["repo", "ref"], "left_anti")


def environment(records: DataFrame, npmrc: DataFrame, vault: DataFrame, parent: DataFrame) -> DataFrame:
    """(repo, origin, first, name, value): the parent's variables, then those of the files in the order they first appear.

    `records` (repo, path, record_no, key, value): the last assignment in load order counts, at the place of the first; a
    handle that the vault lacks stays as text. `npmrc` (repo, path, text): each marker is a variable, after all files; where a
    file sets the same name, the marker's value wins at the file's place. A marker that the vault lacks gives none. Names that the parent (repo, name, value) holds are skipped. Order by repo, origin,
    first, name at the end, where a file is written."""
    spot = F.struct(load_place(F.col("path")).alias("place"), "path", "record_no")
    last = live_records(records, parent).groupBy("repo", "key").agg(F.max_by("value", spot).alias("value"), F.min(spot).alias("at"))
    last = last.select("repo", "key", "value", F.format_string("%d %s %012d", "at.place", "at.path", "at.record_no").alias("first"))
    texts = last.select("repo", F.col("key").alias("path"), F.lit(0).alias("record_no"), F.col("value").alias("text")).where(F.contains("text", F.lit("sv://")))
    whole = resolve(texts, vault.select("repo", "ref", "value")).select("repo", F.col("path").alias("key"), F.col("text").alias("whole"))
    marks = marker_variables(npmrc).join(parent.select("repo", "name").distinct(), ["repo", "name"], "left_anti").join(vault.select("repo", "ref", "value"), ["repo", "ref"])
    own = marks.select("repo", F.col("name").alias("key"), F.col("value").alias("marked"))
    files = last.join(whole, ["repo", "key"], "left").join(own, ["repo", "key"], "left")
    files = files.select("repo", F.lit(1).alias("origin"), "first", F.col("key").alias("name"), F.coalesce("marked", "whole", "value").alias("value"))
    marks = marks.join(last.select("repo", F.col("key").alias("name")), ["repo", "name"], "left_anti").select("repo", F.lit(2).alias("origin"), F.lit("").alias("first"), "name", "value")
    return parent.select("repo", F.lit(0).alias("origin"), F.lit("").alias("first"), "name", "value").unionByName(files).unionByName(marks)
