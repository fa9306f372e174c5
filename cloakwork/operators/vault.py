"""Vault tables: versions of (repo, ref, value), handles in text, and the joins between them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HANDLE = "sv://([a-z0-9_.-]+)"
VALID_REF = r"\A[a-z0-9_.-]{1,200}\z"


def unique(vault: DataFrame) -> DataFrame:
    """(repo, ref, value), one row a ref; the job fails where a ref has two values, since no reader could tell which is meant.

    The check is part of the plan: one aggregation on the key of the joins that follow."""
    ends = vault.groupBy("repo", "ref").agg(F.min("value").alias("value"), F.max("value").alias("_last"))
    two = F.raise_error(F.concat(F.lit("two values of the reference "), F.col("ref"), F.lit(" in "), F.col("repo")))
    return ends.select("repo", "ref", F.when(F.col("value").eqNullSafe(F.col("_last")), F.col("value")).otherwise(two.cast("string")).alias("value"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next version: rows of `new` replace those of the same repo and ref; invalid refs, and two values of a ref, are
    refused as a whole. Building the plan runs a job that looks for invalid refs."""
    new = unique(new)
    bad = new.where(~F.col("ref").rlike(VALID_REF))
    if not bad.isEmpty():
        raise ValueError("a ref is invalid")
    return old.join(new, ["repo", "ref"], "left_anti").unionByName(new)


def delete(old: DataFrame, refs: DataFrame) -> DataFrame:
    """The next version without (repo, ref); absent ones are no error."""
    return old.join(refs, ["repo", "ref"], "left_anti")


def chain(sources: DataFrame) -> DataFrame:
    """Of (repo, ref, value, priority), the row of least priority for each ref: the first source that holds it wins."""
    first = F.min_by(F.struct("value", "priority"), F.struct("priority", "value")).alias("first")
    return sources.groupBy("repo", "ref").agg(first).select("repo", "ref", "first.*")


def all_refs(sources: DataFrame) -> DataFrame:
    """(repo, ref): every reference that any source holds, once."""
    return sources.select("repo", "ref").distinct()


def environment_vault(env: DataFrame, prefix: str = "SV_") -> DataFrame:
    """(repo, ref, value) from variables (repo, name, value): those that begin with `prefix`, the rest of the name in lower case."""
    rest = F.lower(F.expr(f"substr(name, {len(prefix) + 1})"))
    return env.where(F.startswith("name", F.lit(prefix)) & (F.length("name") > len(prefix))).select("repo", rest.alias("ref"), "value")


def differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """(repo, ref): values of `want` that do not read back the same from `got`; empty before any file may change."""
    back = got.select("repo", "ref", F.col("value").alias("_got"))
    return want.join(back, ["repo", "ref"], "left").where(~F.col("value").eqNullSafe(F.col("_got"))).select("repo", "ref")


POINTERS = "seq long, version long, folder string"


class Conflict(Exception):
    """Another writer has moved the vault on since its base was read."""


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """(seq, version, folder) of each commit, or None for a vault that was never written."""
    try:
        return spark.read.schema(POINTERS).json(f"{root.rstrip('/')}/pointers")
    except AnalysisException:  # there is no such folder yet
        return None


def _last(spark: SparkSession, root: str) -> tuple[int, int | None, int]:
    """(last seq, current version, greatest version); zeros and None for a vault that was never written."""
    log = _pointers(spark, root)
    row = log.agg(F.max("seq"), F.max_by("version", "seq"), F.max("version")).first() if log is not None else (None, None, None)
    return row[0] or 0, row[1], row[2] or 0


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version that the last pointer names; None for a vault that was never written."""
    return _last(spark, root)[1]


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not be there yet, in any store that Spark writes to; False if it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _commit(spark: SparkSession, root: str, version: int | None, folder: str | None, base: int | None, checked: bool) -> int:
    """Make a folder the current version by creating the next pointer file, and give the version's number.

    The file's name is the number of the commit, so of two writers one finds it there. That one tries the next number; if it
    is `checked`, only while `base` is still the current version."""
    skipped = waits = 0
    while True:
        last, current, greatest = _last(spark, root)
        if checked and current != base:
            raise Conflict(f"version {current} is not {base}")
        seq, number = last + 1 + skipped, version or greatest + 1 + skipped
        if _create(spark, f"{root}/pointers/{seq:012d}.json", json.dumps({"seq": seq, "version": number, "folder": folder}) + "\n"):
            return number
        if _last(spark, root)[0] == last:  # the other's file holds nothing yet
            time.sleep(0.2)
            waits += 1
            if waits % 25 == 0:  # nor will it: that writer is gone, and its numbers with it
                skipped += 1


def write_version(vault: DataFrame, root: str, base: int | None = None, checked: bool = False) -> int:
    """Write (repo, ref, value) as the next version of the vault under `root`; older versions stay as they are.

    Versions are never changed: each writer has a folder of its own, and a pointer is created last of all, so a job that dies
    leaves the vault as it was and writers at the same time get different numbers. With `checked`, a vault whose current
    version is no longer `base` raises Conflict and stays as it is; `update_vault` tries again then. The pointer's creation is
    as atomic as that of a file in its store is (HDFS: fully)."""
    spark = vault.sparkSession
    root, folder = root.rstrip("/"), f"version-{uuid.uuid4().hex}"
    unique(vault).write.parquet(f"{root}/{folder}")
    return _commit(spark, root, None, folder, base, checked)


def update_vault(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """Write what `change` makes of the current vault; if another writer was faster, of what that one wrote."""
    for _ in range(tries):
        base = current_version(spark, root)
        try:
            return write_version(change(read_vault(spark, root, base)), root, base, True)
        except Conflict:
            continue
    raise Conflict(f"no turn in {tries} tries")


def read_vault(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(repo, ref, value) of one version, the current one unless said otherwise; one ref is a filter on it."""
    version = version if version is not None else current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], "repo string, ref string, value string")
    return spark.read.schema("repo string, ref string, value string").parquet(f"{root.rstrip('/')}/{_folder(spark, root, version)}")


def _folder(spark: SparkSession, root: str, version: int) -> str:
    log = _pointers(spark, root)
    row = log.where(F.col("version") == version).agg(F.min_by("folder", "seq")).first() if log is not None else (None,)
    if row[0] is None:
        raise ValueError(f"the vault has no version {version}")
    return row[0]


def rollback(spark: SparkSession, root: str, version: int) -> None:
    """Make an older version the current one again."""
    _commit(spark, root.rstrip("/"), version, _folder(spark, root, version), None, False)


def used_refs(texts: DataFrame, text: str = "text") -> DataFrame:
    """(repo, path, ref): the distinct handles of each text."""
    return texts.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(HANDLE), F.lit(1)))).alias("ref")).distinct()


def dangling(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(repo, ref, files, n_files): handles that the vault lacks."""
    return used_refs(texts).join(vault, ["repo", "ref"], "left_anti").groupBy("repo", "ref").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("files"), F.count_distinct("path").alias("n_files"))


def orphans(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(repo, ref): vault rows that no text uses."""
    return vault.select("repo", "ref").join(used_refs(texts), ["repo", "ref"], "left_anti")


def resolve(rows: DataFrame, vault: DataFrame) -> DataFrame:
    """(repo, path, record_no, text) with each handle replaced by its value; unknown handles stay; see `unique`."""
    pieces = rows.select("repo", "path", "record_no", F.posexplode(F.regexp_extract_all("text", F.lit("sv://[a-z0-9_.-]+|(?s:(?:(?!sv://[a-z0-9_.-]).)+)"), F.lit(0))).alias("at", "piece"))
    keyed = pieces.withColumn("ref", F.regexp_extract("piece", r"\A" + HANDLE + r"\z", 1))
    joined = keyed.join(unique(vault), ["repo", "ref"], "left").withColumn("out", F.coalesce("value", "piece"))
    return joined.groupBy("repo", "path", "record_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias("text"))


def last_assignments(records: DataFrame) -> DataFrame:
    """The last record of each key in each file."""
    order = Window.partitionBy("repo", "path", "key").orderBy(F.desc("record_no"))
    return records.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def duplicate_refs(claims: DataFrame) -> DataFrame:
    """(repo, ref, owners, n_values): refs that more than one variable claims."""
    own = claims.groupBy("repo", "ref").agg(F.count_distinct("owner").alias("n"), F.array_join(F.sort_array(F.collect_set("owner")), ",").alias("owners"), F.count_distinct("value").alias("n_values"))
    return own.where("n > 1").drop("n")
