"""The health of projects: a finding for each check and project, worst first where a place puts a secret at risk.

Every check is a DataFrame (repo, check_no, level, n, places); `health` is their union. Levels: 0 ok, 1 note, 2 warning, 3 bad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settings import parse_dotenv
from ..sources.shared import staged
from .classify import decide, settled
from .files import all_uses, discover_files, find_uncovered, in_tree, linked_files, load_order
from .gate import policy_state
from .redact import find_leftovers
from .report import LISTED

OK, NOTE, WARN, BAD = range(4)
HOME = ".vault"
CHECKS = "caller vault plaintext plaintext-elsewhere unrecognised uncovered unread dangling orphans links ignore backup policy".split()


def _listed(repos: DataFrame, places: DataFrame, check: str, level: int) -> DataFrame:
    """One row a repo of `repos`: `level` and the places of `places` (repo, place), or ok without any.

    Only the first places of a project are gathered, and the number of all."""
    every = places.select("repo", "place").distinct()
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("place"))
    first = every.withColumn("rank", rank).where(F.col("rank") <= LISTED).groupBy("repo").agg(F.array_sort(F.collect_list("place")).alias("first"))
    counted = every.groupBy("repo").agg(F.count("*").alias("n")).join(first, "repo")
    more = F.when(F.col("n") > LISTED, F.array(F.format_string("and %d more", F.col("n") - LISTED))).otherwise(F.array().cast("array<string>"))
    return repos.join(counted, "repo", "left").select(
        "repo", F.lit(CHECKS.index(check)).alias("check_no"), F.when(F.col("n") > 0, level).otherwise(OK).alias("level"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.concat("first", more), F.array().cast("array<string>")).alias("places"),
    )


def _stated(repos: DataFrame, states: DataFrame, check: str, level: Column, place: Column) -> DataFrame:
    """One row a repo, its level and a place from the columns of `states` (repo, ...)."""
    joined = repos.join(states, "repo", "left").withColumn("_level", level)
    return joined.select(
        "repo", F.lit(CHECKS.index(check)).alias("check_no"), F.col("_level").alias("level"), F.when(F.col("_level") > OK, 1).otherwise(0).cast("long").alias("n"), F.array_compact(F.array(F.when(F.col("_level") > OK, place))).alias("places")
    )


def health(files: DataFrame, vault: DataFrame, callers: DataFrame, home: str = HOME) -> DataFrame:
    """(repo, check_no, level, n, places) of each project of `files` (repo, path, content, is_link).

    `vault` (repo, ref, value), `callers` (repo, caller, reason). A project whose vault is empty gets a note for it, and its
    search for plaintext finds nothing. No place quotes a value; one of an unrecognised value says why it is in doubt. The plaintext
    search asks the vault, not the classifier, which may be what is wrong. What several checks read, places alone and no values, is
    written to the shared folder once, so that building the plan runs these jobs."""
    repos = files.select("repo").distinct()
    read = files.where("not is_link")
    settings = discover_files(read)
    dotenv = settings.where("kind = 'dotenv'")
    texts = settings.select("repo", "path", F.col("content").alias("text"))
    at = lambda *c: F.concat_ws(" ", *c)

    left = find_leftovers(read.where(in_tree(F.col("path")) & ~F.startswith("path", F.lit(home + "/"))), vault, settings.select("repo", "path"))
    left = left.select("repo", "level", at(F.col("path"), F.format_string("line %d", "line_no"), F.concat(F.lit("sv://"), "ref")).alias("place"))
    left = staged(left)
    entries = parse_dotenv(dotenv).where("kind = 'assignment'")
    # a setting says the same in every file: each is read once
    pairs = settled(decide(entries.select("key", "value").distinct()).select("key", "value", "review", "reason"), "review")
    doubts = staged(entries.join(pairs, ["key", "value"]).select("repo", at(F.col("path"), F.col("key"), F.col("reason")).alias("place")))
    planned = entries.select("repo", "path", "line_no")
    uncovered = staged(find_uncovered(read, planned).select("repo", at(F.col("path"), F.col("lines"), F.col("advice")).alias("place")))
    uses = staged(all_uses(texts))
    own = uses.join(dotenv.select("repo", "path"), ["repo", "path"], "left_semi")
    unread = own.where(~F.col("path").isin(".env", ".env.local")).select("repo", F.col("path").alias("place"))
    lost = uses.join(vault, ["repo", "ref"], "left_anti").select("repo", at(F.col("ref"), F.col("path")).alias("place"))
    spare = vault.select("repo", "ref").join(uses, ["repo", "ref"], "left_anti").select("repo", F.col("ref").alias("place"))
    ignored = files.where("path = '.gitignore'").withColumn("covers", F.exists(F.split("content", "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\r]", " ")).isin(home, home + "/", home + "/*")))
    copies = files.where(F.startswith("path", F.lit(home + "/backup/"))).select("repo", F.col("path").alias("place"))
    rules = policy_state(files.where(F.col("path") == f"{home}/policy.toml").select("repo", F.col("content").alias("text"))).select("repo", "state")
    held = vault.groupBy("repo").agg(F.count("*").alias("refs"))

    found = [
        _stated(repos, callers, "caller", F.when(F.col("caller") == "agent", NOTE).otherwise(OK), F.col("reason")),
        _stated(repos, held, "vault", F.when(F.col("refs") > 0, OK).otherwise(NOTE), F.lit("the vault is empty")),
        _listed(repos, left.where("level = 'bad'"), "plaintext", BAD),
        _listed(repos, left.where("level = 'warn'"), "plaintext-elsewhere", WARN),
        _listed(repos, doubts, "unrecognised", WARN),
        _listed(repos, uncovered, "uncovered", WARN),
        _listed(repos, unread, "unread", WARN),
        _listed(repos, lost, "dangling", BAD),
        _listed(repos, spare, "orphans", NOTE),
        _listed(repos, linked_files(files).select("repo", F.col("path").alias("place")), "links", WARN),
        _stated(repos, ignored.groupBy("repo").agg(F.max("covers").alias("covers")), "ignore", F.when(F.col("covers"), OK).otherwise(WARN), F.lit(f".gitignore does not cover {home}/")),
        _listed(repos, copies, "backup", BAD),
        _stated(repos, rules, "policy", F.when(F.col("state") == "on", OK).when(F.col("state") == "off", WARN).when(F.col("state") == "invalid", BAD).otherwise(NOTE), F.coalesce("state", F.lit("missing"))),
    ]
    return reduce(DataFrame.unionByName, found)


def suggested_order(files: DataFrame) -> DataFrame:
    """(repo, files): the load order that reads every file with a handle, the default ones among them."""
    texts = discover_files(files.where("not is_link")).where("kind = 'dotenv'").select("repo", "path", F.col("content").alias("text"))
    return load_order(all_uses(texts).select("repo", "path").distinct())


def verdicts(findings: DataFrame) -> DataFrame:
    """(repo, worst, exit_code): the worst level of each project; only a bad one fails it."""
    worst = findings.groupBy("repo").agg(F.max("level").alias("worst"))
    return worst.withColumn("exit_code", F.when(F.col("worst") == BAD, 1).otherwise(0))
