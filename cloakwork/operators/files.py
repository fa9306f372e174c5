"""Which files of a tree hold settings, in what order they load, and which other files hold credentials in the clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settings import marked_refs
from .classify import classify, scan_candidates, settled
from .runtime import load_place
from .vault import used_refs

# Folders that are never read, and endings of files that hold samples.
SKIP_DIRS = ".git node_modules vendor dist build .next .nuxt target __pycache__ .venv venv coverage .terraform".split()
SAMPLE_ENDINGS = ".example .sample .template .dist .defaults".split()
# Kinds of credential files in order: the path, and the line, whose last group is the secret.
CREDENTIAL_FILES = [
    (".npmrc", r"(?:\A|/)\.npmrc\z", r"(?i)^[ \t]*(?://[^\s=]*:)?_(?:authToken|auth|password)\s*=\s*(\S+)"),
    (".netrc", r"(?:\A|/)(?:\.netrc|_netrc)\z", r"(?i)\bpassword\s+(\S+)"),
    (".yarnrc.yml", r"(?:\A|/)\.yarnrc(?:\.yml|\.yaml)?\z", r"(?i)^\s*npmAuth(?:Token|Ident)\s*[:=]\s*\"?(\S+)"),
    (".pypirc", r"(?:\A|/)\.pypirc\z", r"(?i)^\s*password\s*[:=]\s*(\S+)"),
    (".pgpass", r"(?:\A|/)\.pgpass\z", r"^[^#:\s][^:]*:[^:]*:[^:]*:[^:]*:(\S+)"),
    (".git-credentials", r"(?:\A|/)\.git-credentials\z", r"://[^:/@\s]+:([^@/\s]+)@"),
    ("docker config", r"(?:\A|/)(?:\.dockercfg|\.docker/config\.json)\z", r"(?i)\"(?:auth|password|identitytoken)\"\s*:\s*\"([^\"]+)\""),
    ("aws credentials", r"(?:\A|/)credentials\z", r"(?i)^\s*aws_(?:secret_access_key|session_token)\s*=\s*(\S+)"),
    (".envrc", r"(?:\A|/)\.envrc\z", r"(?i)^\s*export\s+\w*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|PRIVATE_KEY)\w*\s*=\s*(\S+)"),
    ("terraform variables", r"(?:\A|/)(?:terraform\.tfvars|[^/]*\.auto\.tfvars)\z", r"(?i)^\s*\w*(?:secret|token|password|private_key|access_key)\w*\s*=\s*\"([^\"]+)\""),
]
#: What to do about each kind.
ADVICE = {
    ".npmrc": "npm reads it: veil the line, so that a variable stands there, or revoke the token",
    ".netrc": "its readers expand nothing: keep the login in a helper of the program that needs it",
    ".yarnrc.yml": "yarn expands variables: name one in place of the value",
    ".pypirc": "keep the index password in a keyring or a variable",
    ".pgpass": "its reader expands nothing: give the connection by a variable",
    ".git-credentials": "let a credential helper keep the password",
    "docker config": "let a credential helper keep the login",
    "aws credentials": "use a role, or a profile that asks a process for its keys",
    ".envrc": "move the value to a dotenv file, which can be veiled",
    "terraform variables": "give the value by a TF_VAR_ variable",
}
PLACEHOLDER = r"\$\{[^}]*\}|\$[A-Za-z_][A-Za-z0-9_]*|sv://|<[^>]*>|xxx+|\.\.\.|CHANGEME|YOUR_"
LARGEST = 1 << 20


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def in_tree(path: Column) -> Column:
    """True if no folder on the way is one that is never read."""
    return ~F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, SKIP_DIRS)))


def file_kind(path: Column) -> Column:
    """dotenv, npmrc or null."""
    name = base_name(path)
    sample = name.rlike("(" + "|".join(e.replace(".", r"\.") for e in SAMPLE_ENDINGS) + r")\z")
    return F.when(name.rlike(r"\A\.env(\..*)?\z") & ~sample, "dotenv").when(name == ".npmrc", "npmrc")


def discover_files(files: DataFrame) -> DataFrame:
    """`files`, of (repo, path, ...), that hold settings, with their `kind`."""
    return files.where(in_tree(F.col("path"))).withColumn("kind", file_kind(F.col("path"))).where("kind is not null")


def linked_files(files: DataFrame) -> DataFrame:
    """(repo, path) of settings files that are symbolic links: listed, never read. `files` has `is_link`."""
    return files.where("is_link").where(in_tree(F.col("path")) & file_kind(F.col("path")).isNotNull()).select("repo", "path")


def skipped_files(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(repo, path, why) of credential files that `credential_lines` leaves out: too large, or not text."""
    ours = files.where(in_tree(F.col("path")) & F.coalesce(*(F.when(F.col("path").rlike(p), k) for k, p, _ in CREDENTIAL_FILES)).isNotNull())
    why = F.when(F.octet_length("content") > largest, "too large").when(F.contains("content", F.lit("\0")), "not text")
    return ours.withColumn("why", why).where("why is not null").select("repo", "path", "why")


def load_order(files: DataFrame) -> DataFrame:
    """(repo, files) from (repo, path): .env, then others by name, then .env.local, as one line."""
    place = load_place(F.col("path"))
    ordered = F.array_sort(F.collect_set(F.struct(place.alias("place"), "path")))
    return files.groupBy("repo").agg(F.array_join(F.transform(ordered, lambda x: x["path"]), " ").alias("files"))


def last_loaded(records: DataFrame) -> DataFrame:
    """(repo, key, path, record_no, value, first_path, first_no): of (repo, path, record_no, key, value), the one that counts
    after all files are loaded, and where its key first stands, which keys are ordered by."""
    spot = F.struct(load_place(F.col("path")).alias("place"), "path", "record_no")
    ranked = records.groupBy("repo", "key").agg(F.max_by(F.struct("path", "record_no", "value"), spot).alias("last"), F.min(spot).alias("first"))
    return ranked.select("repo", "key", "last.*", F.col("first.path").alias("first_path"), F.col("first.record_no").alias("first_no"))


def unread_files(texts: DataFrame) -> DataFrame:
    """(repo, path) that hold a handle and are not loaded by default."""
    return used_refs(texts).where(~F.col("path").isin(".env", ".env.local")).select("repo", "path").distinct()


def all_uses(texts: DataFrame) -> DataFrame:
    """(repo, path, ref): the handles of each text (repo, path, text), and the markers of npmrc files."""
    npmrc = texts.where(base_name(F.col("path")) == ".npmrc").select("repo", "path", F.explode(marked_refs(F.col("text"))).alias("ref"))
    return used_refs(texts).union(npmrc).distinct()


def ref_usage(texts: DataFrame) -> DataFrame:
    """(repo, ref, files): the files that use each handle or marker."""
    return all_uses(texts).groupBy("repo", "ref").agg(F.array_join(F.sort_array(F.collect_set("path")), ",").alias("files"))


def credential_lines(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(repo, path, kind, line_no): lines of credential files that hold a value in the clear.

    Larger files, files with a NUL, comment lines and placeholders are left out; the first kind that a path fits counts."""
    path, line = F.col("path"), F.col("line")
    kind = F.coalesce(*(F.when(path.rlike(p), k) for k, p, _ in CREDENTIAL_FILES))
    secret = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract(line, p, 1)) for k, _, p in CREDENTIAL_FILES))
    ours = files.where(in_tree(path)).withColumn("kind", kind).where("kind is not null")
    ours = ours.where((F.octet_length("content") <= largest) & ~F.contains("content", F.lit("\0")))
    lines = ours.select("repo", "path", "kind", F.posexplode(F.split("content", r"\r?\n")).alias("k", "line"))
    live = lines.where(~line.rlike(r"\A\s*([#;]|\z)")).withColumn("secret", secret).where((F.col("secret") != "") & ~F.col("secret").rlike(PLACEHOLDER))
    return live.select("repo", "path", "kind", (F.col("k") + 1).cast("long").alias("line_no"))


def find_uncovered(files: DataFrame, planned: DataFrame) -> DataFrame:
    """(repo, path, kind, lines, advice): credential lines that no row of `planned` (repo, path, line_no) takes care of."""
    left = credential_lines(files).join(planned.select("repo", "path", "line_no"), ["repo", "path", "line_no"], "left_anti")
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))[F.col("kind")]
    return left.groupBy("repo", "path", "kind").agg(F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("lines")).withColumn("advice", advice)


def guard(texts: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, rule): vendors' credentials in any text of (path, text), without those of `allowed` (path, rule)."""
    ruled = classify(scan_candidates(texts, "text", "path").withColumn("key", F.lit("X")))
    return settled(ruled.select("path", "rule"), F.startswith("rule", F.lit("value-"))).distinct().join(allowed, ["path", "rule"], "left_anti")
