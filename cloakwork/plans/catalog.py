"""All queries of the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, names, shape
from ..functions.suspect import VENDOR_STARTS, suspect_reason
from ..operators import audit as A
from ..operators import classify as C
from ..operators import evaluate as E
from ..operators import files as T
from ..operators import gate as G
from ..operators import health as H
from ..operators import redact as R
from ..operators import report as P
from ..operators import runtime as U
from ..operators import vault as V
from ..operators import veil as W
from ..sources import derived as D
from ..sources import settings as S
from ..sources.shared import shared_folder
from ..streaming import redact as X
from ..streaming import run as N


def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on the credential-like words of all documents, by language."""
    found = C.scan_candidates(D.read(spark, sf_dir, "documents"), "text", "lang").withColumn("key", F.lit("X"))
    return C.classify(found).groupBy("lang", "rule").agg(F.count("*").alias("n"))


def scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate words of all documents, by language."""
    return C.scan_candidates(D.read(spark, sf_dir, "documents"), "text", "lang").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def shape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, alphabet, distinct bytes and entropy of every derived value."""
    v = F.col("value")
    measured = D.env_entries(spark, sf_dir).withColumn("even", kernels.evenness(v))
    return measured.select("id", F.octet_length(v).cast("long").alias("n_bytes"), shape.charset(v).alias("charset"), F.col("even.distinct").cast("long").alias("n_distinct"), F.round("even.entropy", 6).alias("entropy"))


def name_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every derived name."""
    return D.env_entries(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n")).select("key", F.array_join(names.segments(F.col("key")), " ").alias("segments"), "n")


def classify_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and rule of every derived entry."""
    return C.classify(D.env_entries(spark, sf_dir)).select("id", "class", "rule", "review")


def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and open, partial and veiled entries of each repository."""
    by = lambda c: F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}")
    return C.classify(D.env_entries(spark, sf_dir)).groupBy("repo").agg(F.count_distinct("path").alias("n_files"), by("open"), by("partial"), by("veiled"), F.count_if("review").alias("n_review"))


def vault_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chain(D.vault_rows(spark, sf_dir)).withColumn("priority", F.col("priority").cast("long"))


def vault_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dangling(D.handle_texts(spark, sf_dir), D.vault_rows(spark, sf_dir))


def vault_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.orphans(D.handle_texts(spark, sf_dir), V.chain(D.vault_rows(spark, sf_dir)))


def vault_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resolve(D.handle_texts(spark, sf_dir), V.chain(D.vault_rows(spark, sf_dir)).drop("priority"))


def last_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.last_assignments(D.env_entries(spark, sf_dir)).select("repo", "path", "key", "record_no")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, kind, key, record_no, span_no, ref, value): every secret part of the derived entries."""
    taken = W.veil(D.env_entries(spark, sf_dir)).select("repo", "path", F.lit("dotenv").alias("kind"), "key", "record_no", F.posexplode_outer("secrets").alias("span_no", "s"))
    return taken.where("s is not null").select("repo", "path", "kind", "key", "record_no", "span_no", "s.ref", "s.value")


def duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir).select((F.col("repo").cast("int") % 3).cast("string").alias("repo"), "ref", F.concat("repo", F.lit("/"), "path", F.lit(":"), "key").alias("owner"), "value")
    return V.duplicate_refs(claims)


def detect_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.detect_caller(D.sessions(spark, sf_dir))


def check_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.check_policy(D.commands(spark, sf_dir)).select("event_id", "program", "refusal")


def redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.redact(D.logs(spark, sf_dir), R.build_needles(D.secrets(spark, sf_dir)))


def redact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hits(D.logs(spark, sf_dir), R.build_needles(D.secrets(spark, sf_dir)))


def leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_leftovers(D.logs(spark, sf_dir).selectExpr("repo", "id as path", "text as content"), D.secrets(spark, sf_dir))


def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.discover_files(D.trees(spark, sf_dir)).select("repo", "path", "kind")


def project_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy of each project says to each command, and what to do about it."""
    commands = D.commands(spark, sf_dir).withColumn("repo", (F.col("event_id") % 20).cast("string"))
    which = F.when(F.col("r") % 5 == 1, "[agent]\nenforce = false").when(F.col("r") % 5 == 2, '[agent]\nallow = ["git"]').when(F.col("r") % 5 == 3, '[agent]\ndeny = ["git"]\n[agent.inline_code]\nperl = []\nnode = ["app.js"]').when(F.col("r") % 5 == 4, "[agent")
    policies = D.read(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("r")).distinct().where("r % 5 <> 0").select(F.col("r").cast("string").alias("repo"), which.alias("text"))
    return G.check_project_policies(commands, policies).select("event_id", "repo", "program", "refusal", "advice")


def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = D.trees(spark, sf_dir).where("path = 'a/.npmrc' and cast(repo as int) % 20 = 1").selectExpr("repo", "path", "2L as line_no")
    return T.find_uncovered(D.trees(spark, sf_dir), planned)


def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load_order(D.env_entries(spark, sf_dir))


def last_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_loaded(D.env_entries(spark, sf_dir)).select("repo", "key", "path", "record_no")


def unread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unread_files(D.handle_texts(spark, sf_dir))


def ref_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ref_usage(D.handle_texts(spark, sf_dir))


def guard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = D.env_entries(spark, sf_dir).selectExpr("cast(id as string) as path", "value as text")
    body = "concat('-----BEGIN RSA ', 'PRIVATE KEY-----', chr(10), case id % 2 when 0 then replace(value, 'main:', '') else 'a body for tests' end)"
    entries = entries.union(D.env_entries(spark, sf_dir).where("want in ('labelled-token', 'default-open')").selectExpr("concat('k', id)", body.replace("case id % 2 when 0", "case want when 'labelled-token'")))
    return T.guard(entries, entries.where("try_cast(path as int) % 40 = 6").selectExpr("path", "'value-aws-access-key-id' as rule"))


def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(C.classify(D.env_entries(spark, sf_dir)))


def redact_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands by event, with a credential flag after them, as they may be logged."""
    extra = F.array(F.lit("--api-key"), F.col("event_id").cast("string"), F.concat(F.lit("--token="), F.col("event_id").cast("string")), F.concat(F.lit("Authorization: Bearer "), F.col("event_id").cast("string")))
    return D.commands(spark, sf_dir).select("event_id", F.array_join(A.redact_command(F.concat("argv", extra)), "|").alias("command"))


def dotenv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_dotenv(D.env_files(spark, sf_dir)).where("kind = 'assignment'").select("repo", "path", "line_no", "key", "value")


def veil_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.veil(D.env_entries(spark, sf_dir)).select("id", "class", "projected", F.size("secrets").cast("long").alias("n_secrets"))


def miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret rows that can still be read, by note and in all."""
    return E.miss_rate(E.judge(D.labelled(spark, sf_dir)))


def open_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open rows that are hidden for nothing, and those that are reported."""
    return E.open_rates(E.judge(D.labelled(spark, sf_dir)))


def missed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first secret rows that can still be read, as a report lists them."""
    missed = C.settled(E.judge(D.labelled(spark, sf_dir)).select("id", "key", "note", "rule", "want", "leaks"), "want = 'secret' and leaks")
    return E.examples(missed, 12, "id").select("id", "key", "note", "rule")


def seen_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short tokens that are veiled or reported, by alphabet and length."""
    return E.seen_share(C.classify(D.short_tokens(spark, sf_dir).withColumnRenamed("n", "length")), "alphabet", "length")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_counts(D.labelled(spark, sf_dir))


def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of labels that are broken in six ways."""
    k = F.col("id") % 7
    broken = D.labelled(spark, sf_dir).withColumns({
        "key": F.when(k == 1, F.concat("key", F.lit("\t"))).otherwise(F.col("key")),
        "want": F.when(k == 2, "maybe").otherwise(F.col("want")),
        "sensitive": F.when(k == 3, F.array(F.lit(""))).when(k == 4, F.array(F.lit("absent"))).when(k == 5, F.array().cast("array<string>")).otherwise(F.col("sensitive")),
    })
    return E.label_faults(broken).groupBy("fault").agg(F.count("*").alias("n"))


def decision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed against decisions of which every fifth was otherwise."""
    new = E.judge(D.labelled(spark, sf_dir)).select(F.col("id").alias("row_no"), "key", "class", "result", "review")
    k = F.col("row_no") % 5
    old = new.withColumns({"class": F.when(k == 0, "veiled").when(k == 1, "open").otherwise(F.col("class")), "result": F.when(k == 2, "leaks").otherwise(F.col("result")), "review": F.col("review") | (k == 3)})
    return E.decision_changes(old, new)


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every project."""
    files = D.projects(spark, sf_dir)
    agent = F.col("repo").cast("int") % 2 == 1
    callers = files.select("repo").distinct().withColumns({"caller": F.when(agent, "agent").otherwise("human"), "reason": F.lit("said so")})
    found = H.health(files, D.project_vault(spark, sf_dir), callers)
    return found.select("repo", "check_no", "level", "n", F.size("places").alias("n_listed"))


def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst level of each project."""
    files = D.projects(spark, sf_dir)
    callers = files.select("repo").distinct().withColumns({"caller": F.lit("human"), "reason": F.lit("said so")})
    return H.verdicts(H.health(files, D.project_vault(spark, sf_dir), callers))


def _project_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = T.discover_files(D.projects(spark, sf_dir).where("not is_link"))
    parent = D.project_vault(spark, sf_dir).where("ref = 'db_password' and cast(repo as int) % 4 = 1").select("repo", F.lit("DB_PASSWORD").alias("name"), F.lit("from outside").alias("value"))
    outside = D.project_vault(spark, sf_dir).where("ref = 'db_password' and repo = '15'").selectExpr("repo", "'SV_NPMRC_R_AUTHTOKEN' as name", "'from outside' as value")
    records = S.parse_dotenv(found.where("kind = 'dotenv' and path in ('.env', '.env.local')")).where("kind = 'assignment'")
    # two projects set the name of a marker in a file; a third one's parent holds it
    named = records.where("repo in ('5', '10') and path = '.env.local' and key = 'API_KEY'").withColumns({"key": F.lit("SV_NPMRC_R_AUTHTOKEN"), "value": F.lit("from file"), "record_no": F.col("record_no") + 100})
    records, parent = records.unionByName(named), parent.unionByName(outside)
    return records, found.where("kind = 'npmrc'").select("repo", "path", F.col("content").alias("text")), parent


def resolved_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each project's program gets: its parent's variables, its settings and its npmrc variables."""
    records, npmrc, parent = _project_records(spark, sf_dir)
    return U.environment(records, npmrc, D.project_vault(spark, sf_dir), parent).select("repo", "origin", "name", "value")


def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, npmrc, parent = _project_records(spark, sf_dir)
    return U.missing(records, npmrc, D.project_vault(spark, sf_dir), parent)


def skipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, npmrc, parent = _project_records(spark, sf_dir)
    return U.skipped_names(records, npmrc, parent)


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.collisions(_claims(spark, sf_dir))


def renamed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with a ref that no other value has."""
    return W.rename_collisions(_claims(spark, sf_dir)).select("repo", "path", "record_no", "span_no", "ref", "new_ref")


def vault_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.all_refs(D.vault_rows(spark, sf_dir))


def environment_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = D.vault_rows(spark, sf_dir).select("repo", F.when(F.col("priority") == 1, F.concat(F.lit("SV_"), F.upper("ref"))).otherwise(F.upper("ref")).alias("name"), "value")
    return V.environment_vault(env)


def vault_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault's first source with the rows of the second put in."""
    rows = D.vault_rows(spark, sf_dir)
    new = V.chain(rows.where("priority = 1")).drop("priority")
    return V.upsert(V.chain(rows.where("priority = 0")).drop("priority"), new)


def vault_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault's first source without the refs of the second."""
    rows = D.vault_rows(spark, sf_dir)
    return V.delete(V.chain(rows.where("priority = 0")).drop("priority"), V.all_refs(rows.where("priority = 1")))


def vault_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs whose value the second source does not give back as the first does."""
    rows = D.vault_rows(spark, sf_dir)
    return V.differences(V.chain(rows.where("priority = 0")), V.chain(rows.where("priority = 1")))


def npmrc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_npmrc(D.npmrc_files(spark, sf_dir)).where("kind = 'assignment'").select("repo", "line_no", "key", "value")


def npmrc_veiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """npmrc files with variables in the place of credentials."""
    return S.render(W.veil_npmrc(S.parse_npmrc(D.npmrc_files(spark, sf_dir))))


def npmrc_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Veiled npmrc files with their values back: the files of the start."""
    veiled = W.veil_npmrc(S.parse_npmrc(D.npmrc_files(spark, sf_dir)))
    vault = W.vault_rows(veiled)
    return W.restore_files(S.parse_npmrc(S.render(veiled)), vault)


def _shared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which several of a repo claim the same references with different values; none holds a handle yet."""
    npmrc = D.npmrc_files(spark, sf_dir).selectExpr("cast(cast(repo as int) % 25 as string) as repo", "concat('apps/a', repo, '/.npmrc') as path", "content")
    return D.env_files(spark, sf_dir, (20, 21, 23, 26)).unionByName(npmrc)


def _parsed(files: DataFrame) -> DataFrame:
    npmrc = W.file_kind(F.col("path")) == "npmrc"
    return S.parse_dotenv(files.where(~npmrc)).unionByName(S.parse_npmrc(files.where(npmrc)))


def collision_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files veiled with renamed references and restored from the vault that this fills: those of the start."""
    veiled = W.veil_tree(_parsed(_shared_files(spark, sf_dir)))
    return W.restore_files(_parsed(S.render(veiled)), W.vault_rows(veiled))


def collision_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references of each repository hold a secret, and how many secrets were told apart by a new name."""
    veiled = W.veil_tree(_parsed(_shared_files(spark, sf_dir)))
    return V.unique(W.vault_rows(veiled)).groupBy("repo").agg(F.count("*").alias("n_refs"), F.count_distinct("value").alias("n_values"))


def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person reads about each entry."""
    return P.plan_report(W.veil(D.env_entries(spark, sf_dir))).select("repo", "path", "record_no", "key", "class", "rule", F.regexp_replace("shape", "entropy .*", "entropy").alias("shape"), "prefix")


def projection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each file a reader sees with a handle, and how many with a comment on what was there."""
    seen = P.projection(W.veil(D.env_entries(spark, sf_dir).where("value not like concat(chr(9), '%')")))
    lines = seen.select("repo", "path", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("repo", "path").agg(F.count("*").alias("n"), F.count_if(F.contains("line", F.lit("sv://"))).alias("n_handles"), F.count_if(F.contains("line", F.lit("    # sv: "))).alias("n_comments"))


def backup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.backup_manifest(D.trees(spark, sf_dir), "first")


def veil_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs, files and entries that veiling changes in each repository."""
    return P.summary(W.veil(D.env_entries(spark, sf_dir)))


def finding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = D.trees(spark, sf_dir)
    return P.finding_kinds(T.find_uncovered(files, files.where("false").selectExpr("repo", "path", "2L as line_no")))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.linked_files(D.projects(spark, sf_dir))


def policy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = D.projects(spark, sf_dir).where("path = '.vault/policy.toml'").select("repo", F.col("content").alias("text"))
    return G.policy_state(texts).select("repo", "state")


def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to show secrets that no person made: by session, dry runs are let through."""
    requests = D.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9973).alias("session"), (F.col("event_id") % 3 == 0).alias("dry_run"))
    return G.human_only(requests, G.detect_caller(D.sessions(spark, sf_dir)))[1].select("event_id", "caller")


def gate_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused commands of agents, as the log has them."""
    commands = D.commands(spark, sf_dir).withColumn("session", F.col("event_id") % 9973)
    return X.refusal_log(X.gate_stream(commands, D.sessions(spark, sf_dir))).groupBy("caller", "reason").agg(F.count("*").alias("n"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, chunk, done): the logs in pieces of 7 characters."""
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))
    return D.logs(spark, sf_dir).select(F.concat("id", F.lit("/1")).alias("stream_id"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("seq", "chunk")).selectExpr("stream_id", "cast(seq as long) as seq", "chunk", "seq = n - 1 as done")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of the chunks lets out, run over all of them."""
    folder = shared_folder(spark, "stream")
    stream = X.redact_stream(N.as_stream(_chunks(spark, sf_dir), folder), R.build_needles(D.secrets(spark, sf_dir)))
    return N.run_available(stream, folder)


def stream_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs redacted as they arrive, in pieces."""
    return _streamed(spark, sf_dir).select("stream_id", "text", F.size("refs").cast("long").alias("n_hits"))


def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each session, whose two outputs both print the log, counted as they arrive."""
    folder = shared_folder(spark, "stream")
    outputs = F.explode(F.array(F.lit(1), F.lit(2))).alias("fd")
    chunks = _chunks(spark, sf_dir).select(F.substring_index("stream_id", "/", 1).alias("session"), outputs, "seq", "chunk", "done")
    stream = X.hits_stream(N.as_stream(chunks, folder), R.build_needles(D.secrets(spark, sf_dir)))
    return N.latest(stream, folder, ["stream_id", "ref"])


def skipped_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vault values that are too short to be looked for."""
    return R.skipped_short(D.vault_rows(spark, sf_dir))


def suspect_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why values would deserve a second look."""
    return D.env_entries(spark, sf_dir).select("id", suspect_reason(F.col("value")).alias("reason"))


FLAGSHIP = "scan_rules"
QUERIES = {f.__name__: f for f in (scan_rules, scan_candidates, shape_profile, name_segments, classify_entries, plan_counts, vault_chain, vault_dangling, vault_orphans, vault_resolve, last_assignments, duplicate_refs, detect_caller, check_policy, project_policies, redact_logs, redact_hits, leftovers, discover_files, uncovered_lines, load_order, last_loaded, unread_files, ref_usage, guard_texts, decision_histogram, redact_commands, dotenv_records, veil_entries, miss_rate, missed_examples, open_rates, seen_share, label_counts, label_faults, decision_changes, health, health_verdicts, resolved_environment, missing_refs, skipped_names, collisions, renamed_refs, vault_refs, environment_vault, vault_upsert, vault_delete, vault_differences, npmrc_records, npmrc_veiled, npmrc_restored, collision_round_trip, collision_vault, plan_report, projection_lines, backup_manifest, veil_summary, finding_kinds, linked_files, policy_states, refused_requests, gate_commands, stream_redacted, stream_hits, skipped_short, suspect_reasons)}

SECRETS = D.SECRETS.format(s="varchar")
LOGS = D.LOGS.format(s="varchar", forms=D.FORMS.format(b64="to_base64(encode(value))", q="\\\""), secrets=SECRETS)
PARTS = "select p_partkey as id, p_partkey::varchar as repo from part"
VAULT, TEXTS = D.VAULT.format(s="varchar"), D.TEXTS.format(s="varchar")
CHAIN = f"select repo, ref, value, priority from (select *, row_number() over (partition by repo, ref order by priority, value) as rn from ({VAULT})) where rn = 1"
USED = f"select distinct repo, path, unnest(regexp_extract_all(text, 'sv://([a-z0-9_.-]+)', 1)) as ref from ({TEXTS})"
OPEN = "('empty', 'variable-reference', 'public-prefix', 'name-not-secret', 'default-open', 'already-veiled', 'unrecognised')"
PARTIAL = "('url-password', 'connection-string-password', 'bearer-token', 'url-password+url-query-credential', 'value-aws-access-key-id', 'labelled-token', 'url-query-credential')"
CLASSED = f"select *, case when want in {OPEN} then 'open' when want in {PARTIAL} then 'partial' else 'veiled' end as class, id % {D.N_BRANCHES} in {D.REVIEWED} as review from ({D.ENTRIES_SQL})"
#: Secret parts by branch: place in the value, ref suffix, value.
PARTS_TAKEN = [(2, 0, "_password", "substr(h, 1, 16)"), (3, 0, "_password", "substr(h, 1, 10)"), (4, 0, "_token", "h"), (5, 0, "_password", "substr(h, 1, 9)"), (5, 1, "_param", "substr(h, 5, 12)"), (6, 0, "", "substr(value, 5)"), (15, 0, "", "substr(value, 6)"), (22, 0, "_password", "substr(value, 10)"), (26, 0, "_param", "substr(h, 5, 12)"), (26, 1, "_param2", "substr(h, 17, 8)"), *((i, 0, "", "value") for i in (7, 9, 10, 16, 19))]
DEFAULT_REFUSALS = "[" + ", ".join(f"'{c[2]}'" if c[2] else "null" for c in D.COMMANDS) + "]"
ADVICE_SQL = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in T.ADVICE.items()) + " end"
CLAIMS = " union all ".join(f"select repo, path, key, record_no, {n} as span_no, lower(key) || '{suffix}' as ref, {value} as value from (select *, md5(concat('e', id::varchar)) as h from ({D.ENTRIES_SQL})) where id % {D.N_BRANCHES} = {i}" for i, n, suffix, value in PARTS_TAKEN)
CHARSET = "case when value = '' then 'empty' when regexp_full_match(value, '[0-9a-fA-F]+') then 'hex' when regexp_full_match(value, '[0-9A-Za-z]+') then 'alnum' when regexp_full_match(value, '[0-9A-Za-z+/=_\\-]+') then 'base64' else 'ascii' end"
CALLERS = f"""select session, coalesce(case when own_odd then 'agent' when own then 'human' when ci then 'ci' when agent is not null then 'agent' when session % 2 = 0 then 'human' end, 'agent') as caller,
  case when own_odd then '{G.OVERRIDE} holds no known caller' when own then '{G.OVERRIDE} says human' when ci then 'CI is set' when agent is not null then agent || ' is set' when session % 2 = 0 then 'input and output are a terminal' else 'no terminal and no mark' end as reason
from (select event_id % 9973 as session, bool_or(event_id % 10 = 2 and event_id % 4 <> 0) as own_odd, bool_or(event_id % 10 = 2) as own, bool_or(event_id % 20 = 10) as ci,
  min(case event_id % 10 when 1 then 'AIDER_MODEL' when 4 then 'CODEX_HOME' end) as agent from events group by session)"""
REFUSAL = "case event_id % 9 " + " ".join(f"when {i} then '{c[2]}'" for i, c in enumerate(D.COMMANDS) if c[2]) + " end"
LABELLED = "select id, " + ", ".join(f"{D.label_sql(c, 'varchar')} as {n}" for c, n in enumerate(("key", "value", "want", "part", "note"))) + " from (select o_orderkey as id from orders)"
JUDGED = f"select *, case id % 8 when 2 then 'partial' when 0 then 'veiled' when 1 then 'veiled' when 7 then 'veiled' else 'open' end as class, case id % 8 when 6 then 'leaks' when 7 then 'false-veil' else 'held' end as result, id % 8 = 5 as review from ({LABELLED})"
RANK = "case {0}.class when 'veiled' then 2 when 'partial' then 1 else 0 end"
PROJECTS = D.PROJECTS_SQL.format(s="varchar", parts=D.PARTS_SQL.format(s="varchar", part="part"))
PROJECT_VAULT = D.PROJECT_VAULT.format(s="varchar", repos="(select distinct p_partkey % 20 as r from part)")
KINDS = "select r, " + ", ".join(f"count(*) filter (where k = {k}) as k{k}" for k in range(10)) + ", count(*) filter (where k in (0, 1) and j > 0) as deep from (" + PROJECTS + ") group by r"
#: Level and number of places of each check, from the project's number and its files of each kind.
HEALTH = [
    ("case when r % 2 = 1 then 1 else 0 end", "r % 2"), ("0", "0"), ("3", "if(r % 3 = 0, k0, 0)"), ("2", "if(r % 6 = 1, k5, 0)"), ("2", "if(r % 4 = 0, k0, 0)"), ("2", "if(r % 3 = 1, k4, 0)"),
    ("2", "if(r % 2 = 0, k2, 0) + deep"), ("3", "if(r % 10 = 9, k0, if(r % 10 = 5, k3, 0))"), ("1", "if(r % 4 = 2, 1, 0)"), ("2", "if(r % 8 = 1, k8, 0)"), ("2", "r % 2"), ("3", "if(r % 7 = 0, 1, 0)"),
    ("case when r % 3 = 2 then 1 when r % 3 = 1 then 2 else 3 end", "if(r % 3 > 0 or r % 9 = 0, 1, 0)"),
]
FINDINGS = " union all ".join(f"select r::varchar as repo, {i} as check_no, if(({n}) > 0, {level}, 0) as level, ({n})::bigint as n from ({KINDS})" for i, (level, n) in enumerate(HEALTH))
NPMRC = D.NPMRC_SQL.format(s="varchar", supplier="supplier")
ONE = lambda p: f"(select repo, ref, min(value) as value from ({VAULT}) where priority = {p} group by repo, ref)"
#: The rules that candidates of the documents can meet, worked out a second way: shapes, then randomness, then doubt.
SHAPE_CASES = " ".join(f"when regexp_matches(v, '{p}') then 'value-{name}'" for p, name, _ in C.SHAPES if "://" not in p and "BEGIN" not in p)
STARTS = " or ".join(f"starts_with(v, '{x}')" for x in VENDOR_STARTS)
SCAN_RULES = f"""
with c as (select lang, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_+/=.\\-]{{16,}}')) as v from documents),
u as (select v, strlen(v) as n, regexp_full_match(v, '[0-9A-Za-z+/=_\\-]+') and regexp_matches(v, '[^0-9]') as token,
    case when regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') then 16 else 10 * regexp_matches(v, '[0-9]')::int + 26 * regexp_matches(v, '[a-z]')::int + 26 * regexp_matches(v, '[A-Z]')::int + 5 * regexp_matches(v, '[+/=_\\-]')::int end as k,
    list_filter(regexp_split_to_array(regexp_replace(regexp_replace(v, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[ _\\-./+=]'), lambda x: x <> '') as parts,
    string_split(v, '/') as segs from (select distinct v from c)),
l as (select v, count(*) as d, -sum(m / n * log2(m / n)) as h from (select v, x, count(*) as m, any_value(n) as n from (select v, n, unnest(string_split(v, '')) as x from u) group by v, x) group by v),
t as (select u.*, d, h,
    len(segs) >= 3 and len(list_filter(segs, lambda x: strlen(x) > 64)) = 0 and len(list_filter(segs, lambda x: regexp_full_match(x, '[a-z0-9._\\-]+') and strlen(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3)) >= 2 as path,
    len(list_filter(parts, lambda x: strlen(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3)) as words,
    len(list_filter(parts, lambda x: not regexp_full_match(x, '[A-Za-z]+|[0-9]+'))) as mixed, len(list_filter(parts, lambda x: strlen(x) = 1)) as single, list_sum(list_transform(parts, lambda x: strlen(x))) as total from u join l using (v)),
r as (select *, n <= 128 and len(parts) >= 3 and mixed = 0 and single <= 1 and words * 4 >= len(parts) * 3 and words >= 3 and total * 2 >= len(parts) * 7 as ident from t),
q as (select *, n >= 20 and token and n * log2(k) >= 80 and not path and not ident and d >= floor(k * (1 - pow(1 - 1 / k, n)) / 2)
    and h >= log2(k) - (k - 1) * pow(1 - 2 / (9 * (k - 1)) + 3.090232 * sqrt(2 / (9 * (k - 1))), 3) / (2 * n * ln(2)) as random from r),
z as (select v, case {SHAPE_CASES} when random then 'entropy' when {STARTS} or (token and not path and not ident and not (len(parts) >= 2 and len(list_filter(parts, lambda x: not regexp_full_match(x, '[a-z]{{3,}}'))) = 0)) then 'unrecognised' else 'default-open' end as rule from q)
select lang, rule, count(*) as n from c join z using (v) group by lang, rule"""
ORACLES = {
    "scan_rules": SCAN_RULES,
    "scan_candidates": "select lang, count(*) as n, count(distinct v) as n_values from (select lang, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_+/=.\\-]{16,}')) as v from documents) group by lang",
    "shape_profile": f"""
with e as ({D.ENTRIES_SQL}), b as (select id, substr(hex(encode(value)), 2 * i - 1, 2) as x from (select id, value, unnest(range(1, strlen(value) + 1)) as i from e)),
c as (select id, x, count(*) as n from b group by id, x), t as (select id, sum(n) as total from c group by id),
h as (select id, count(*) as n_distinct, round(sum(-n / total * log2(n / total)), 6) as entropy from c join t using (id) group by id)
select e.id, strlen(value)::bigint as n_bytes, case when value = '' then 'empty' when regexp_full_match(value, '[0-9a-fA-F]+') then 'hex' when regexp_full_match(value, '[0-9A-Za-z]+') then 'alnum'
  when regexp_full_match(value, '[0-9A-Za-z+/=_\\-]+') then 'base64' else 'ascii' end as charset, coalesce(n_distinct, 0)::bigint as n_distinct, coalesce(entropy, 0.0) as entropy
from e left join h on e.id = h.id""",
    "name_segments": f"select key, upper(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'), lambda x: x <> ''), ' ')) as segments, count(*) as n from ({D.ENTRIES_SQL}) group by key",
    "classify_entries": f"select id, class, want as rule, review from ({CLASSED})",
    "plan_counts": f"select repo, count(distinct path) as n_files, count(*) filter (where class = 'open') as n_open, count(*) filter (where class = 'partial') as n_partial, count(*) filter (where class = 'veiled') as n_veiled, count(*) filter (where review) as n_review from ({CLASSED}) group by repo",
    "vault_chain": f"select repo, ref, value, priority::bigint as priority from ({CHAIN})",
    "vault_dangling": f"select repo, ref, string_agg(path, ',' order by path) as files, count(*) as n_files from ({USED}) u where not exists (select 1 from ({VAULT}) v where v.repo = u.repo and v.ref = u.ref) group by repo, ref",
    "vault_orphans": f"select repo, ref from ({CHAIN}) c where not exists (select 1 from ({USED}) u where u.repo = c.repo and u.ref = c.ref)",
    "vault_resolve": f"""select t.repo, path, record_no, concat('a=', coalesce(x.value, 'sv://' || r1), ' b=', coalesce(y.value, 'sv://' || r2), tail) as text
from (select *, regexp_extract(text, 'a=sv://([a-z0-9_]+)', 1) as r1, regexp_extract(text, 'b=sv://([a-z0-9_]+)', 1) as r2, regexp_extract(text, ' tail$') as tail from ({TEXTS})) t
left join ({CHAIN}) x on x.repo = t.repo and x.ref = r1 left join ({CHAIN}) y on y.repo = t.repo and y.ref = r2""",
    "last_assignments": f"select repo, path, key, max(record_no) as record_no from ({D.ENTRIES_SQL}) group by repo, path, key",
    "duplicate_refs": f"select repo, ref, string_agg(distinct owner, ',' order by owner) as owners, count(distinct value) as n_values from (select (repo::int % 3)::varchar as repo, ref, value, repo || '/' || path || ':' || key as owner from ({CLAIMS})) group by repo, ref having count(distinct owner) > 1",
    "detect_caller": CALLERS,
    "check_policy": "select event_id, case event_id % 9 " + " ".join(f"when {i} then '{c[1]}'" for i, c in enumerate(D.COMMANDS)) + " end as program, case event_id % 9 " + " ".join(f"when {i} then '{c[2]}'" for i, c in enumerate(D.COMMANDS) if c[2]) + " end as refusal from events",
    "redact_logs": f"select repo, id, concat('café sv://', ref, case when form = 1 then right(to_base64(encode(value)), 4) else '' end, '; twice sv://', ref, ' end') as text, 2::bigint as n_hits from ({LOGS})",
    "redact_hits": f"select repo, ref, 2 * count(*) as n from ({LOGS}) group by repo, ref",
    "leftovers": f"select repo, id as path, ref, 1::bigint as line_no, 'warn' as level from ({LOGS})",
    "discover_files": f"select repo, {D.PATHS_SQL} as path, case when id % 10 = 1 then 'npmrc' else 'dotenv' end as kind from ({PARTS}) where id % 10 in (1, 6, 7, 9)",
    "project_policies": f"""with c as (select event_id, (event_id % 20)::varchar as repo, (event_id % 9)::int as c, (event_id % 5)::int as p from events),
r as (select event_id, repo, {[x[1] for x in D.COMMANDS]}[c + 1] as program, case p when 0 then {DEFAULT_REFUSALS}[c + 1] when 4 then 'invalid-policy'
  when 2 then ['deny-list', 'deny-list', 'inline-code', 'not-allowed', 'inline-code', 'inline-code', 'no-use', 'not-allowed', null][c + 1]
  when 3 then [null, null, 'inline-code', 'inline-code', 'inline-code', 'no-use', 'no-use', null, 'deny-list'][c + 1] end as refusal from c)
select *, {" ".join(["case refusal", *(f"when '{k}' then '{v}'" for k, v in G.ADVICE.items())])} end as advice from r""",
    "uncovered_lines": f"select *, {ADVICE_SQL} as advice from (select repo, path, case id % 10 when 0 then '.netrc' when 1 then '.npmrc' when 3 then 'aws credentials' else '.envrc' end as kind, '2' as lines from (select *, {D.PATHS_SQL} as path from ({PARTS})) where id % 10 in (0, 1, 3, 5) and id % 20 <> 1)",
    "load_order": f"select repo, string_agg(distinct path, ' ' order by path) as files from ({D.ENTRIES_SQL}) group by repo",
    "last_loaded": f"select repo, key, path, record_no from (select *, row_number() over (partition by repo, key order by path desc, record_no desc) as rn from ({D.ENTRIES_SQL})) where rn = 1",
    "unread_files": f"select distinct repo, path from ({TEXTS}) where path = 'app/.env'",
    "ref_usage": f"select repo, ref, string_agg(path, ',' order by path) as files from ({USED}) group by repo, ref",
    "guard_texts": f"select id::varchar as path, want as rule from ({D.ENTRIES_SQL}) where want like 'value-%' and not (want = 'value-aws-access-key-id' and id % 40 = 6) union all select 'k' || id, 'value-private-key' from ({D.ENTRIES_SQL}) where want = 'labelled-token'",
    "decision_histogram": f"select class, want as rule, count(*) as n from ({CLASSED}) group by class, want union all select class, null, count(*) from ({CLASSED}) group by class",
    "redact_commands": "select event_id, concat(case event_id % 9 " + " ".join(f"when {i} then '{'|'.join(c[0])}'" for i, c in enumerate(D.COMMANDS)) + " end, '|--api-key|[hidden]|--token=[hidden]|Authorization: Bearer [hidden]') as command from events",
    "dotenv_records": f"select repo, path, 2 * row_number() over (partition by repo, path order by id) as line_no, key, value from ({D.ENTRIES_SQL}) where id % {D.N_BRANCHES} not in (20, 21)",
    "veil_entries": f"""select id, class, case id % {D.N_BRANCHES} when 2 then 'postgres://app:sv://database_url_password@db.internal:5432/app' when 3 then 'Server=db;Password=sv://conn_password;Port=1'
  when 4 then 'Bearer sv://header_line_token' when 5 then 'https://app:sv://gateway_password@gw.io/x?token=sv://gateway_param' when 6 then concat('AK', 'IAsv://cloud') when 15 then 'main:sv://bot' when 22 then 'Password=sv://app_conn_password' when 26 then 'https://app:sv://gateway_password@gw.io/x?token=sv://gateway_param&key=sv://gateway_param2'
  else case when class = 'open' then value else concat('sv://', lower(key)) end end as projected, (case when class = 'open' then 0 when id % {D.N_BRANCHES} in (5, 26) then 2 else 1 end)::bigint as n_secrets from ({CLASSED})""",
    "miss_rate": f"select note, count(*) as n, count(*) filter (where result = 'leaks') as n_missed, round(avg((result = 'leaks')::int), 6) as rate from ({JUDGED}) where want = 'secret' group by grouping sets ((note), ())",
    "missed_examples": f"select id, key, note, 'default-open' as rule from ({JUDGED}) where want = 'secret' and result = 'leaks' order by id limit 12",
    "open_rates": f"select count(*) as n, count(*) filter (where class <> 'open') as n_veiled, round(avg((class <> 'open')::int), 6) as veiled_rate, count(*) filter (where review) as n_review, round(avg(review::int), 6) as review_rate from ({JUDGED}) where want = 'open'",
    "seen_share": """select alphabet, length, count(*) as n, count(*) filter (where seen) as n_seen, round(avg(seen::int), 6) as seen from (
  select alphabet, length, alphabet = 'mixed' or regexp_matches(substr(md5(id::varchar), 1, length), '[a-f]') as seen from (
    select o_orderkey as id, case o_orderkey % 3 when 0 then 16 when 1 then 18 else 19 end as length, if((o_orderkey // 3) % 2 = 0, 'hex', 'mixed') as alphabet from orders)) group by alphabet, length""",
    "label_counts": f"select want, count(*) as n, count(distinct key) as n_keys from ({LABELLED}) group by want",
    "label_faults": f"""select fault, count(*) as n from (select case when id % 7 = 1 then 'white space' when id % 7 = 2 then 'want' when want = 'open' and id % 7 in (3, 4) then 'open with sensitive parts'
  when want = 'secret' and id % 7 = 5 then 'nothing sensitive' when want = 'secret' and id % 7 = 3 then 'empty part' when want = 'secret' and id % 7 = 4 then 'part not in value' end as fault from ({LABELLED})) where fault is not null group by fault""",
    "decision_changes": f"""with b as (select id, key, class, result, review from ({JUDGED})),
a as (select id, key, case id % 5 when 0 then 'veiled' when 1 then 'open' else class end as class, if(id % 5 = 2, 'leaks', result) as result, review or id % 5 = 3 as review from b)
select * from (select id as row_no, b.key, case when (a.result <> 'leaks' and b.result = 'leaks') or {RANK.format('b')} < {RANK.format('a')} then 'less-safe'
  when (a.result = 'leaks' and b.result <> 'leaks') or {RANK.format('b')} > {RANK.format('a')} then 'safer' when a.review and not b.review then 'no-longer-reported' end as change from a join b using (id)) where change is not null""",
    "health": f"select *, (least(n, 8) + (n > 8)::int)::int as n_listed from ({FINDINGS})",
    "health_verdicts": f"select repo, max(level) as worst, (max(level) = 3)::int as exit_code from ({FINDINGS}) where check_no > 0 group by repo",
    "resolved_environment": f"""with p as (select *, r::int as n from ({PROJECTS}) where path = '.env')
select repo, 0 as origin, 'DB_PASSWORD' as name, 'from outside' as value from p where n % 4 = 1 union all select repo, 1, 'API_KEY', 'open' from p
union all select repo, 1, 'DB_PASSWORD', db from p where n % 4 <> 1 union all select repo, 1, 'LEFT_TOKEN', db from p where n % 3 = 0
union all select repo, 1, 'MEMO', 'Xy7' || substr(h, 1, 11) from p where n % 4 = 0
union all select repo, case n when 15 then 0 when 0 then 2 else 1 end, 'SV_NPMRC_R_AUTHTOKEN', case n when 15 then 'from outside' when 5 then 'from file' else 'tokenvalue' end from p where n % 5 = 0""",
    "missing_refs": f"select distinct r::varchar as repo, if(r % 10 = 9, 'api_key', 'npmrc_r_authtoken') as ref from ({PROJECTS}) where r % 10 in (5, 9) and r <> 15",
    "skipped_names": f"select distinct r::varchar as repo, 'DB_PASSWORD' as name from ({PROJECTS}) where r % 4 = 1 union all select distinct '15', 'SV_NPMRC_R_AUTHTOKEN' from ({PROJECTS}) where r = 15",
    "collisions": f"select repo, ref, count(distinct value) as n_values from ({CLAIMS}) group by repo, ref having count(distinct value) > 1",
    "renamed_refs": f"""with c as (select *, count(distinct value) over (partition by repo, ref) as n, row_number() over (partition by repo, ref order by path, record_no, span_no) as k from ({CLAIMS})),
m as (select *, row_number() over (partition by repo, ref, path order by record_no, span_no) as q from c where n > 1 and k > 1),
t as (select repo, path, record_no, span_no, ref, trim(replace(path, '.', '_'), '_') || '_' || ref || if(q = 1, '', '_' || q) as new_ref from m)
select repo, path, record_no, span_no, ref, ref as new_ref from c where n = 1 or k = 1 union all select * from t""",
    "vault_refs": f"select distinct repo, ref from ({VAULT})",
    "environment_vault": f"select repo, ref, value from ({VAULT}) where priority = 1",
    "vault_upsert": f"select * from {ONE(1)} union all select * from {ONE(0)} o where not exists (select 1 from {ONE(1)} n where n.repo = o.repo and n.ref = o.ref)",
    "vault_delete": f"select * from {ONE(0)} o where not exists (select 1 from {ONE(1)} n where n.repo = o.repo and n.ref = o.ref)",
    "vault_differences": f"select o.repo, o.ref from {ONE(0)} o left join {ONE(1)} n on n.repo = o.repo and n.ref = o.ref where n.value is distinct from o.value",
    "npmrc_records": " union all ".join(f"select s_suppkey::varchar as repo, {n}::bigint as line_no, '{k}' as key, {v} as value from supplier" for n, k, v in ((1, "registry", "'https://r.io/'"), (2, "//r.io/:_authToken", "md5(s_suppkey::varchar)"), (3, "//q.io/:_auth", "'\"quoted\"'"), (5, "_password", "'${X}'"), (6, "//b.io/:_password", "substr(md5(s_suppkey::varchar), 1, 9)"))),
    "npmrc_veiled": f"select repo, path, replace(replace(content, '_authToken=' || md5(repo), '_authToken=${{SV_NPMRC_R_IO_AUTHTOKEN}}'), '_password=' || substr(md5(repo), 1, 9), '_password=${{SV_NPMRC_B_IO_PASSWORD}}') as content from ({NPMRC})",
    "npmrc_restored": f"select repo, path, content from ({NPMRC})",
    "collision_round_trip": f"""select repo, path, string_agg('# no ' || id || chr(10) || case id % 3 when 0 then key || '=' || value
    when 1 then 'export ' || key || ' = "' || value || '" # note' else key || '=' || chr(39) || value || chr(39) || chr(13) end || chr(10), '' order by id) as content
  from ({D.ENTRIES_SQL}) where id % {D.N_BRANCHES} not in (20, 21, 23, 26) group by repo, path
union all select (repo::int % 25)::varchar, 'apps/a' || repo || '/.npmrc', content from ({NPMRC})""",
    "collision_vault": f"""with c as (
  select repo, ref, value from ({CLAIMS}) where record_no % {D.N_BRANCHES} <> 26
  union all select (repo::int % 25)::varchar, 'npmrc_r_io_authtoken', md5(repo) from ({NPMRC}) union all select (repo::int % 25)::varchar, 'npmrc_b_io_password', substr(md5(repo), 1, 9) from ({NPMRC})),
r as (select repo, ref, case count(distinct value) when 1 then 1 else count(*) end as n from c group by repo, ref)
select repo, sum(n)::bigint as n_refs, any_value(n_values) as n_values from r join (select repo, count(distinct value) as n_values from c group by repo) using (repo) group by repo""",
    "plan_report": f"select repo, path, record_no, key, class, want as rule, case when review then '<- read this one' when class = 'open' then '' else strlen(value) || ' chars, ' || {CHARSET} || ', entropy' end as shape, if(want = 'value-aws-access-key-id', left(value, 4), '') as prefix from ({CLASSED})",
    "projection_lines": f"select repo, path, count(*) as n, count(*) filter (where class <> 'open' or id % {D.N_BRANCHES} = 23) as n_handles, count(*) filter (where class <> 'open') as n_comments from ({CLASSED}) where id % {D.N_BRANCHES} not in (20, 21) group by repo, path",
    "backup_manifest": f"select 'first' as run_id, repo, path, strlen(content)::bigint as n_bytes, sha256(content) as sha256 from (select repo, {D.PATHS_SQL} as path, {D.CONTENT_SQL} as content from (select *, md5(id::varchar) as h from ({PARTS})))",
    "veil_summary": f"select repo, count(distinct ref) as n_secrets, count(distinct path) as n_files, count(distinct (path, record_no)) as n_entries from ({CLAIMS}) group by repo",
    "finding_kinds": f"select kind, place, count(*) as n from (select case id % 10 when 0 then '.netrc' when 1 then '.npmrc' when 3 then 'aws credentials' else '.envrc' end as kind, case id % 10 when 0 then 1 when 1 then 0 when 3 then 7 else 8 end as place from ({PARTS}) where id % 10 in (0, 1, 3, 5)) group by kind, place",
    "linked_files": f"select repo, path from ({PROJECTS}) where is_link",
    "policy_states": f"select repo, case when r % 3 = 1 then 'off' when r % 9 = 0 then 'invalid' else 'on' end as state from ({PROJECTS}) where path = '.vault/policy.toml'",
    "refused_requests": f"select event_id, caller from events join ({CALLERS}) c on c.session = event_id % 9973 where caller <> 'human' and event_id % 3 <> 0",
    "gate_commands": f"select caller, reason, count(*) as n from (select c.caller, {REFUSAL} as reason from events join ({CALLERS}) c on c.session = event_id % 9973 where c.caller = 'agent') where reason is not null group by caller, reason",
    "stream_redacted": f"select id || '/1' as stream_id, concat('café sv://', ref, case when form = 1 then right(to_base64(encode(value)), 4) else '' end, '; twice sv://', ref, ' end') as text, 2::bigint as n_hits from ({LOGS})",
    "stream_hits": f"select id as stream_id, ref, 4::bigint as n from ({LOGS})",
    "skipped_short": f"select distinct repo, ref from ({VAULT}) where strlen(value) < 6",
    "suspect_reasons": f"""select id, case when id % 27 in (6, 7) or (id % 27 in (16, 25) and regexp_matches(value, '^(AKIA|ASIA|AIza|SK|eyJ|shp|sq0|xox)')) then 'vendor-start'
  when id % 27 in (14, 16, 25) then 'long' when id % 27 = 24 then 'mixed-case-digits' end as reason from ({D.ENTRIES_SQL})""",
}
