"""Which caller runs a command, and whether policy lets it."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shape import stripped

# Variables that mark a build machine, in order, and those that mark an agent (a final _ stands for any ending).
CI_MARKERS = "CI CONTINUOUS_INTEGRATION GITHUB_ACTIONS GITLAB_CI BUILDKITE CIRCLECI TRAVIS JENKINS_URL TEAMCITY_VERSION BITBUCKET_BUILD_NUMBER TF_BUILD".split()
AGENT_MARKERS = "CLAUDECODE CLAUDE_CODE CLAUDE_CODE_ENTRYPOINT ANTHROPIC_AGENT CURSOR_TRACE_ID CURSOR_SESSION_ID AIDER_ CLINE_ ROO_CODE_ CONTINUE_ WINDSURF_ CODEX_ OPENAI_AGENT COPILOT_AGENT GEMINI_CLI ZED_TERM OPENCODE_ AMP_".split()
# Programs that are always refused, and flags that run code from the command line (none: any use).
DENY = "sh bash zsh dash fish ksh csh tcsh ash busybox pwsh powershell cmd cmd.exe env printenv set export declare printf".split()
INLINE = {"node": "-e --eval -p --print", "deno": "eval", "bun": "-e --eval", "python": "-c", "python3": "-c", "ruby": "-e", "perl": "-e -E", "php": "-r", "lua": "-e", "R": "-e", "ssh": ""}
OVERRIDE = "VAULT_CALLER"


@dataclass(frozen=True)
class Policy:
    """The rules for agents; an empty allow list lets every program through that no other rule refuses."""

    enforce: bool = True
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = tuple(DENY)
    inline_code: dict[str, tuple[str, ...]] = field(default_factory=lambda: {p: tuple(f.split()) for p, f in INLINE.items()})


def load_policy(text: str | None) -> Policy:
    """The rules of a project's TOML text, read once on the driver; None gives the default.

    What the text leaves out keeps its default, a list in it replaces the default list, a table of flags replaces those of
    the programs that it names. A setting that nobody knows is an error."""
    if text is None:
        return Policy()
    given = tomllib.loads(text)
    agent = given.pop("agent", {})
    if odd := sorted([*given, *(set(agent) - {"enforce", "allow", "deny", "inline_code"})]):
        raise ValueError(f"the policy holds a setting nobody knows: {odd[0]}")
    base = Policy()
    if not isinstance(agent.get("enforce", True), bool):
        raise ValueError("enforce is true or false")
    names = lambda key, default: tuple(map(str, agent[key])) if key in agent else default
    flags = base.inline_code | {p: tuple(map(str, f)) for p, f in agent.get("inline_code", {}).items()}
    return Policy(agent.get("enforce", base.enforce), names("allow", base.allow), names("deny", base.deny), flags)


def policy_state(texts: DataFrame) -> DataFrame:
    """`texts` (repo, text) with `state`: missing, invalid, off or on. One small row a repo, read in tasks."""

    def state(text: str | None) -> str:
        if text is None:
            return "missing"
        try:
            return "on" if load_policy(text).enforce else "off"
        except (ValueError, TypeError, AttributeError):  # TOML errors are ValueErrors
            return "invalid"

    read = F.pandas_udf(lambda s: s.map(lambda t: state(None if t is None or t != t else t)), "string")
    return texts.withColumn("state", read("text"))


def detect_caller(env: DataFrame, override: str = OVERRIDE) -> DataFrame:
    """(session, caller, reason) from (session, name, value, is_tty): an override, then build marks in their order, then the
    least name of an agent mark, then a terminal; whoever can't be told is an agent."""
    name, value = F.col("name"), F.col("value")
    said = F.lower(stripped(value))
    own = F.when(said.isin("human", "user", "person"), "human").when(said.isin("ci", "pipeline", "build"), "ci").when(said.isin("agent", "ai", "bot"), "agent").otherwise("unknown")
    exact = [m for m in AGENT_MARKERS if not m.endswith("_")]
    agent = name.isin(exact) | name.rlike(r"\A(" + "|".join(m for m in AGENT_MARKERS if m.endswith("_")) + ")")
    order = F.array_position(F.array(*map(F.lit, CI_MARKERS)), name)
    seen = env.groupBy("session").agg(
        F.max(F.when(name == override, own)).alias("own"),
        F.min(F.when((order > 0) & ~value.isin("", "false", "0"), order)).alias("ci"),
        F.min(F.when(agent, name)).alias("agent"),
        F.max("is_tty").alias("tty"),
    )
    is_set = lambda c: F.concat(c, F.lit(" is set"))
    why = (
        F.when(F.col("own") == "unknown", F.struct(F.lit("agent").alias("caller"), F.lit(override + " holds no known caller").alias("reason")))
        .when(F.col("own").isNotNull(), F.struct(F.col("own").alias("caller"), F.concat(F.lit(override + " says "), "own").alias("reason")))
        .when(F.col("ci").isNotNull(), F.struct(F.lit("ci").alias("caller"), is_set(F.get(F.array(*map(F.lit, CI_MARKERS)), (F.col("ci") - 1).cast("int"))).alias("reason")))
        .when(F.col("agent").isNotNull(), F.struct(F.lit("agent").alias("caller"), is_set(F.col("agent")).alias("reason")))
        .when(F.col("tty"), F.struct(F.lit("human").alias("caller"), F.lit("input and output are a terminal").alias("reason")))
        .otherwise(F.struct(F.lit("agent").alias("caller"), F.lit("no terminal and no mark").alias("reason")))
    )
    return seen.select("session", why.alias("w")).select("session", "w.*")


#: What to do about each refusal.
ADVICE = {
    "deny-list": "run it in a terminal of your own, or run the real command without a shell around it",
    "no-use": "run it in a terminal of your own",
    "inline-code": "put the code in a file and run the file",
    "not-allowed": "add it to the allow list of the policy",
    "invalid-policy": "mend the policy file of the project",
}


def read_argv(commands: DataFrame, argv: str) -> DataFrame:
    """`commands` with `program`, the base name of its first word, and `_heads`, what its flags begin with, up to `--`."""
    program = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.get(argv, 0), r"[^/\\]*\z", 0), r"\.exe\z", ""), r"\.EXE\z", "")
    heads = F.transform(F.slice(argv, 2, F.greatest(F.size(argv), F.lit(1))), lambda a: F.when(F.locate("=", a) > 1, F.split_part(a, F.lit("="), F.lit(1))).otherwise(a))
    stop = F.array_position(F.col(argv), "--")
    heads = F.when(stop > 1, F.slice(heads, 1, (stop - 2).cast("int"))).otherwise(heads)
    return commands.withColumns({"program": program, "_heads": heads})


def advised(ruled: DataFrame) -> DataFrame:
    return ruled.withColumn("advice", F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))[F.col("refusal")])


def check_policy(commands: DataFrame, argv: str = "argv", policy: Policy | None = None) -> DataFrame:
    """`commands` with `program`, `refusal` (deny-list, no-use, inline-code, not-allowed, or null) and `advice`."""
    policy = policy or Policy()
    flags = [F.when((F.col("program") == p) & F.arrays_overlap("_heads", F.array(*map(F.lit, f))), "inline-code") for p, f in policy.inline_code.items() if f]
    none = [p for p, f in policy.inline_code.items() if not f]
    allowed = F.when(~F.col("program").isin(*policy.allow), "not-allowed") if policy.allow else F.lit(None).cast("string")
    refusal = F.coalesce(F.when(F.col("program").isin(*policy.deny), "deny-list"), F.when(F.col("program").isin(*none), "no-use"), *flags, allowed)
    ruled = read_argv(commands, argv).withColumn("refusal", F.when((F.size(argv) > 0) & F.lit(policy.enforce), refusal)).drop("_heads")
    return advised(ruled)


COMPILED = "repo string, state string, allows boolean, rules array<struct<program: string, deny: boolean, allow: boolean, no_use: boolean, flags: array<string>>>"


def compiled(text: str | None) -> tuple[str, bool, list[tuple]]:
    """(state, whether there is an allow list, a rule for each program that it names) of a policy text."""
    try:
        policy = load_policy(text)
    except (ValueError, TypeError, AttributeError):
        return "invalid", False, []
    programs = sorted({*policy.allow, *policy.deny, *policy.inline_code})
    rules = [(p, p in policy.deny, p in policy.allow, policy.inline_code.get(p) == (), list(policy.inline_code.get(p, ()))) for p in programs]
    return "on" if policy.enforce else "off", bool(policy.allow), rules


def check_project_policies(commands: DataFrame, policies: DataFrame, argv: str = "argv") -> DataFrame:
    """`commands` (repo, argv, ...) with `program`, `refusal` and `advice` by the policy of their repo; (repo, text) in `policies`.

    A repo without a row, or with a null text, has the default policy; under a text that can't be read every command is
    refused. Texts are read in tasks, one small row a repo; commands meet the rules in joins by repo and program, so that
    neither the number of repos nor that of programs makes the plan larger."""

    def read(batches):
        for frame in batches:
            rows = [(r, *compiled(None if t is None or t != t else t)) for r, t in zip(frame["repo"], frame["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["repo", "state", "allows", "rules"])

    own = policies.where("repo is not null").select("repo", "text").mapInPandas(read, COMPILED)
    known = own.select("repo", F.lit(True).alias("_own"), "state", "allows")
    default = commands.sparkSession.createDataFrame([("", *compiled(None))], COMPILED)
    every = own.withColumn("_own", F.lit(True)).unionByName(default.withColumn("_own", F.lit(False)))
    rules = every.select("_own", F.col("repo").alias("_policy"), F.explode("rules").alias("r")).select("_own", "_policy", "r.*")
    asked = read_argv(commands, argv).join(known, "repo", "left").withColumn("_own", F.coalesce("_own", F.lit(False))).withColumn("_policy", F.when(F.col("_own"), F.col("repo")).otherwise(""))
    met = asked.join(rules, ["_own", "_policy", "program"], "left")
    refusal = (
        F.when(F.size(argv) <= 0, None).when(F.col("state") == "invalid", "invalid-policy").when(F.col("state") == "off", None).when(F.col("deny"), "deny-list").when(F.col("no_use"), "no-use")
        .when(F.arrays_overlap("_heads", "flags"), "inline-code").when(F.col("allows") & ~F.coalesce("allow", F.lit(False)), "not-allowed")
    )
    return advised(met.withColumn("refusal", refusal).select(*commands.columns, "program", "refusal"))


def human_only(requests: DataFrame, callers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused) of `requests` (session, dry_run, ...): only people may have secrets shown or restored; a dry run is open."""
    known = requests.join(callers, "session", "left").withColumn("caller", F.coalesce("caller", F.lit("agent")))
    may = (F.col("caller") == "human") | F.coalesce("dry_run", F.lit(False))
    return known.where(may), known.where(~may)
