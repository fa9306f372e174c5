"""Inputs that Spark derives from the given tables: entries, vaults, texts with handles, sessions and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASKS = 16  # of narrow tables at least, for executors may register late


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows in many tasks: a narrow table is a small file, so a single task, however much is made of each of its rows."""
    return rows.repartition(max(TASKS, rows.sparkSession.sparkContext.defaultParallelism), key)


#: (name, value, rule) by branch, as SQL that Spark and DuckDB share; {h} is 32 hex digits, {b} 43 mixed characters.
BRANCHES = [
    ("'APP_LABEL'", "''", "empty"),
    ("'DB_PASSWORD'", "'$ROOT_PW'", "variable-reference"),
    ("'DATABASE_URL'", "concat('postgres://app:', substr({h}, 1, 16), '@db.internal:5432/app')", "url-password"),
    ("'CONN'", "concat('Server=db;Password=', substr({h}, 1, 10), ';Port=1')", "connection-string-password"),
    ("'HEADER_LINE'", "concat('Bearer ', {h})", "bearer-token"),
    ("'GATEWAY'", "concat('https://app:', substr({h}, 1, 9), '@gw.io/x?token=', substr({h}, 5, 12))", "url-password+url-query-credential"),
    ("'CLOUD'", "concat('AK', 'IA', upper(substr({h}, 1, 16)))", "value-aws-access-key-id"),
    ("'FORGE'", "concat('gh', 'p_', {h}, substr({h}, 1, 8))", "value-github-token"),
    ("'NEXT_PUBLIC_MAP_KEY'", "substr({h}, 1, 12)", "public-prefix"),
    ("'NEXT_PUBLIC_CLIENT_SECRET'", "substr({h}, 1, 12)", "name-secret"),
    ("'serviceToken'", "'hunter2'", "name-secret"),
    ("'REFRESH_TOKEN_TTL_DAYS'", "cast(id % 90 as {s})", "name-not-secret"),
    ("'DB_PASSWORD_FILE'", "'/run/secrets/db'", "name-not-secret"),
    ("'LOG_LEVEL'", "'debug'", "name-not-secret"),
    ("'GIT_SHA'", "{h}", "name-not-secret"),
    ("'BOT'", "concat('main:', {b})", "labelled-token"),
    ("'OTHER'", "{b}", "entropy"),
    ("'GREETING'", "'hello world'", "default-open"),
    ("'PAGER_LIST'", "'one/two_three/four-five'", "default-open"),
    ("'API_KEY_SECRET_NAME'", "'billing'", "name-secret"),
    ("'SPARE'", "concat(chr(9), chr(10))", "empty"),
    ("'API_KEY'", "concat(chr(9), '${{', 'OTHER}}', chr(9))", "variable-reference"),
    ("'APP_CONN'", "concat('Password=https://x.io/?token=', substr({h}, 1, 12))", "connection-string-password"),
    ("'API_KEY'", "'sv://api_key'", "already-veiled"),
    ("'MEMO'", "concat('Xy7', substr({h}, 1, 11))", "unrecognised"),
    ("'NEXT_PUBLIC_WIDGET'", "{b}", "public-prefix"),
    ("'GATEWAY'", "concat('https://app:sv://gateway_password@gw.io/x?token=', substr({h}, 5, 12), '&key=', substr({h}, 17, 8))", "url-query-credential"),
]
N_BRANCHES = len(BRANCHES)
REVIEWED = (24, 25)  # branches whose open value is marked for review


def case(which: int, h: str, b: str, s: str) -> str:
    rows = " ".join(f"when {i} then {x[which].format(h=h, b=b, s=s) if which < 2 else repr(x[which])}" for i, x in enumerate(BRANCHES))
    return f"case id % {len(BRANCHES)} {rows} end"


def env_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, record_no, key, value, want) from customer: one branch for each rule."""
    h, b = "md5(concat('e', cast(id as string)))", "substr(base64(unhex(concat(md5(concat('e', cast(id as string))), md5(concat('f', cast(id as string)))))), 1, 43)"
    rows = spread(read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_nationkey as string) as repo"), "id")
    return rows.selectExpr("id", "repo", "case when id % 3 = 0 then '.env' else '.env.local' end as path", "cast(id as int) as record_no", f"{case(0, h, b, 'string')} as key", f"{case(1, h, b, 'string')} as value", f"{case(2, h, b, 'string')} as want")


ENTRIES_SQL = f"""select id, repo, case when id % 3 = 0 then '.env' else '.env.local' end as path, id::int as record_no,
  {case(0, "h", "b", "varchar")} as key, {case(1, "h", "b", "varchar")} as value, {case(2, "h", "b", "varchar")} as want
from (select c_custkey as id, c_nationkey::varchar as repo, md5(concat('e', c_custkey::varchar)) as h,
  substr(to_base64(unhex(concat(md5(concat('e', c_custkey::varchar)), md5(concat('f', c_custkey::varchar))))), 1, 43) as b from customer)"""

VAULT = "select cast(s_nationkey as {s}) as repo, concat('ref_', cast(s_suppkey % 40 as {s})) as ref, concat('v', cast(s_suppkey as {s})) as value, s_suppkey % 3 as priority from supplier"
TEXTS = "select cast(c_nationkey as {s}) as repo, case when c_custkey % 2 = 0 then '.env' else 'app/.env' end as path, cast(c_custkey as int) as record_no, concat('a=sv://ref_', cast(c_custkey % 50 as {s}), ' b=sv://ref_', cast(c_custkey % 7 as {s}), case when c_custkey % 4 = 0 then ' tail' else '' end) as text from customer"


def vault_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VAULT.format(s="string").replace("supplier", "{supplier}"), supplier=read(spark, sf_dir, "supplier"))


def handle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXTS.format(s="string").replace("from customer", "from {customer}"), customer=read(spark, sf_dir, "customer"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, name, value, is_tty) from events: a variable for each event."""
    e = F.col("event_id")
    name = F.when(e % 10 == 0, "CI").when(e % 10 == 1, "AIDER_MODEL").when(e % 10 == 2, "VAULT_CALLER").when(e % 10 == 3, "TRAVIS").when(e % 10 == 4, "CODEX_HOME").otherwise("PATH")
    value = F.when(e % 10 == 0, F.when(e % 20 == 0, "false").otherwise("true")).when(e % 10 == 2, F.when(e % 4 == 0, " Human").otherwise("robot")).otherwise("")
    return read(spark, sf_dir, "events").select((e % 9973).alias("session"), name.alias("name"), value.alias("value"), ((e % 9973) % 2 == 0).alias("is_tty"))


#: argv by event, and the program and refusal that policy gives.
COMMANDS = [
    (["bash", "-c", "ls"], "bash", "deny-list"),
    (["/usr/bin/zsh"], "zsh", "deny-list"),
    (["node", "app.js", "-e"], "node", "inline-code"),
    (["node", "app.js", "--", "-e"], "node", None),
    (["python3", "-c=print(1)"], "python3", "inline-code"),
    (["C:\\tools\\perl.exe", "-E", "say 1"], "perl", "inline-code"),
    (["ssh", "host"], "ssh", "no-use"),
    (["npm", "run", "build"], "npm", None),
    (["git", "status"], "git", None),
]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, argv) from events."""
    pick = F.array(*(F.array(*map(F.lit, c[0])) for c in COMMANDS))
    return read(spark, sf_dir, "events").select("event_id", F.get(pick, (F.col("event_id") % len(COMMANDS)).cast("int")).alias("argv"))


#: A vault and texts that hold its values raw, in base64, and escaped for queries, paths and JSON; SQL that Spark and DuckDB share.
SECRETS = "select 'main' as repo, concat('key_', cast(s_suppkey as {s})) as ref, concat(substr(md5(concat('s', cast(s_suppkey as {s}))), 1, 10), '+/ \"', substr(md5(concat('s', cast(s_suppkey as {s}))), 11, 6)) as value from supplier"
FORMS = "case c_custkey % 5 when 0 then value when 1 then {b64} when 2 then replace(replace(replace(replace(value, '+', '%2B'), '/', '%2F'), '\"', '%22'), ' ', '+') when 3 then replace(replace(replace(value, '/', '%2F'), '\"', '%22'), ' ', '%20') else replace(value, '\"', '{q}') end"
LOGS = "select 'main' as repo, cast(c_custkey as {s}) as id, concat('café ', {forms}, '; twice ', value, ' end') as text, ref, value, c_custkey % 5 as form from customer join ({secrets}) s on s.ref = concat('key_', cast(c_custkey % 10 + 1 as {s}))"


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, ref, value) from supplier."""
    return spark.sql(SECRETS.format(s="string").replace("from supplier", "from {supplier}"), supplier=read(spark, sf_dir, "supplier"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, id, text) from customer: each text holds a secret in one form and once more as it is."""
    query = LOGS.format(s="string", forms=FORMS.format(b64="base64(cast(value as binary))", q="\\\\\""), secrets="select * from {secrets}".replace("{", "{{").replace("}", "}}"))
    query = query.replace("{{", "{").replace("}}", "}").replace("from customer", "from {customer}")
    return spark.sql(query, customer=read(spark, sf_dir, "customer"), secrets=secrets(spark, sf_dir)).select("repo", "id", "text")


#: Credential files by part: path, and whether its second line holds a value in the clear.
TREES = [(".netrc", True), ("a/.npmrc", True), ("app/.docker/config.json", False), ("deploy/credentials", True), ("node_modules/x/.netrc", False), (".envrc", True), (".env", False), (".env.local", False), (".env.example", False), ("web/.env.test", False)]
LINES = "machine x login y password {v}|//r/:_authToken={v}|\"auth\": \"<token>\"|aws_session_token = {v}|machine x password {v}|export MY_TOKEN={v}|A={v}|A={v}|A={v}|A={v}".split("|")
PATHS_SQL = "case id % 10 " + " ".join(f"when {i} then '{p}'" for i, (p, _) in enumerate(TREES)) + " end"
CONTENT_SQL = "concat('# password of {nl}', case id % 10 ".replace("{nl}", "") + " ".join("when %d then %s" % (i, "concat('\n%s')" % x.replace("{v}", "', h, '")) for i, x in enumerate(LINES)) + " end)"


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content) from part."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey as id", "md5(cast(p_partkey as string)) as h")
    return rows.selectExpr("cast(id as string) as repo", f"{PATHS_SQL} as path", f"{CONTENT_SQL} as content")


def env_files(spark: SparkSession, sf_dir: str, without: tuple[int, ...] = (20, 21)) -> DataFrame:
    """(repo, path, content): the entries of each file in order, a comment before each, quoted in three ways; all branches but `without`."""
    line = F.expr("concat('# no ', id, '\n', case id % 3 when 0 then concat(key, '=', value) when 1 then concat('export ', key, ' = \"', value, '\" # note') else concat(key, \"='\", value, \"'\r\") end, '\n')")
    lines = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    # two branches hold white space at their ends, which an unquoted line can't
    return env_entries(spark, sf_dir).where(f"id % {N_BRANCHES} not in {without}").groupBy("repo", "path").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("content"))


#: Labelled rows by branch: key, value, want, sensitive part ('' for none), note; SQL that Spark and DuckDB share.
LABELS = [
    ("'API_TOKEN'", "{h}", "secret", "{h}", "named"),
    ("'OTHER'", "concat('a1', substr({h}, 1, 6), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ghijklmnop')", "secret", "'ABCDEFGHIJ'", "bland random"),
    ("'DATABASE_URL'", "concat('postgres://app:', substr({h}, 1, 16), '@db.internal:5432/app')", "secret", "substr({h}, 1, 16)", "composite"),
    ("'LOG_LEVEL'", "'debug'", "open", "''", "word"),
    ("'GIT_SHA'", "{h}", "open", "''", "hash"),
    ("'MEMO'", "concat('Xy7', substr({h}, 1, 11))", "open", "''", "mixed"),
    ("'MEMO'", "substr({h}, 1, 8)", "secret", "substr({h}, 1, 8)", "short"),
    ("'TOKEN_NOTE'", "'weekly'", "open", "''", "secret word"),
]
LABEL_COLUMNS = ["case id % 8 " + " ".join(f"when {i} then {x[c] if c in (0, 1, 3) else repr(x[c])}" for i, x in enumerate(LABELS)) + " end" for c in range(5)]


def label_sql(c: int, s: str) -> str:
    return LABEL_COLUMNS[c].format(h=f"md5(concat('l', cast(id as {s})))")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, value, want, sensitive, note) from orders."""
    k, v, want, part, note = (label_sql(c, "string") for c in range(5))
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as id").selectExpr("id", f"{k} as key", f"{v} as value", f"{want} as want", f"filter(array({part}), x -> x != '') as sensitive", f"{note} as note")


def short_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, alphabet, n, key, value) from orders: hex tokens and tokens of letters and digits, of 16, 18 and 19 characters."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case o_orderkey % 3 when 0 then 16 when 1 then 18 else 19 end as n", "floor(o_orderkey / 3) % 2 as a")
    return rows.selectExpr("id", "case a when 0 then 'hex' else 'mixed' end as alphabet", "n", "'SETTING' as key", "substr(case a when 0 then md5(cast(id as string)) else concat('aZ', upper(md5(cast(id as string)))) end, 1, n) as value")


#: Projects of ten kinds of files from part: i counts the parts, r is the project, k the kind, j how often the kind came before.
PARTS_SQL = "select i, i % 20 as r, floor(i / 20) % 10 as k, floor(i / 200) as j, md5(concat('p', cast(i as {s}))) as h, substr(md5(concat('db', cast(i % 20 as {s}))), 1, 20) as db from (select p_partkey as i from {part})"
PROJECT_PATHS = ["'.env'", "'.env.local'", "'.env.staging'", "'.npmrc'", "'.netrc'", "'README.md'", "'.gitignore'", "case when r % 7 = 0 then '.vault/backup/copy' else 'docs/copy' end", "'.env.shared'", "case when r % 3 = 2 then 'docs/policy.toml' else '.vault/policy.toml' end"]
PROJECT_TEXTS = [
    "concat('API_KEY=sv://api_key', chr(10), case when r % 3 = 0 then concat('LEFT_TOKEN=', db, chr(10)) else '' end, case when r % 4 = 0 then concat('MEMO=Xy7', substr(h, 1, 11), chr(10)) else '' end)",
    "concat('DB_PASSWORD=sv://db_password', chr(10), 'API_KEY=', 'open', chr(10))",
    "case when r % 2 = 0 then 'API_KEY=sv://api_key' else 'A=1' end",
    "case when r % 5 = 0 then concat('//r/:_authToken=$', '{{SV_NPMRC_R_AUTHTOKEN}}') else 'registry=https://r' end",
    "case when r % 3 = 1 then concat('machine x', chr(10), 'password ', h) else '# password none' end",
    "case when r % 6 = 1 then concat('see ', chr(10), db) else 'see' end",
    "case when r % 2 = 0 then concat('node_modules', chr(10), '.vault/') else 'node_modules' end",
    "'copy'",
    "'API_KEY=1'",
    "case when r % 3 = 1 then concat('[agent]', chr(10), 'enforce = false') when r % 9 = 0 then '[agent' else '[agent]' end",
]


def _by_kind(values: list[str]) -> str:
    return "case k " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


PROJECTS_SQL = f"select cast(r as {{s}}) as repo, r, k, j, concat(case when j > 0 then concat('m', cast(cast(j as int) as {{s}}), '/') else '' end, {_by_kind(PROJECT_PATHS)}) as path, {_by_kind(PROJECT_TEXTS)} as content, k = 8 and r % 8 = 1 as is_link, h, db from ({{parts}})"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content, is_link) from part."""
    query = PROJECTS_SQL.format(s="string", parts=PARTS_SQL.format(s="string", part="part_rows"))
    spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").createOrReplaceTempView("part_rows")
    return spark.sql(query).select("repo", "path", "content", "is_link")


PROJECT_VAULT = """select cast(r as {s}) as repo, 'api_key' as ref, 'unused' as value, r from {repos} where r % 10 <> 9
union all select cast(r as {s}), 'db_password', substr(md5(concat('db', cast(r as {s}))), 1, 20), r from {repos}
union all select cast(r as {s}), 'npmrc_r_authtoken', 'tokenvalue', r from {repos} where r % 10 = 0
union all select cast(r as {s}), 'spare', 'nobody uses it', r from {repos} where r % 4 = 2"""


def project_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, ref, value) of the projects."""
    repos = read(spark, sf_dir, "part").selectExpr("p_partkey % 20 as r").distinct()
    repos.createOrReplaceTempView("repo_rows")
    return spark.sql(PROJECT_VAULT.format(s="string", repos="repo_rows")).select("repo", "ref", "value")


#: npmrc files from supplier: a registry, a credential, a quoted one, a variable and a key that comes twice; SQL that both share.
NPMRC_SQL = "select cast(s_suppkey as {s}) as repo, concat('apps/a', cast(s_suppkey % 3 as {s}), '/.npmrc') as path, concat('registry=https://r.io/', chr(10), '//r.io/:_authToken=', md5(cast(s_suppkey as {s})), chr(10), '//q.io/:_auth=\"quoted\"', chr(10), '; _password=none', chr(10), '_password=$', '{{X}}', chr(10), '//b.io/:_password=', substr(md5(cast(s_suppkey as {s})), 1, 9), ' # note', chr(10)) as content from {supplier}"


def npmrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, content) from supplier."""
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier_rows")
    return spark.sql(NPMRC_SQL.format(s="string", supplier="supplier_rows"))
