"""Settings files: what is read, and that unchanged files come back byte for byte."""

from pyspark.sql import functions as F

from cloakwork.functions.suspect import suspect_reason
from cloakwork.operators import veil as W
from cloakwork.operators.audit import redact_command
from cloakwork.sources import settings as S

DOTENV = "\ufeff# top\r\n\nA=plain # note\nexport B = \"two\\nlines\nmore \\\"x\\\"\" # end\n  C='it #1'\nD=\"open\nexport =x\nE=a#b\nnot a line\n1X=2\nF=\nexport=5"
NPMRC = "; top\n//r/:_authToken=abc ; note\r\nregistry = https://r#x\n=none\nplain\n\nlast=${SV_NPMRC_R_AUTHTOKEN}"


def files(spark, text):
    return spark.createDataFrame([("r", "p", text), ("r", "null", None), ("r", "empty", "")], "repo string, path string, content string")


def test_dotenv(spark):
    rows = S.parse_dotenv(files(spark, DOTENV)).orderBy("record_no").collect()
    got = [(r.line_no, r.kind, r.key, r.value, r.quote, r.export) for r in rows if r.kind not in ("blank", "comment")]
    assert got == [
        (3, "assignment", "A", "plain", "", False),
        (4, "assignment", "B", 'two\nlines\nmore "x"', '"', True),
        (6, "assignment", "C", "it #1", "'", False),
        (7, "assignment", "D", '"open', "", False),
        (8, "other", None, None, None, None),
        (9, "assignment", "E", "a#b", "", False),
        (10, "other", None, None, None, None),
        (11, "other", None, None, None, None),
        (12, "assignment", "F", "", "", False),
        (13, "assignment", "export", "5", "", False),
    ]
    assert [r.kind for r in rows[:2]] == ["comment", "blank"]


def test_round_trip(spark):
    for parse, text in ((S.parse_dotenv, DOTENV), (S.parse_npmrc, NPMRC)):
        records = parse(files(spark, text)).withColumn("new_value", F.lit(None).cast("string"))
        assert S.render(records).first().content == text
    veiled = S.parse_dotenv(files(spark, DOTENV)).withColumn("new_value", F.when(F.col("key").isin("A", "B", "C"), F.concat(F.lit("sv://"), F.lower("key"))))
    out = S.render(veiled).first().content
    assert "A=sv://a # note\n" in out and 'export B = "sv://b" # end\n' in out and "  C='sv://c'\n" in out


def test_npmrc(spark):
    rows = S.parse_npmrc(files(spark, NPMRC)).orderBy("record_no").collect()
    assert [(r.line_no, r.key, r.value) for r in rows if r.kind == "assignment"] == [(2, "//r/:_authToken", "abc"), (3, "registry", "https://r#x"), (7, "last", "${SV_NPMRC_R_AUTHTOKEN}")]
    one = spark.createDataFrame([("//r.io/:_authToken", NPMRC)], "k string, t string").select(S.npmrc_ref(F.col("k")).alias("ref"), S.marker(S.npmrc_ref(F.col("k"))).alias("mark"), S.marked_refs(F.col("t")).alias("refs")).first()
    assert (one.ref, one.mark, one.refs) == ("npmrc_r_io_authtoken", "${SV_NPMRC_R_IO_AUTHTOKEN}", ["npmrc_r_authtoken"])


def test_commands(spark):
    cases = [
        (["curl", "-H", "Authorization: Bearer abc"], ["curl", "-H", "Authorization: Bearer [hidden]"]),
        (["x", "--password", "--token", "y"], ["x", "--password", "[hidden]", "y"]),
        (["x", "--api-key=abc", "keyboard layout"], ["x", "--api-key=[hidden]", "keyboard layout"]),
        (["x", "a" * 41 + " b"], ["x", "[hidden] b"]),
        ([], []),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<string>").select("i", redact_command(F.col("c")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [want for _, want in cases]


def test_veil(spark):
    h = "0123456789abcdef"
    rows = [("DB_PASSWORD", "p w", "sv://db_password"), ("URL", f"https://u:{h[:9]}@h/x?token={h[:6]}&key={h[6:12]}", "https://u:sv://url_password@h/x?token=sv://url_param&key=sv://url_param2"), ("OLD_TOKEN", "sv://old_token", "sv://old_token"), ("API_TOKEN", "$OTHER", "$OTHER"), ("X", None, "")]
    got = W.veil(spark.createDataFrame(rows, "key string, value string, want string")).collect()
    assert [r.projected for r in got] == [r.want for r in got] and [len(r.secrets) for r in got] == [1, 3, 0, 0, 0]


def test_restore(spark):
    records = S.parse_dotenv(files(spark, "\ufeffA='sv://a' # x\nB=sv://b"))
    vault = spark.createDataFrame([("r", "a", "p w"), ("r", "b", "q")], "repo string, ref string, value string")
    assert W.restore_files(records, vault).first().content == "\ufeffA='p w' # x\nB=q"
    assert W.restore_files(records, vault.where("ref = 'a'")).count() == 0


def test_suspect(spark):
    cases = {"sk-x": "vendor-start", "a1b2c3d4e5f6g7h8": "long", "aB3dE6gH9jK2": "mixed-case-digits", "short": None, "one-two-three": None, "hello big world": None, "https://a.b/cdefghijk": None, None: None}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", suspect_reason(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in got} == cases


def test_npmrc_credentials(spark):
    rows = [("//r/:_authToken", "abc", True), ("_auth", "${X}", False), ("registry", "abc", False), ("_password", "a b", False)]
    got = spark.createDataFrame(rows, "k string, v string, want boolean").select("want", S.is_npmrc_credential(F.col("k"), F.col("v")).alias("is")).collect()
    assert all(r["is"] == r.want for r in got)
