import hashlib
import math

from pyspark.sql import functions as F

from cloakwork.functions import kernels, names, shape
from cloakwork.functions.suspect import suspect_reason
from cloakwork.operators import classify as C
from cloakwork.operators import vault as V


def test_entropy_and_alphabet(spark):
    h = hashlib.sha256(b"x").hexdigest()
    values = ["", "aaaa", "abcd", h[:20], "12345678901234567890", "Zz9+", "é"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", shape.entropy(F.col("v")), shape.alphabet(F.col("v")), shape.charset(F.col("v"))).collect()
    for v, e, k, c in got:
        b = v.encode()
        assert math.isclose(e, -sum(b.count(x) / len(b) * math.log2(b.count(x) / len(b)) for x in set(b)) if b else 0.0, abs_tol=1e-9)
    assert [r[2] for r in got] == [None, 16, 16, 16, None, 67, None]
    assert [r[3] for r in got] == ["empty", "hex", "hex", "hex", "hex", "base64", "mixed"]


def test_random_tokens_and_words(spark):
    tokens = [hashlib.sha256(str(i).encode()).hexdigest()[:40] for i in range(200)]
    words = ["production-read-replica-endpoint", "com/example/service/handler", "MAX_CONNECTIONS_PER_HOST", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "hello world hello world"]
    look = lambda vs: [r[0] for r in spark.createDataFrame([(v,) for v in vs], "v string").select(shape.looks_random(F.col("v"), kernels.evenness(F.col("v")))).collect()]
    assert sum(look(tokens)) >= 194
    assert not any(look(words))
    slashed = ["uQOIbEXI0b/TI8e3Nniyza1khiHfXPdG5/bw2t/6qqk", "agD2PR0naIzEXk2Vc6Ull81Ieim8MclQD/fj3i/ehyc", "8oKvSJU8SRp4X914oT8OJvOKe3NnCn/sno1/ncg678g"]
    assert all(look(slashed))  # short parts without a capital, by chance
    assert {r[0] for r in spark.createDataFrame([(v,) for v in slashed], "v string").select(suspect_reason(F.col("v"))).collect()} == {"long"}
    # short parts with digits but no capital, and letters that change case like words, by chance
    rare = ["dun/MqHe/y47kz2b07v0t26aiocdl/gOSBn67sXTw/g", "xy4xqxg1/4zsun6k38ch82k/3icpI3i/cAlH70y9lm8", "ZHHMtKF64fceWkN7aj/i2abt10lc/oC/3jtb1es8dzs"]
    rare += ["kzdTVSMHSbeohgvhVYAIEsiWVCk+hzKHRQmeAbjKYZY", "hkzExh+pyetDStfgWDWHUzCppxuvgzZHMRMZmbUmeQU", "NDrFJRQIQFZMfllXtzmsXOPizoBDDLznf+jtbXCJHqw"]
    assert all(look(rare))
    assert {r[0] for r in spark.createDataFrame([(v,) for v in rare], "v string").select(suspect_reason(F.col("v"))).collect()} == {"long"}
    assert not any(look(["America/Argentina/ComodRivadavia", "getHTTPResponseCodeFromURL", "XMLHttpRequestFactoryBean", "ThisIsAVeryLongCompanyNameHereIndeed", "MyCompanyProductionKubernetesCluster", "/usr/lib/x86_64-linux-gnu/python3.11/libstdc"]))
    assert not any(look(["/usr/local/share/ca-certificates/extra/company", "src/components/dashboard/SettingsPanel", "/home/deploy/Release2024Candidate7/current/public/assets/images/logo"]))


def test_segments(spark):
    got = spark.createDataFrame([("serviceToken",), ("HTTPServerName",), ("db2.password",), ("A_b-c",)], "k string").select(names.segments(F.col("k"))).collect()
    assert [r[0] for r in got] == [["SERVICE", "TOKEN"], ["HTTP", "SERVER", "NAME"], ["DB2", "PASSWORD"], ["A", "B", "C"]]


def test_kernels_by_expressions(spark):
    """The batch kernels and the expressions on single rows are two ways to the same terms and histograms."""
    keys = ["serviceToken", "HTTPServerKEYS", "db2.password", "A_b-c", "", "API_KEYS", "jwt_access_keys", "PASS", "xTokens S", "ÉcoleToken", "REFRESH_TOKEN_TTL_DAYS", "a:b/c d"]
    values = ["", "aaaa", "a\u00e9\u65e5", hashlib.sha256(b"q").hexdigest(), "Zz9+" * 700]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", names.terms(F.col("k")).alias("t")).collect()
    assert {r.k: kernels.terms_of(r.k) for r in got} == {r.k: r.t for r in got}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(shape.entropy(F.col("v")).alias("e"), F.size(F.array_distinct(shape.octets(F.col("v")))).alias("n"), kernels.evenness(F.col("v")).alias("k")).collect()
    assert all(r.k.distinct == r.n and math.isclose(r.k.entropy, r.e, abs_tol=1e-9) for r in rows)


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, 1), ("PASSWORD", None, 2), (None, "x", 3)], "key string, value string, other int")
    assert [(r["class"], r["rule"]) for r in C.classify(df).orderBy("other").collect()] == [("open", "empty"), ("open", "empty"), ("open", "default-open")]


def test_vault(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo string, ref string, value string")
    new = spark.createDataFrame([("r", "b", "3"), ("r", "c", "4")], "repo string, ref string, value string")
    assert sorted(r[1:] for r in map(tuple, V.upsert(old, new).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    texts = spark.createDataFrame([("r", ".env", 1, "x=sv://a y=sv://zz."), ("r", ".env", 2, "plain")], "repo string, path string, record_no int, text string")
    assert [r.text for r in V.resolve(texts, old).orderBy("record_no").collect()] == ["x=1 y=sv://zz.", "plain"]


HEX = hashlib.sha256(b"y").hexdigest()
MIXED = "Zq7" + "kP2vR9" + "xW4mB"  # 14 characters
CASES = [
    # key, value, class, rule, review
    ("API_KEY", " \t\n\u00a0", "open", "empty", False),
    ("API_KEY", "\t${OTHER}\n", "open", "variable-reference", False),
    ("API_KEY", "sv://api_key", "open", "already-veiled", False),
    ("DATABASE_URL", "postgres://u:${PW}@h/d", "open", "variable-reference", False),
    ("HOOK", "Bearer sv://hook_token", "open", "already-veiled", False),
    ("CONN", f"Password=https://x.io/?token={HEX[:12]}", "partial", "connection-string-password", False),
    ("CONN", f"Server=d; pwd ={HEX[:9]};Port=1", "partial", "connection-string-password", False),
    ("GATE", f"https://u:{HEX[:9]}@h/x?token={HEX[:6]}&key={HEX[6:12]}", "partial", "url-password+url-query-credential", False),
    ("GATE", f"https://h/x?q=1&sig={HEX[:6]}", "partial", "url-query-credential", False),
    ("DB_PASSWORD", "x", "veiled", "name-secret", False),
    ("DB_PASSWORD_FILE", "/run/secrets/db", "open", "name-not-secret", False),
    ("DB_PASSWORD_FILE", "hunter2", "veiled", "name-secret", False),
    ("TOKEN_TTL", "3600", "open", "name-not-secret", False),
    ("TOKEN_TTL", HEX, "veiled", "name-secret", False),
    ("GIT_COMMIT_SHA", HEX[:40], "open", "name-not-secret", False),
    ("VITE_APP_LABEL", HEX, "open", "public-prefix", True),
    ("VITE_CLIENT_SECRET", HEX, "veiled", "name-secret", False),
    ("BOT", "main:" + HEX, "partial", "labelled-token", False),
    ("OTHER", HEX, "veiled", "entropy", False),
    ("MEMO", MIXED, "open", "unrecognised", True),
    ("USER_ID", MIXED, "open", "name-not-secret", True),
    ("MEMO", "one-two-three", "open", "default-open", False),
    ("MEMO", "hello big world", "open", "default-open", False),
]


def test_ladder(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, *_) in enumerate(CASES)], "i int, key string, value string")
    got = {r.i: (r["class"], r.rule, r.review) for r in C.classify(rows).collect()}
    assert {i: got[i] for i in got} == {i: tuple(c[2:]) for i, c in enumerate(CASES)}


def test_spans(spark):
    value = f"https://u:sv://x@h?token={HEX[:6]}&key=$OTHER&sig={HEX[6:12]}"
    row = C.decide(spark.createDataFrame([("K", value)], "key string, value string")).first()
    assert [(value[s.start : s.stop], s.suffix) for s in row.spans] == [(HEX[:6], "_param"), (HEX[6:12], "_param3")]
