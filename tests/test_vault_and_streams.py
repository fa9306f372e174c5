"""Vault versions, logs, policies, files of a folder, veiling and restoring whole files, and streams that pause or lose chunks."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import audit as A
from cloakwork.operators import classify as C
from cloakwork.operators import gate as G
from cloakwork.operators import report as P
from cloakwork.operators import vault as V
from cloakwork.operators import veil as W
from cloakwork.sources import settings as S
from cloakwork.sources.tree import Tree
from cloakwork.streaming import redact as X
from cloakwork.streaming import run as N

HEX = "0123456789abcdef"
VAULT = "repo string, ref string, value string"


def test_vault_versions(spark, tmp_path):
    root = str(tmp_path / "vault")
    assert V.current_version(spark, root) is None and V.read_vault(spark, root).count() == 0
    one = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], VAULT)
    assert V.write_version(one, root) == 1
    two = V.upsert(V.read_vault(spark, root), spark.createDataFrame([("r", "b", "3"), ("r", "c", "4")], VAULT))
    assert V.write_version(two, root) == 2
    assert {(x.ref, x.value) for x in V.read_vault(spark, root).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert V.differences(two, V.read_vault(spark, root)).count() == 0
    V.rollback(spark, root, 1)
    assert V.current_version(spark, root) == 1 and V.read_vault(spark, root).count() == 2
    assert V.write_version(V.delete(V.read_vault(spark, root), spark.createDataFrame([("r", "a"), ("r", "zz")], "repo string, ref string")), root) == 3
    assert [x.ref for x in V.read_vault(spark, root).collect()] == ["b"]
    with pytest.raises(ValueError):
        V.upsert(one, spark.createDataFrame([("r", "A B", "1")], VAULT))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "vault")
    row = lambda k: spark.createDataFrame([("r", f"k{k}", str(k))], VAULT)
    V.write_version(row(0), root)
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda k: V.update_vault(spark, root, lambda old: V.upsert(old, row(k))), (1, 2, 3)))
    assert sorted(versions) == [2, 3, 4] and {r.ref for r in V.read_vault(spark, root).collect()} == {"k0", "k1", "k2", "k3"}
    with pytest.raises(V.Conflict):
        V.write_version(row(9), root, 1, True)
    with pytest.raises(ValueError):
        V.rollback(spark, root, 99)
    (tmp_path / "vault" / "pointers" / f"{5:012d}.json").touch()  # a writer died between creating and writing
    assert V.write_version(row(7), root) == 6 and [r.ref for r in V.read_vault(spark, root).collect()] == ["k7"]


def test_replayed_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("run", ["x", "--token", "abc"], None)], "event string, command array<string>, time timestamp")
    A.append_log(rows, path)
    for stream, number in (("a", 0), ("a", 0), ("a", 1), ("b", 0)):
        A.write_batch(rows, path, stream, number)
    assert A.read_log(spark, path).count() == 4


def test_policies_of_projects(spark):
    texts = {"off": "[agent]\nenforce = false", "list": '[agent]\nallow = ["git"]', "own": '[agent]\ndeny = []\n[agent.inline_code]\nawk = ["-f"]\nsed = []', "broken": "[agent", "null": None}
    argvs = [["bash"], ["git"], ["awk", "-f=x"], ["sed"], ["awk", "--", "-f"], []]
    commands = spark.createDataFrame([(r, i, a) for r in [*texts, "none", None] for i, a in enumerate(argvs)], "repo string, i int, argv array<string>")
    rows = G.check_project_policies(commands, spark.createDataFrame(list(texts.items()), "repo string, text string")).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.i):
        got.setdefault(r.repo, []).append(r.refusal)
        assert (r.advice is None) == (r.refusal is None)
    default = ["deny-list", None, None, None, None, None]
    assert got == {"off": [None] * 6, "list": ["deny-list", None, "not-allowed", "not-allowed", "not-allowed", None], "own": [None, None, "inline-code", "no-use", None, None], "broken": ["invalid-policy"] * 5 + [None], "null": default, "none": default, None: default}


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("run", ["x", "--token", "abc"], None), ("run", ["ls"], "2026-01-01 00:00:00")], "event string, command array<string>, time string").withColumn("time", F.to_timestamp("time"))
    A.append_log(rows, path)
    with open(os.path.join(path, "part-damaged.json"), "w") as file:
        file.write("{broken\n\n")
    got = A.read_log(spark, path).collect()
    assert sorted(r.command for r in got) == [["ls"], ["x", "--token", "[hidden]"]] and all(r.time for r in got)


def test_log_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "run", ["x", "--token=a"]), (1, "run", ["x", "--token=a"]), (2, "run", ["ls"])], "event_id long, event string, command array<string>").withColumn("time", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    stream = N.as_stream(rows, str(tmp_path))
    A.log_stream(stream, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.command for r in A.read_log(spark, str(tmp_path / "log")).collect()) == [["ls"], ["x", "--token=[hidden]"]]


def test_policy(spark):
    own = G.load_policy('[agent]\nallow = ["git"]\ndeny = []\n[agent.inline_code]\nawk = ["-f"]')
    assert own.allow == ("git",) and own.deny == () and own.inline_code["python"] == ("-c",) and own.inline_code["awk"] == ("-f",)
    for bad in ("[agent]\nenforced = true", "[other]\na = 1", "[agent", '[agent]\nenforce = "yes"'):
        with pytest.raises(ValueError):
            G.load_policy(bad)
    commands = spark.createDataFrame([(["bash"],), (["git"],), (["awk", "-f=x"],), ([],)], "argv array<string>")
    assert [r.refusal for r in G.check_policy(commands, policy=own).collect()] == ["not-allowed", None, "inline-code", None]
    assert [r.refusal for r in G.check_policy(commands, policy=G.Policy(enforce=False)).collect()] == [None] * 4
    assert [bool(r.advice) for r in G.check_policy(commands).collect()] == [True, False, False, False]


def test_tree(spark, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "app" / ".npmrc").write_text("b=2")
    (tmp_path / "node_modules" / ".env").write_text("C=3")
    (tmp_path / "app" / ".env").symlink_to(tmp_path / ".env")
    spark.dataSource.register(Tree)
    got = {r.path: (r.is_link, r.content) for r in spark.read.format("settings_tree").load(str(tmp_path)).collect()}
    assert got == {".env": (False, "A=1"), "app/.npmrc": (False, "b=2"), "app/.env": (True, None)}


def test_veil_and_restore_files(spark):
    text = f"# top\nAPI_TOKEN={HEX}  \nexport DB_PASSWORD='p w' # mine\nURL=\"https://u:{HEX[:9]}@h/x\"\r\nLEVEL=debug"
    records = S.parse_dotenv(spark.createDataFrame([("r", ".env", text)], "repo string, path string, content string"))
    shown = W.veil_files(records).first().content
    assert HEX[:9] not in shown and "p w" not in shown and "LEVEL=debug" in shown and "# mine" in shown and "# sv: 16 chars, hex" in shown
    vault = W.vault_rows(W.veil_tree(records))
    again = S.parse_dotenv(spark.createDataFrame([("r", ".env", shown)], "repo string, path string, content string"))
    back = W.restored(again, vault)
    assert W.restore_files(again, vault).first().content == text.replace("  \n", "\n")
    assert P.restore_summary(back).first().n_handles == 3
    assert W.veil_files(again).first().content == shown


def test_collisions(spark):
    rows = [("r", ".env", "dotenv", 1, 0, "k", "1"), ("r", ".env.local", "dotenv", 1, 0, "k", "2"), ("r", ".env.local", "dotenv", 5, 0, "k", "3"), ("r", "a/.npmrc", "npmrc", 1, 0, "npmrc_x", "1"), ("r", "b/.npmrc", "npmrc", 1, 0, "npmrc_x", "2"),
            ("r", ".npmrc", "npmrc", 1, 0, "same", "9"), ("r", "x", "dotenv", 1, 0, "same", "9"), ("r", "y", "dotenv", 1, 0, "env_local_k", "7")]
    claims = spark.createDataFrame(rows, "repo string, path string, kind string, record_no int, span_no int, ref string, value string")
    got = {(r.path, r.record_no, r.ref): r.new_ref for r in W.rename_collisions(claims).collect()}
    assert got == {(".env", 1, "k"): "k", (".env.local", 1, "k"): "env_local_k_2", (".env.local", 5, "k"): "env_local_k_3", ("a/.npmrc", 1, "npmrc_x"): "npmrc_x", ("b/.npmrc", 1, "npmrc_x"): "npmrc_b_x",
                   (".npmrc", 1, "same"): "same", ("x", 1, "same"): "same", ("y", 1, "env_local_k"): "env_local_k"}
    assert [(r.ref, r.n_values) for r in W.collisions(claims).orderBy("ref").collect()] == [("k", 3), ("npmrc_x", 2)]


def test_key_blocks(spark):
    head = "-----BEGIN RSA " + "PRIVATE KEY-----"
    body = "".join(HEX[(7 * i * i + i) % 16] + "GHJKLMNPQRSTUVWXYZ"[i % 18] for i in range(24))
    texts = [("a", f"x {head}\n{body}\n"), ("b", f"{head} a plain sentence follows here"), ("c", f"{head}{' ' * 500}{body}"), ("d", None)]
    got = C.classify(C.scan_candidates(spark.createDataFrame(texts, "path string, text string"), "text", "path").withColumn("key", F.lit("X"))).collect()
    assert {r.path for r in got if r.rule == "value-private-key"} == {"a"}


def test_idle_and_gaps(spark):
    known = X.Needles([("secretvalue", "s"), ("abcabc", "t")])
    assert known.release("see secretva", False, True) == ("see ", [], "secretva")
    assert known.release("see secretvalue", False, True) == ("see sv://s", ["s"], "")
    assert known.release("abcab", False, True) == ("", [], "abcab") and known.release("xabd", False, True) == ("xabd", [], "")


def test_chunks_out_of_order(spark, tmp_path):
    needles = spark.createDataFrame([("secretvalue", "s")], "pattern string, ref string")
    rows = [("a", 2, "value end", True), ("a", 0, "one secret", False), ("a", 1, "", False), ("a", 0, "one secret", False), ("b", 3, "late secretvalue", False), ("b", 0, "x", False)]
    chunks = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, done boolean")
    out = N.run_available(X.redact_stream(N.as_stream(chunks, str(tmp_path)), needles, waiting_chars=4), str(tmp_path)).collect()
    got = {r.stream_id: r for r in out}
    assert got["a"].text == "one sv://s end" and got["a"].gap_to is None
    assert got["b"].gap_to == 3 and got["b"].text.startswith("xlate ")


def test_streams_with_many_needles(spark, tmp_path):
    """More needles than fit the code of a task, which is a broadcast above 1 MB."""
    needles = spark.range(120_000).selectExpr("concat(md5(cast(id as string)), md5(cast(-id as string))) as pattern", "concat('r', id) as ref")
    first, last = needles.where("ref in ('r0', 'r119999')").orderBy("ref").collect()
    rows = [("a", "1", 0, "x " + first.pattern[:20], False), ("a", "1", 1, first.pattern[20:] + " y", True), ("b", "1", 0, last.pattern, True)]
    chunks = spark.createDataFrame(rows, "session string, fd string, seq long, chunk string, done boolean")
    out = N.run_available(X.redact_stream(N.as_stream(chunks.withColumnRenamed("session", "stream_id"), str(tmp_path / "t")), needles), str(tmp_path / "t")).collect()
    assert {r.stream_id: r.text for r in out} == {"a": "x sv://r0 y", "b": "sv://r119999"}
    hits = N.latest(X.hits_stream(N.as_stream(chunks, str(tmp_path / "h")), needles), str(tmp_path / "h"), ["stream_id", "ref"]).collect()
    assert {(r.stream_id, r.ref, r.n) for r in hits} == {("a", "r0", 1), ("b", "r119999", 1)}
