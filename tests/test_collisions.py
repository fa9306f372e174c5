"""References that several files claim with different values: told apart in texts, markers and vault, and refused where they are not."""

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import vault as V
from cloakwork.operators import veil as W
from cloakwork.sources import settings as S

VAULT = "repo string, ref string, value string"


def parsed(files):
    npmrc = W.file_kind(F.col("path")) == "npmrc"
    return S.parse_dotenv(files.where(~npmrc)).unionByName(S.parse_npmrc(files.where(npmrc)))


def test_files_come_back(spark):
    files = {
        (".env"): "API_TOKEN=first-secret\nURL='https://u:pw1@h/x?token=tok1&key=tok2' # mine\n",
        (".env.local"): "# top\r\nAPI_TOKEN=second-secret\r\nURL=https://u:pw2@h/x?token=tok1&key=tok3\nSAME_SECRET=one",
        ("app/.env"): 'export API_TOKEN="second-secret"\nSAME_SECRET=one\nPLAIN=debug\n',
        (".npmrc"): "//r.io/:_authToken=abc123\nregistry=https://r.io\n",
        ("web/.npmrc"): "//r.io/:_authToken=def456\n",
    }
    rows = spark.createDataFrame([("r", p, c) for p, c in files.items()] + [("other", ".env", "API_TOKEN=third\n")], "repo string, path string, content string")
    veiled = W.veil_tree(parsed(rows))
    vault = {(r.repo, r.ref): r.value for r in W.vault_rows(veiled).collect()}
    assert vault["r", "api_token"] == "first-secret" and vault["other", "api_token"] == "third"
    assert vault["r", "env_local_api_token"] == vault["r", "app_env_api_token"] == "second-secret" and vault["r", "npmrc_web_r_io_authtoken"] == "def456"
    shown = {(r.repo, r.path): r.content for r in S.render(veiled).collect()}
    assert shown["r", "web/.npmrc"] == "//r.io/:_authToken=${SV_NPMRC_WEB_R_IO_AUTHTOKEN}\n" and "sv://env_local_api_token" in shown["r", ".env.local"]
    assert not any(v in c for c in shown.values() for v in vault.values() if len(v) > 4) and "SAME_SECRET=sv://same_secret" in shown["r", "app/.env"]
    back = {r.path: r.content for r in W.restore_files(parsed(S.render(veiled)), W.vault_rows(veiled)).collect() if r.repo == "r"}
    assert back == files


def test_two_values_are_refused(spark):
    two = spark.createDataFrame([("r", "a", "1"), ("r", "a", "2"), ("r", "b", "3")], VAULT)
    one = spark.createDataFrame([("r", "a", "1"), ("r", "a", "1"), ("s", "a", "2")], VAULT)
    texts = spark.createDataFrame([("r", ".env", 1, "x=sv://a")], "repo string, path string, record_no int, text string")
    records = S.parse_dotenv(spark.createDataFrame([("r", ".env", "A=sv://a")], "repo string, path string, content string"))
    assert V.resolve(texts, one).first().text == "x=1" and W.restore_files(records, one).first().content == "A=1"
    assert V.upsert(two.where("value = '1'"), one).count() == 2
    for job in (lambda: V.resolve(texts, two), lambda: W.restore_files(records, two), lambda: V.upsert(one, two), lambda: V.unique(two)):
        with pytest.raises(Exception, match="two values of the reference a"):
            job().collect()
