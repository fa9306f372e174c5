"""Secrets longer than usual are found whole."""

from cloakwork.llm import secrets


def test_long_secrets(spark):
    long = "aB3" * 3000
    texts = {"forge": f"gh{'p_'}{long}", "chat": f"xox{'b-'}{long}", "payment": f"sk_{'live_'}{long}", "webtoken": f"ey{'J'}{long}.{long}.{long}", "login": f"https://{long}:{long}@"}
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in secrets.scan_secrets(docs).collect()}
    for i, (kind, t) in enumerate(texts.items()):
        assert (2, kind, 2 + len(t)) in got[i]
