"""Redaction of whole texts against a plain search, and of streams against whole texts."""

import hashlib
import json
import random
import tempfile
import time
import tracemalloc

import pyarrow as pa
import pytest

from cloakwork.operators import redact as R
from cloakwork.operators.needles import Matcher
from cloakwork.streaming.redact import Needles, hits_stream, redact_stream
from cloakwork.streaming.run import as_stream, latest, state_store

VAULT = [("m", "a", "abcabcabc"), ("m", "b", "bcabca"), ("m", "c", "cabcabcab\\E."), ("m", "d", "naïve é"), ("m", "e", "tiny"), ("m", "f", "abcabcabc")]
TEXTS = ["", "abcabcabcabc", "xx abcabcabc, bcabca", "cabcabcab\\E. end", "é naïve éé", "abcab", "tiny", "bcabcabcabcabcax"]


def plain(text, needles):
    """Each occurrence, longest at each end, cut where a later one starts."""
    data, best = text.encode(), {}
    for pattern, ref in needles.items():
        p = pattern.encode()
        for i in range(len(data) - len(p) + 1):
            if data[i : i + len(p)] == p and (i + len(p) not in best or i < best[i + len(p)][0]):
                best[i + len(p)] = (i, ref)
    out, later, end, n = [], len(data), len(data), 0
    for stop in sorted(best, reverse=True):
        start, ref = best[stop]
        cut = min(stop, later)
        if start < cut:
            out += [data[cut:end], f"sv://{ref}".encode()]
            end, n = start, n + 1
        later = min(later, start)
    return b"".join(reversed([*out, data[:end]])).decode(), n


@pytest.fixture(scope="module")
def needles(spark):
    return R.build_needles(spark.createDataFrame(VAULT, "repo string, ref string, value string"), encodings=False)


WAYS = pytest.mark.parametrize("most_bytes", [R.PACKED_BYTES, 0])  # in one pass, by joins


@WAYS
def test_whole_texts(spark, needles, most_bytes):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abc") for _ in range(40)) for _ in range(20)]
    known = {r.pattern: r.ref for r in needles.collect()}
    assert known["abcabcabc"] == "a" and "tiny" not in known
    docs = spark.createDataFrame([("m", str(i), t) for i, t in enumerate(texts)] + [("m", "null", None), ("other", "0", "abcabcabc")], "repo string, id string, text string")
    got = {(r.repo, r.id): (r.text, r.n_hits) for r in R.redact(docs, needles, most_bytes=most_bytes).collect()}
    assert got.pop(("m", "null")) == (None, 0) and got.pop(("other", "0")) == ("abcabcabc", 0)
    assert got == {("m", str(i)): plain(t, known) for i, t in enumerate(texts)}
    counts = {r.ref: r.n for r in R.hits(docs, needles, most_bytes=most_bytes).collect()}
    assert sum(counts.values()) == sum(plain(t, known)[1] for t in texts)


def test_forms(spark):
    row = spark.createDataFrame([('a+/ "b*~\n<',)], "value string").select(R.encoded_forms(R.F.col("value")).alias("f")).first()
    assert row.f[3:] == ["a%2B%2F+%22b%2A~%0A%3C", "a+%2F%20%22b%2A~%0A%3C", 'a+/ \\"b*~\\n\\u003c']
    assert R.skipped_short(spark.createDataFrame(VAULT, "repo string, ref string, value string")).first().ref == "e"


@WAYS
def test_leftovers(spark, most_bytes):
    files = spark.createDataFrame([("m", "x", "one\ntwo abcabcabc\nabcabcabc"), ("m", "y", "none")], "repo string, path string, content string")
    vault = spark.createDataFrame(VAULT, "repo string, ref string, value string")
    got = {(r.path, r.ref, r.line_no, r.level) for r in R.find_leftovers(files, vault, files.where("path = 'x'"), most_bytes=most_bytes).collect()}
    assert got == {("x", "a", 2, "bad"), ("x", "b", 2, "bad"), ("x", "f", 2, "bad")}


def test_texts_are_not_shuffled(spark, needles):
    docs = spark.createDataFrame([("m", "1", "abcabcabc")], "repo string, id string, text string")
    plan = R.redact(docs, needles)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Exchange" in R.redact(docs, needles, most_bytes=0)._jdf.queryExecution().executedPlan().toString()


def test_many_needles_of_different_heads():
    rng = random.Random(7)
    rows = [("m", "".join(rng.choice("abcd") for _ in range(rng.choice([6, 7, 9, 12]))).encode(), str(i)) for i in range(3000)]
    text = "".join(rng.choice("abcd") for _ in range(4000)).encode()
    want = sorted((i, i + len(p), ref) for _, p, ref in rows for i in range(len(text)) if text[i : i + len(p)] == p)
    assert want and sorted(Matcher(rows, 6).places(text, "m")) == want and Matcher(rows, 6).places(text, "n") == []
    assert Matcher([("m", b"x", "1")], 1).places(b"axxa", "m") == [(1, 2, "1"), (2, 3, "1")] and Matcher([], 8).places(text, "m") == []


def test_release_does_not_depend_on_cuts():
    known = {"abcabcabc": "a", "bcabca": "b", "naïve é": "d"}
    n, rng = Needles(known.items()), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c", "abcabc", "naïve é"]) for _ in range(12))
        latin, pending, out = text.encode().decode("latin-1"), "", ""
        while latin:
            k = rng.randint(1, 9)
            shown, _, pending = n.release(pending + latin[:k], False)
            latin, out = latin[k:], out + shown
        out += n.release(pending, True)[0]
        assert out.encode("latin-1").decode() == plain(text, known)[0]


def test_stream(spark, needles):
    folder, known = tempfile.mkdtemp(prefix="chunks-"), {r.pattern: r.ref for r in needles.collect()}
    texts = {f"s{i}": t for i, t in enumerate(TEXTS)}
    rows = []
    for name, text in texts.items():
        parts = [text[i : i + 3] for i in range(0, len(text), 3)] + [""]
        rows += [{"stream_id": name, "seq": i, "chunk": p, "done": i == len(parts) - 1} for i, p in enumerate(parts)]
    random.Random(3).shuffle(rows)
    for k in range(2):
        with open(f"{folder}/{k}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows[k::2])
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, done boolean").option("maxFilesPerTrigger", 1).json(folder)
    with state_store(spark):
        query = redact_stream(chunks, needles).writeStream.format("memory").queryName("released").option("checkpointLocation", tempfile.mkdtemp(prefix="state-")).trigger(availableNow=True).start()
    query.awaitTermination(100)
    got: dict = {}
    for r in sorted(spark.table("released").collect(), key=lambda r: r.from_seq):
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {name: plain(t, known)[0] for name, t in texts.items()}


def test_idle_streams_let_out_what_is_safe(spark, needles, tmp_path):
    """The timer: without a further chunk all but the beginning of a secret goes out; what waits is small and is in the state."""
    folder, known = tmp_path / "in", {r.pattern: r.ref for r in needles.collect()}
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps({"stream_id": i, "seq": k, "chunk": c, "done": False}) for i, k, c in (("a", 0, "see abcabcab"), ("b", 0, "x" * 500), ("c", 2, "later"))))
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, done boolean").json(str(folder))
    with state_store(spark):
        query = redact_stream(chunks, needles, idle_ms=500).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        text = lambda: {i: "".join(r.text for r in spark.table("idle").collect() if r.stream_id == i) for i in "abc"}
        until = time.time() + 60
        while text() != {"a": "see ", "b": "x" * 500, "c": ""} and time.time() < until:
            time.sleep(0.5)
        assert text() == {"a": "see ", "b": "x" * 500, "c": ""}
    finally:
        query.stop()
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state")).collect()
    held = {r.user_map_key.part: r.user_map_value.pending for r in state("heads")}
    assert held == {"a": "abcabcab", "b": "", "c": ""} and max(map(len, held.values())) <= 2 * max(len(p.encode()) for p in known)
    assert [(r.user_map_key.part, r.user_map_key.seq, r.user_map_value.chunk) for r in state("early")] == [("c", 2, "later")]


def test_hits_of_both_outputs(spark, needles, tmp_path):
    rows = [("s", 1, 0, "abcabc", False), ("s", 2, 0, "a bcabca", True), ("s", 1, 1, "abc end", True), ("t", 2, 0, "naïve é", True), ("u", 1, 0, "none", True), ("s", 1, 0, "abcabc", False)]
    stream = as_stream(spark.createDataFrame(rows, "session string, fd int, seq long, chunk string, done boolean").coalesce(1), str(tmp_path))
    got = {(r.stream_id, r.ref): r.n for r in latest(hits_stream(stream, needles), str(tmp_path), ["stream_id", "ref"]).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("t", "d"): 1}


def test_needles_take_no_object_each():
    """Each worker of an executor holds all needles: an object for each took a thousand bytes, of millions more than an executor has."""
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), f"key_{i}") for i in range(50_000)]
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    known = Needles(rows)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 300 * len(rows)
    assert known.release(f"x {rows[7][0]} y", True)[:2] == ("x sv://key_7 y", ["key_7"])


def test_needles_within_needles():
    rng = random.Random(11)
    for least in (1, 4, 8, 9):
        rows = [("".join(rng.choice("ab") for _ in range(rng.randint(least, least + 6))), rng.choice("rs") + str(i)) for i in range(60)]
        known, text = Needles(rows), "".join(rng.choice("ab") for _ in range(400))
        owner = {p: min(r for q, r in rows if q == p) for p, _ in rows}
        assert known.places(text) == sorted((i + len(p), i, r) for p, r in owner.items() for i in range(len(text)) if text.startswith(p, i))
        for k in range(1, 60):
            assert known.begun(text[:k]) == max((n for n in range(1, k + 1) if any(p != text[k - n : k] and p.startswith(text[k - n : k]) for p in owner)), default=0)


def test_state_stores_share_a_limit(spark):
    key = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
    before = spark.conf.get(key, None)
    with state_store(spark):
        assert spark.conf.get(key, None) == "true"
    assert spark.conf.get(key, None) == before
