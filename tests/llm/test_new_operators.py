"""Toxicity, source divergence and importance resampling against loops, planted texts and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import divergence, importance, toxicity

SF = "/root/testdata/sf0.1"
ODD = [(None, "en", "s"), ("", "en", "s"), ("One two THREE é日 four", None, None), ("a " * 30_000, "en", "t"), ("a " * 30_000, "en", "t"), ("b c d", "fr", "s"), (" \n\t", "de", None)]


def wide(frame):
    """With columns whose names the operators might use themselves."""
    return frame.withColumns({c: F.lit("x") for c in ("term", "word", "of", "label", "fold", "place", "part", "start", "bucket", "n", "deal", "at", "score", "rank")})


def plain_draw(docs, target, percent=5):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    of, to = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    rows = []
    for i, text in docs:
        w, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of / ((s[b] + 1) * to))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in rows)


def test_draw_by_loops(spark):
    rng = random.Random(1)
    words = "alpha Beta gamma-delta é日 x9 the of and".split() + [chr(97 + i) * 3 for i in range(20)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "w " * 20_000)]
    target = [" ".join(rng.choice(words[:6]) for _ in range(30)) for _ in range(10)]
    frame = wide(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == plain_draw(docs, target)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_draw_of_odd_tables(spark):
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    text = "alpha beta " * 15
    rows = [(None, text), (1, text), (1, text), (2, "x"), (3, None)] + [(10 + i, text) for i in range(40)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == len(rows) and ranks == [1, 2] and all(r.n_words >= 20 for r in got if r["rank"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(spark.createDataFrame([(1, "a"), (2, "b b")], "doc_id long, text string"), empty.select("text")).where("rank is not null").count() == 0


def plain_divergence(docs, least=3, top=200):
    term_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, count, groups = {}, {}, set()
    for text, lang, source in docs:
        lang, source, words = lang or "", source or "", term_of(text)
        groups.add((lang, source))
        df.setdefault(lang, Counter()).update(set(words))
        count.setdefault((lang, source), Counter()).update(words)
    out = []
    for lang in df:
        kept, own = [w for w, n in df[lang].items() if n >= least], sorted(s for k, s in groups if k == lang)
        n = {s: sum(count[lang, s][w] for w in kept) for s in own}
        p = {s: {w: 1 + 10**9 * (count[lang, s][w] + 1) // (n[s] + len(kept)) for w in kept} for s in own}
        q = {w: 1 + 10**9 * (sum(count[lang, s][w] for s in own) + 1) // (sum(n.values()) + len(kept)) for w in kept}
        for s in own:
            pair = [("pair", o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in own if o != s]
            term = [("term", w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for rows, most in ((pair, None), (term, top)):
                rows.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k + 1) for k, r in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_divergence_by_loops(spark, held):
    rng = random.Random(2)
    words = ["the", "Of", "é日", "ñ"] + [chr(97 + i) * (1 + i % 3) for i in range(26)]
    docs = ODD + [(" ".join(rng.choice(words[: 6 + 8 * (k % 3)]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None]), f"s{k}") for k in (rng.randrange(4) for _ in range(200))]
    frame = wide(spark.createDataFrame(docs, "text string, lang string, source string").repartition(6))
    got = divergence.source_divergence(frame, top=7, held_bytes=held)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(docs, top=7)
    assert divergence.source_divergence(frame.where("false")).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 1 << 52, 2000)
    count = (total * rng.random(2000)).astype(np.int64) - 1
    count = np.maximum(count, 0)
    assert all(int(s) == 1 + 10**9 * (int(c) + 1) // int(t) for s, c, t in zip(divergence.shares(count, total), count, total, strict=True))


def test_planted_insults(spark):
    """Words of an invented lexicon mark toxic texts; held-out texts, short and long ones, are told apart."""
    rng = random.Random(5)
    plain, bad = ["".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(400)], ["blargh", "snorf", "grumk"]

    def text(toxic, n):
        w = [rng.choice(plain) for _ in range(n)]
        for _ in range(1 + n // 60 if toxic else 0):
            w[rng.randrange(n)] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 5 == 0, rng.choice([8, 40, 300, 2000])), int(i % 5 == 0)) for i in range(1000)]
    frame = wide(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    labels = wide(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    scorer = toxicity.train(frame, labels.where("doc_id < 700"))
    got = {r.doc_id: r.score for r in toxicity.score(frame, scorer).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    wrong = sum((got[i] >= 0.5) != bool(y) for i, _, y in rows if i >= 700)
    assert wrong <= 6
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "12 3 !"), (None, "blargh"), (4, "blargh snorf " * 50_000)], "doc_id long, text string"), scorer).collect()
    low = {r.score for r in odd if r.doc_id in (1, 2, 3)}
    assert len(odd) == 6 and len(low) == 1 and low.pop() < 0.5 and all(r.score > 0.5 for r in odd if r.doc_id in (None, 4))


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    score = lambda rows: [r.score for r in toxicity.score(docs, toxicity.train(docs, labels(rows))).collect()]
    assert score([]) == [0, 0] and score([(1, 0), (2, None)]) == [0, 0] and score([(1, 1)]) == [1, 1]
    assert all(0 <= s <= 1 for s in score([(1, 1), (2, 0)]))
    assert toxicity.score(docs.where("false"), toxicity.train(docs, labels([(1, 1), (2, 0)]))).count() == 0


def test_model_by_dictionaries():
    """Words and pairs of a tiny table by the textbook formulas."""
    hashes = np.array([10, 20, 30])
    n, m = np.array([[8.0, 2], [3, 9], [1, 0]]), np.array([[4.0, 1], [0, 5]])
    model = toxicity.Model(hashes, np.array([5, 3, 1]), n, np.array([[0, 1], [1, 1]]), m)
    d, shared = toxicity.DISCOUNT, np.array([6, 4, 2]) / 12
    p = lambda w, c: (max(n[w, c] - d, 0) + sum(min(d, x) for x in n[:, c]) * shared[w]) / n[:, c].sum()
    assert np.allclose(model.word, [math.log(p(w, 1) / p(w, 0)) for w in range(3)])
    rest = lambda v, c: 1 - max(m[v, c] - d, 0) / n[v, c]
    pair = lambda v, w, c: max(m[v, c] - d, 0) / n[v, c] + rest(v, c) * (0.5 * p(w, c) + 0.5 * m[v].sum() / n[v].sum())
    assert np.allclose(model.pair, [math.log(pair(v, 1, 1) / pair(v, 1, 0)) for v in (0, 1)])


def test_held_out_toxicity(spark):
    rows = {r.doc_id: r for r in toxicity.op11_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    right, found = sum(a and b for a, b in own), sum(a for a, _ in own)
    assert len(rows) == 10_000 and right >= 0.8 * sum(y for _, y in own) and right >= 0.9 * found
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
