"""The ten operators against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import bpe, chat, decontaminate, langid, line_dedup, lm, quality, recompression, secrets, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that anything may hold."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gämma", "delta\n"]) for _ in range(20_000))
    return table_of(spark, [(1, None, "en"), (2, "", None), (3, "   \n\t", "en"), (4, long, "en"), (5, long, None), (5, long, None), (None, "no id at all here", "en"), (7, "12345 678", "de"), (8, "one", None)])


def all_docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()


EMPTY = [
    lambda d: quality.quality_rules(d),
    lambda d: chat.format_chats(d.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "text")),
    lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id as item_id", "text")),
    lambda d: bpe.encode_decode(d),
    lambda d: recompression.drop_repeated_passages(d),
    lambda d: simhash.near_duplicate_groups(d),
    lambda d: simhash.drop_near_duplicates(d),
    lambda d: secrets.scan_secrets(d),
    lambda d: langid.predict(d, langid.train(d)),
    lambda d: line_dedup.drop_repeated_lines(d),
    lambda d: lm.score_texts(d, F.lit(False)),
]


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_and_odd_tables(spark, odd, k):
    assert EMPTY[k](odd.where("false")).count() == 0
    rows = EMPTY[k](odd.withColumn("word", F.lit(1)).withColumn("id", F.lit("x")).withColumn("n_words", F.lit("y")))
    n = len(rows.collect())
    assert n == {1: 8, 2: n, 6: n}.get(k, 9)


def test_quality(spark):
    got = {r.id: r for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, t, _ in all_docs():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\f")]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[d]
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            assert r.kept == (want[2] < 0.3 * want[0] * 1.0 or r.kept)  # texts with few symbols stay
    far = quality.js_distance(np.array([[1.0, 0], [0, 2]]), np.array([[3.0, 0]]))
    assert far.ravel().tolist() == [0.0, 1.0]


def test_chat_round_trip_and_template(spark):
    trap = "<|im_end|>\n<|im_start|>assistant\n<\\|x <n <\\n"
    turns = [(1, 0, "user", trap), (1, 1, "assistant", trap), (2, 0, "a\nb<n<|", None), (3, 5, None, "x"), (3, 5, None, "x")]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), part_chars=10)
    got = {r.conv_id: r for r in rows.mapInArrow(chat._read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    for c in (1, 2, 3):
        own = [(r or "", t or "") for k, _, r, t in turns if k == c]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()
    assert chat.parse("{{ 'a' ~ 'b' | upper }}{% if 1 == 1 %}x{% else %}y{% endif %}") == [("text", "aBx")]
    for bad in ("{{ m.text | raw }}", "{{ open('x') }}", "{% for a in b %}{% endfor %}", "{% if x %}", "{{ m.__class__() }}", "{% endfor %}"):
        with pytest.raises(SyntaxError):
            chat.compile_template(bad)


def test_leaks(spark):
    docs = all_docs()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet' order by 1").fetchall()
    planted = [(10_000 + i, f"{docs[i][1]} {t} {docs[i + 1][1]}") for i, t in items[:25]]
    rng = random.Random(2)
    for i, t in items[25:40]:  # reworded: one word in six goes
        w = t.split()
        planted.append((10_000 + i, docs[i][1] + " " + " ".join(x for x in w if rng.random() > 0.16)))
    df = spark.createDataFrame([(d, t) for d, t, _ in docs] + planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sum((10_000 + i, i) in got for i, _ in items[:25]) >= 24
    assert sum((10_000 + i, i) in got for i, _ in items[25:40]) >= 13
    words = {d: decontaminate.words(t.encode()) for d, t in [(d, t) for d, t, _ in docs] + planted}
    own = {i: decontaminate.words(t.encode()) for i, t in items}
    for d, i in got:  # no pair without the words
        assert sum(w in set(words[d]) for w in own[i]) >= 0.55 * len(own[i])
    a, b = np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])
    assert decontaminate.common_subsequence(a, b) == 2


def test_bpe(spark):
    texts = [t for _, t, _ in all_docs()[:60]] + ["", None, "  \n\n x", "naïve 日本語 🙂🙂 don't I'LL 1234567", "a" * 3000, "<|endoftext|>"]
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, keep_words=500).collect():
        t = texts[r.doc_id] or ""
        assert r.token_ids == want.encode_ordinary(t) and bytes(r.decoded).decode() == t


@pytest.mark.parametrize("seed", range(4))
def test_recompression(spark, seed):
    rng = random.Random(seed)
    width, letters = (6, "ab") if seed % 2 else (8, "abcde")
    base = [rng.choices(letters, k=60) for _ in range(6)]
    docs = []
    for d in range(60):
        words: list[str] = []
        for _ in range(rng.randrange(0, 5)):
            b = rng.choice(base)
            i = rng.randrange(50)
            words += b[i : i + rng.randrange(1, 40)] + rng.choices(letters, k=rng.randrange(0, 3)) + ["a"] * rng.choice([0, 0, 20])
        docs.append((d, " ".join(words)))
    got = {r.doc_id: r for r in recompression.drop_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=width).collect()}
    first: dict[tuple, int] = {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, t in docs:
        w = t.split()
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        assert got[d].kept == " ".join(x for j, x in enumerate(w) if j not in gone), (seed, d)
        assert got[d].n_removed == len(gone)


def test_simhash(spark):
    rng = random.Random(3)
    docs = [(d, t) for d, t, _ in all_docs()]
    for k in range(60):  # near copies of a long text, with a dense group
        w = docs[8][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "zzz"
        docs.append((1000 + k, " ".join(w)))
    fp = {}
    for d, t in docs:
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fp[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    up = {d: d for d in fp}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = simhash.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.id: (r.fp.hex(), r.component) for r in got} == {d: (f"{fp[d]:016x}", find(d)) for d in fp}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert 8 in kept and not kept & set(range(1000, 1060))


def test_secrets(spark):
    h = hashlib.sha256(b"k").hexdigest()
    texts = [t for _, t, _ in all_docs()] + [f"PassWord : '{h[:12]}' token=token : abcdefgh", "AK" + "IA" + h[:16].upper() + " é " + h, f"x gh{'p_'}{h[:36]} " + "https" + "://u" + ":p" + "w@h", "password=short", "api_key==abcdef api-key=abcdefg", None, ""]
    docs = list(enumerate(texts))
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    rules = [("assign", key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    for r in secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(rules) for m in re.finditer(p, t) if len(m[g]) >= n)
        assert [(s.start, s.kind, s.end) for s in r.base_spans] == [(a, k, b) for a, _, k, b in want]
        assert {tuple(s) for s in r.base_spans} <= {tuple(s) for s in r.spans}
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("abcd(ef|gh)x?") == frozenset([frozenset(["abc", "bcd", "cde", "def"]), frozenset(["abc", "bcd", "cdg", "dgh"])])


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    held = {r.doc_id for r in docs.where(langid.held_out()).select("doc_id").collect()}
    assert held == {d for d, _, _ in all_docs() if zlib.crc32(str(d).encode()) % 5 == 0}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert sum(got[d].lang_pred == lang for d, _, lang in all_docs() if d in held) >= 0.95 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    more = langid.predict(spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in more] == ["und"] * 3


def test_lines(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet' union all select 5000 + i, 'A shared line of some length ' || chr(13) || chr(10) || chr(10) || 'own' || i, 'en', 's', 0 from range(5) t(i)")
    df = spark.createDataFrame([tuple(r) for r in con.execute("select doc_id, text from documents").fetchall()], "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == set(con.execute(line_dedup.OP9_SQL).fetchall())


def test_lm(spark):
    docs = all_docs()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _, _ in docs}
    count = Counter(w for d, t, _ in docs if not held[d] for w in [*t.encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for frequent in (100_000, 50):
        rows = lm.score_texts(frame, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, max_frequent=frequent).collect()
        text = {d: t for d, t, _ in docs}
        for r in rows:
            w = [*text[r.id].encode().lower().split(), b"\n"]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.id], len(w), sum(x in count for x in w), n)
            assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    # better, on texts it has not seen, than how often each subword stands in the training texts, and than pairs of subwords
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(lm.VOCABULARY), "rb"))}
    sub = lm.Subwords(ranks)
    spelled = {d: sub.spell(lm.Words([t.encode()]))[0] for d, t, _ in docs}
    table = np.bincount(np.concatenate([x for d, x in spelled.items() if not held[d]]), minlength=sub.end + 1) + 0.01
    plain = sum(float(np.log10(table[x] / table.sum()).sum()) for d, x in spelled.items() if held[d])
    pieces = sum(len(x) for d, x in spelled.items() if held[d])
    score = sum(r.score for r in rows if r.held_out)
    assert score > plain + 0.3 * pieces
    follow = {}
    for d, x in spelled.items():
        if not held[d]:
            for a, b in zip([sub.end, *x[:-1].tolist()], x.tolist(), strict=True):
                follow.setdefault(a, Counter())[b] += 1
    pairs = 0.0
    for d, x in spelled.items():  # the pair table, smoothed after Witten and Bell
        if held[d]:
            for a, b in zip([sub.end, *x[:-1].tolist()], x.tolist(), strict=True):
                c = follow.get(a, Counter())
                pairs += math.log10((c[b] + len(c) * table[b] / table.sum()) / (c.total() + len(c)) if c else table[b] / table.sum())
    assert score > pairs


def test_held_out_scores_near_base(spark):
    """Known words keep their share, and hashes cost about what their digits do."""
    said = "the cat sat on a mat and the dog ran to the tree in a park by the sea".split()
    docs = [(i, " ".join(said[(i * k) % len(said)] for k in range(1, 30)) + " " + hashlib.sha256(str(i).encode()).hexdigest()[:40], i % 5 == 0) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, held boolean")
    rows = [r for r in lm.score_texts(frame, F.col("held")).collect() if r.held_out]
    assert len(rows) == 60 and all(math.isfinite(r.score) for r in rows)
    # at most 1.6 a digit, where the hash stands as one new word in base_score
    assert all(r.score > r.base_score - 64 - 0.31 * r.n_tokens for r in rows)


def test_lm_gradients_and_scoring():
    rng = np.random.default_rng(0)
    size = 30
    vectors, own = rng.normal(size=(size, lm.DIM)).astype(np.float32), rng.integers(0, lm.EXPERTS, size)
    experts = rng.dirichlet(np.ones(size), lm.EXPERTS).T
    w = lm.flat(lm.begin()) + rng.normal(0, 0.1, len(lm.flat(lm.begin())))
    x = rng.integers(0, size, (3, lm.WINDOW))
    y = np.where(rng.random((3, lm.WINDOW)) < 0.1, -1, rng.integers(0, size, (3, lm.WINDOW)))
    about = lm.features(vectors.astype(np.float64), own)
    frequent = rng.permutation(size)[:12]
    n = rng.integers(0, 4, (12, 12))
    context = np.full(size, 5)
    context[frequent] = n.sum(axis=1) + rng.integers(0, 9, 12)
    followers = lm.Followers(frequent, context, rng.dirichlet(np.ones(size)), n)
    each = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    assert np.allclose(followers.share(*each).reshape(size, size).sum(axis=1), 1, atol=1e-4) and np.allclose(followers.share(*each), lm.Table(followers).share(*each), atol=1e-5)
    a, b = np.argwhere(n > 0)[0]
    fewer = n.copy()
    fewer[a, b] -= 1
    less = lm.Followers(frequent, context - (np.arange(size) == frequent[a]), followers.whole, fewer)
    assert np.allclose(followers.share(frequent[[a]], frequent[[b]], 1), less.share(frequent[[a]], frequent[[b]]))
    _, g = lm.gradients(lm.shaped(w), x, y, about, experts, followers)
    for k in rng.integers(0, len(w), 40):
        step = np.zeros_like(w)
        step[k] = 1e-5
        slope = (lm.gradients(lm.shaped(w + step), x, y, about, experts, followers)[0] - lm.gradients(lm.shaped(w - step), x, y, about, experts, followers)[0]) / 2e-5
        assert math.isclose(slope, lm.flat(g)[k], rel_tol=1e-3, abs_tol=1e-7)
    model = lm.Model(w, vectors, own, experts, followers)
    texts = [rng.integers(0, size, n) for n in (2, 17, 18, 60)]
    got = model.logs(np.concatenate(texts), np.array([len(t) for t in texts]))
    want = []
    for t in texts:  # each place on its own, from its block's and the block before's places
        for i in range(len(t) - 1):
            seen = t[max(0, i // lm.BLOCK - 1) * lm.BLOCK : i + 1]
            s = np.array([model.q[t[i]] @ model.k[u] + model.far[i % lm.BLOCK, lm.BLOCK + i % lm.BLOCK - (len(seen) - 1 - j)] for j, u in enumerate(seen)])
            a = np.exp(s) / np.exp(s).sum()
            z = np.exp((a @ model.v[seen]) @ model.c + model.gate[t[i]])
            share = np.append(model.experts[t[i + 1]], followers.share(t[[i]], t[[i + 1]]))
            want.append(np.log10(z @ share / z.sum()))
    assert np.allclose(got, want, atol=1e-4)
