"""The LM learns from whole texts."""

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cloakwork.llm import lm

TEXTS = ["One short text", None, "", " ".join(f"word{i}" for i in range(500)), " \tA\u00a0b \u2003c\x1cd  e\x85 \x0b'S it's \x00 \ufffd 12ab,,x\r\n", "x" * 5000 + " y"]


class Shared:
    value = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(lm.VOCABULARY), "rb"))}


def spelled_alone(sub, text):
    """Subwords of a text, word by word."""
    return [i for w in (text or "").encode().lower().split() for i in sub.encoding.encode_ordinary(" " + w.decode())] + [sub.end]


def test_spelling_and_windows_cover_texts():
    sub = lm.Subwords(Shared.value)
    got = list(lm._spelled(Shared, "uint16")(iter([pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["id", "text"])])))
    counts = {w: n for b in got for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if w is not None}
    assert counts[lm.END] == len(TEXTS) and counts[b"word7"] == 1
    rows = [b.filter(b.column(0).is_valid()) for b in got]
    x, n = next(lm._texts(iter(rows), "uint16"))
    alone = [spelled_alone(sub, t) for t in TEXTS]
    assert x.tolist() == [i for a in alone for i in [sub.end, *a]] and n.tolist() == [len(a) + 1 for a in alone]
    every, at = lm.windows(x, n), 0
    for want in alone:
        some = every[at : at + -(-len(want) // lm.WINDOW)]
        assert some[0, 0] == sub.end and (some[1:, 0] == some[:-1, -1]).all()
        seen = some[:, 1:].ravel()
        assert seen[seen >= 0].tolist() == want
        at += len(some)
    assert at == len(every)


def test_counts_of_neighbours():
    sub = lm.Subwords(Shared.value)
    size = sub.end + 1
    own = np.arange(size) % lm.EXPERTS
    texts = ["a b a b", "b", None]
    rows = [pa.RecordBatch.from_arrays([pa.array([np.array([sub.end, *spelled_alone(sub, t)], "uint16").tobytes() for t in texts])], names=["ids"])]

    class Classes:
        value = own, np.unique(np.concatenate([spelled_alone(sub, t) for t in texts]))[:2]

    pairs = next(lm._pairs(size, "uint16", Classes)(iter(rows)))
    want = {}
    for t in texts:
        x = [sub.end, *spelled_alone(sub, t)]
        for a, b in zip(x, x[1:], strict=False):
            if (a, b) != (sub.end, sub.end):  # an empty text says nothing
                k = int(own[a]) * size + b
                want[k] = want.get(k, 0) + 1
    n_pairs, frequent = sum(want.values()), Classes.value[1].tolist()
    for t in texts:
        x = [sub.end, *spelled_alone(sub, t)]
        for a, b in zip(x, x[1:], strict=False):
            if a in frequent and b in frequent:
                k = lm.EXPERTS * size + frequent.index(a) * len(frequent) + frequent.index(b)
                want[k] = want.get(k, 0) + 1
    assert dict(zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True)) == want
    sketch = next(lm._sketch(size, "uint16")(iter(rows)))
    assert sum(sketch.column(1).to_pylist()) == 2 * n_pairs


def test_words_that_come_again_are_spelled_once():
    sub, plain = lm.Subwords(Shared.value), lm.Subwords(Shared.value)
    asked = []

    class Asked:
        def encode_to_numpy(self, text, **kinds):
            asked.append(text)
            return plain.encoding.encode_to_numpy(text, **kinds)

    first, second = ["frequenter étagère frequenter étagère once", ""], ["étagère once again", "frequenter \U0001f600 don't " + "y" * 3000]
    sub.encoding = Asked()
    for texts in (first, second):
        got, want = sub.spell(lm.Words([t.encode() for t in texts])), lm.Subwords(Shared.value).spell(lm.Words([t.encode() for t in texts]))
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert "frequenter" in asked[0] and not any(w in asked[1] for w in ("frequenter", "étagère"))
    known = pa.array([b"ab", b"\xff", b"c"], pa.large_binary())
    end = lm.LETTERS - 1
    assert lm._byte_pairs(known.slice(1))[0].tolist() == [end * lm.LETTERS + 255, 255 * lm.LETTERS + end, end * lm.LETTERS + 99, 99 * lm.LETTERS + end]
    assert lm._byte_pairs(known)[1].tolist() == [0, 3, 5]


def test_table_leaves_pairs_out_and_blocks_meet_in_long_texts():
    rng = np.random.default_rng(1)
    size, many = 40, 15
    frequent, n = rng.permutation(size)[:many], rng.integers(0, 4, (many, many))
    n[3] = 0  # a frequent subword that none of the others follows
    context = rng.integers(0, 3, size)
    context[frequent] = n.sum(axis=1) + rng.integers(0, 5, many)
    followers = lm.Followers(frequent, context, rng.dirichlet(np.ones(size)), n)
    each = np.repeat(np.arange(size), size), np.tile(np.arange(size), size)
    table = lm.Table(followers, 1)
    assert np.allclose(table.share(*each, 1), followers.share(*each, 1), rtol=1e-5, atol=1e-9)
    with pytest.raises(ValueError):
        table.share(*each)
    vectors, own, experts = rng.normal(size=(size, lm.DIM)).astype(np.float32), rng.integers(0, lm.EXPERTS, size), rng.dirichlet(np.ones(size), lm.EXPERTS).T
    w = lm.flat(lm.begin()) + rng.normal(0, 0.1, len(lm.flat(lm.begin())))
    x, y = rng.integers(0, size, (5, lm.WINDOW)), rng.integers(-1, size, (5, lm.WINDOW))
    about = lm.features(vectors.astype(np.float64), own)
    got, want = (lm.gradients(lm.shaped(w), x, y, about, experts, f) for f in (table, followers))
    assert np.isclose(got[0], want[0], rtol=1e-5) and np.allclose(lm.flat(got[1]), lm.flat(want[1]), rtol=1e-3, atol=1e-6)
    # weights that send every attention score far below what a float32 exponential holds still give numbers
    low = lm.shaped(w.copy())
    low["k"] = -60 * low["q"]
    loss, g = lm.gradients({k: v.astype(np.float32) for k, v in low.items()}, x, y, about.astype(np.float32), experts.astype(np.float32), table)
    assert np.isfinite(loss) and np.isfinite(lm.flat(g)).all()
    # scores don't depend on where a step of 512 blocks ends
    model = lm.Model(w, vectors, own, experts, followers)
    texts = [rng.integers(0, size, k) for k in (3, 4091, 2, 9, 700, 4200)]
    whole = model.logs(np.concatenate(texts), np.array([len(t) for t in texts]))
    alone = [model.logs(t[max(0, k - lm.BLOCK) : k + lm.BLOCK + 1], np.array([len(t[max(0, k - lm.BLOCK) : k + lm.BLOCK + 1])]))[k and lm.BLOCK :] for t in texts for k in range(0, len(t) - 1, lm.BLOCK)]
    assert np.allclose(whole, np.concatenate(alone), atol=1e-4)
