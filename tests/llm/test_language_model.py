import math
import re
import zlib
from collections import Counter

import numpy as np

from textwarden.llm import language_model as lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute_base(docs):
    """docs: (id, text). Per row: held_out, n_tokens, n_known, N, base."""
    mod = [None if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in docs]
    c = Counter(w for (_, t), m in zip(docs, mod) if m is not None and m != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), m in zip(docs, mod):
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((i, None if m is None else m == 1, len(own), sum(c[w] > 0 for w in own), n, base))
    return out


def compare(rows, docs):
    want = brute_base(docs)
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in rows)


def test_whole_table(spark, sf="/root/testdata/sf0.01"):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = lm.op10_language_model(spark, sf).collect()
    compare(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


SMALL = lm.Sizes(20, 8, 4, 3)


def test_more_words_than_are_frequent(spark):
    docs = [(k, " ".join(f"w{(k * j) % 37}x" for j in range(k % 30))) for k in range(60)] + [(None, "a b"), (None, None), (3, "again"), (3, "again"), (77, ""), (78, "ß日 \n\t Q q"), (79, "long " * 5000)]
    rows = lm.score(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_tokens int"), sizes=SMALL).collect()
    compare(rows, docs)


def test_nothing_to_train_on_and_empty(spark):
    docs = [(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1]
    assert docs
    compare(lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def model(r, k=3):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return lm.Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((9, k)), 0))


def paths(m, x):
    """Likelihood and expected counts by summing over all state paths."""
    import itertools

    k, total, emit, move, start = len(m.start), 0.0, np.zeros_like(m.emit), np.zeros_like(m.move), np.zeros_like(m.start)
    for s in itertools.product(range(k), repeat=len(x)):
        p = m.start[s[0]] * m.emit[x[0], s[0]] * math.prod(m.move[a, b] * m.emit[y, b] for a, b, y in zip(s, s[1:], x[1:]))
        total += p
        start[s[0]] += p
        for c, a in zip(x, s):
            emit[c, a] += p
        for a, b in zip(s, s[1:]):
            move[a, b] += p
    return total, start / total, move / total, emit / total


def test_forward_and_counts_equal_sums_over_paths():
    r = np.random.default_rng(5)
    m = model(r)
    xs = [r.integers(0, 9, n) for n in (4, 1, 6, 2, 6)]
    flat, lengths = np.concatenate(xs), np.array([len(x) for x in xs])
    want = [paths(m, x) for x in xs]
    assert np.allclose(lm.forward(m, flat, lengths), [math.log10(w[0]) for w in want])
    for got, k in zip(lm.expected(m, flat, lengths), (1, 2, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_counts_of_cut_texts_are_those_of_whole_texts():
    r = np.random.default_rng(6)
    m = model(r)
    xs = [r.integers(0, 9, n) for n in (7, 1, 3, 4, 8, 6, 2)]
    flat, lengths = np.concatenate(xs), np.array([len(x) for x in xs])
    want = [sum(w) for w in list(zip(*(paths(m, x) for x in xs)))[1:]]
    for run, at_once in ((1, 1), (2, 4), (3, 1 << 19), (3, 1), (512, 1 << 19)):
        for got, w in zip(lm.counted(m, flat, lengths, run, at_once), want, strict=True):
            assert np.allclose(got, w, rtol=1e-9)
    xs = [r.integers(0, 9, n) for n in (5000, 513, 512, 511, 1025)]
    flat, lengths = np.concatenate(xs), np.array([len(x) for x in xs])
    for got, w in zip(lm.counted(m, flat, lengths, 512, 2048), lm.expected(m, flat, lengths), strict=True):
        assert np.allclose(got, w, rtol=1e-9)


def test_training_does_not_depend_on_the_length_of_runs(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k + j * j) % 11}" for j in range(20 + k))) for k in range(30)], "id long, text string").selectExpr("id", "false held_out", "true train", "text")
    models = []
    for run in (3, 512):
        counts = lm.count_words(docs, lm.Sizes(20, 8, 4, run))
        models.append(lm.train(lm.classify(docs, counts), counts))
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(models[0], name), getattr(models[1], name), rtol=1e-6)


def test_the_model_is_a_distribution(spark):
    """Over the next word of a known vocabulary, plus one unseen word in each shared class, probabilities add up to one."""
    docs = spark.createDataFrame([(k, f"a{k % 7} b{k % 5} c") for k in range(50)], "doc_id long, text string").selectExpr("doc_id id", "false held_out", "true train", "text")
    counts = lm.count_words(docs)
    m = lm.train(lm.classify(docs, counts).where("train"), counts, states=2, rounds=2)
    assert np.allclose(m.emit.sum(axis=0), 1) and np.allclose(m.move.sum(axis=1), 1) and math.isclose(m.start.sum(), 1)
    share = (counts.suffix_c + 0.5 * counts.suffix_v + 0.5) / (counts.suffix_c + 0.5 * (counts.suffix_v + 1))
    assert np.allclose(share, 1)
