import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from colliding import thue_morse

from textwarden.llm import near_dedup as nd


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k=4, percent=80):
    """Components by comparing all pairs."""
    ids = [i for i, _ in rows]
    vocabulary = {}
    sets = [np.array(sorted(vocabulary.setdefault(s, len(vocabulary)) for s in shingles(t, k)), dtype=int) for _, t in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flags = np.zeros(len(vocabulary), bool)
    for x in range(len(rows)):
        flags[:] = False
        flags[sets[x]] = True
        for y in range(x):
            n, m = len(sets[x]), len(sets[y])
            if n and m and 100 * min(n, m) >= percent * max(n, m):
                i = int(flags[sets[y]].sum())
                if 100 * i >= percent * (n + m - i):
                    a, b = sorted((root(ids[x]), root(ids[y])))
                    parent[b] = a
    return {i: (len(s), root(i)) for i, s in zip(ids, sets, strict=True)}


def check(spark, texts, **kw):
    spec = nd.NearDedup(**({"shingle": 4} | kw))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), spec).collect()}
    want = brute(texts, spec.shingle, spec.percent)
    assert got == want
    return want


def test_whole_table(spark, sf="/root/testdata/sf0.01"):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    got = nd.op1_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_short_texts_and_blocks(spark):
    r = random.Random(3)
    rows, n = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a"), (906, "one two three four"), (907, "one TWO three\tfour")], 0
    for _ in range(4):  # chains: each text differs a little from the one before
        words = [f"w{r.randrange(500)}" for _ in range(120)]
        for _ in range(25):
            rows.append((n, " ".join(words)))
            n += 1
            for _ in range(2):
                words[r.randrange(120)] = f"x{r.randrange(10**6)}"
    r.shuffle(rows)
    want = check(spark, rows, block=8)
    assert len({c for _, c in want.values()}) < 60


def test_hidden_from_the_star_centre(spark):
    """a and b are similar, their bucket's centre is similar to a alone."""
    base = [f"t{i}" for i in range(200)]
    rows = []
    for k in range(40):
        words = base.copy()
        for j in range(k):
            words[(j * 5) % 200] = f"r{j}"
        rows.append((k, " ".join(words)))
    check(spark, rows, block=4)


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"q{i}" for i in range(50))
    rows = [(None, text), (None, None), (1, text), (1, text), (2, text + " z"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), nd.NearDedup(shingle=4)).collect()), key=str)
    assert got == sorted([(None, 47, None, True), (None, 0, None, True), (1, 47, 1, True), (1, 47, 1, True), (2, 48, 1, False), (3, 0, 3, True)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(f"q{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "en", "k"), (2, text, "en", "k"), (3, "other", "en", "k"), (None, text, "en", "k")], "doc_id long, text string, lang string, component_id string")
    out = nd.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_give_up_bounds():
    spec = nd.NearDedup()
    steps = nd.least_matches(spec, spec.long)
    assert steps[-1][0] == spec.long and all(0 <= m <= n for n, m in steps)
    assert nd._binomial(spec.long, 0.8)[steps[-1][1] :].sum() > 1 - 1e-4  # a pair at the threshold stays
    tail = lambda n, least: sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least, n + 1))
    for n, m in steps[:6]:
        assert 1 - tail(n + 1, m + 1) >= spec.miss and (m == 0 or 1 - tail(n + 1, m) < spec.miss)


def test_colliding_words_are_not_linked(spark):
    a, b = thue_morse()
    long = [" ".join(f"t{i}" if i % 5 else x for i in range(300)) for x in (a, b)]
    check(spark, [(1, a), (2, b), (3, long[0]), (4, long[1]), (5, a.upper())])


@pytest.mark.parametrize("spoiled", [False, True])
def test_pairs_are_verified_by_their_words(monkeypatch, spoiled):
    """The exact check holds even where all words and all windows share a hash."""
    if spoiled:
        monkeypatch.setattr("textwarden.llm.words.hash_ranges", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    left, right = [], []
    for k in range(60):
        x = base[: r.randrange(101)]
        y = base[: len(x) - r.randrange(12)] if len(x) > 12 else base[: r.randrange(101)]
        for _ in range(k % 7):
            y = [*y, f"z{r.randrange(3)}"] if not y or r.random() < 0.5 else [*y[: len(y) // 2], "q", *y[len(y) // 2 + 1 :]]
        left.append(" ".join(x) if k else None)
        right.append("\t".join(y).upper())
    spec = nd.NearDedup(shingle=4)
    got = nd.similar(pa.array(left), pa.array(right), spec)
    sets = [(shingles(x, 4), shingles(y, 4)) for x, y in zip(left, right)]
    long = [len((x or "").split()) >= 4 and len(y.split()) >= 4 for x, y in zip(left, right)]
    assert got.tolist() == [ok and 100 * len(x & y) >= 80 * len(x | y) for ok, (x, y) in zip(long, sets)]
    assert 5 < got.sum() < 55


def test_large_groups_are_banded_again(spark):
    """Many texts that share a boilerplate half, among them near copies; groups are far larger than a block."""
    r = random.Random(11)
    boiler = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words = [*boiler, *(f"o{r.randrange(10**6)}" for _ in range(60))]
        for j in range(2):
            words[100 + j] = f"v{k}-{j}"
            rows.append((2 * k + j, " ".join(words)))
    want = check(spark, rows, block=16, rows=2, bands=48)
    assert len({c for _, c in want.values()}) == 90


def test_no_table_is_left_behind(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    nd.near_duplicates(spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")).count()
    assert [x.name.split("-")[0] for x in set(folder.iterdir()) - before] == ["components"]
