import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import decontaminate as d
from textwarden.llm.automaton import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in found}
    out = []
    for i, text in docs:
        w, hit, by = words(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := found.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    by |= x
        out.append((i, len(w), len(hit), len(by), hashlib.sha256(",".join(sorted(by)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    rows = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **kw)
    out = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in d.summary(rows).collect()]
    return sorted(out, key=str)


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short one é"), (3, None), (4, "..."), (5, "W3, w4! w5 w6 w7 w8 w9 w10 w11 W12"), (None, "alone"), (2, "Short one é"), (10, "a a a a a a a a a a a a")]
DOCS = [
    (1, "x W0-w1 w2_w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 y"),
    (2, "short ONE é, short one é"),
    (3, "short one éa bshort one e"),
    (4, None),
    (5, ""),
    (None, "ALONE"),
    (6, "a " * 30),
    (7, "日本 short\none\té."),
    (7, "日本 short\none\té."),
    (8, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x w9 w10 w11"),
    (9, "clean words only " * 20_000),
]


def test_equals_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert run(spark, DOCS, []) == brute(DOCS, [])
    assert run(spark, [], ITEMS) == []


def test_more_automata_than_one(spark, monkeypatch):
    monkeypatch.setattr(d, "MAX_STATES", 30)
    monkeypatch.setattr(d, "HOLD_BYTES", 200)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_offsets_point_into_the_original(spark):
    row = d.contamination(spark.createDataFrame([(1, "Ü ü!  Short,\tONE é ...")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert [("Ü ü!  Short,\tONE é ..."[h.start : h.end], h.first_word, h.n_words) for h in row.ranges] == [("Short,\tONE é", 2, 3)] and row["items"] == ["2"]


def test_whole_table(spark, sf="/root/testdata/sf0.01"):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in d.op9_decontaminate(spark, sf).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_stage(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, hits string, n_words long")
    out = d.decontaminate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 4, 5, 8, 9]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=5), min_size=1, max_size=8), st.lists(st.integers(-1, 3), max_size=400))
def test_automaton_finds_what_comparing_finds(patterns, words):
    sizes = sorted({len(p) for p in patterns})
    by = [np.array([p for p in patterns if len(p) == k]) for k in sizes]
    a = Automaton(by, 4)
    ends = dict(zip(a.ends.tolist(), [tuple(p) for x in by for p in x.tolist()]))
    got = a.scan(np.array(words, np.int64))
    for i, state in enumerate(got.tolist()):
        want = [tuple(words[i + 1 - k : i + 1]) for k in sizes[::-1] if i + 1 >= k and words[i + 1 - k : i + 1] in patterns]
        chain = []
        while state:
            chain.append(ends[state])
            state = int(a.shorter[state])
        assert chain == want


def local(texts, items, window=10):
    """Of texts: ranges and items, without Spark."""
    names = sorted({n for n, _ in items})
    part = d._part([(names.index(n), d._words(t.encode())) for n, t in items], window)

    class Sent:
        value = part

    rows = next(d._scan([Sent()], names, 0)(iter([pa.record_batch([pa.array(texts)], ["t"])])))
    return part, rows.column("ranges").to_pylist(), rows.column("items").to_pylist()


def test_long_text_of_short_items_stays_small():
    text = " ".join(f"i{k % 20}" for k in range(300_000))
    items = [(f"n{k:02}", f"i{k}") for k in range(20)]
    local(["warm up"], items)
    began = time.process_time()
    _, ranges, found = local([text], items)
    assert time.process_time() - began < 2
    assert [(r["first_word"], r["n_words"], r["start"], r["end"]) for r in ranges[0]] == [(0, 300_000, 0, len(text))] and found[0] == [n for n, _ in items]


def test_memory_of_a_large_benchmark():
    """A megabyte of items: at most 75 bytes for each byte of text, and the planted passages are found in one scan."""
    r = random.Random(1)
    items = [(f"q{k}", " ".join(f"w{r.randrange(20_000)}" for _ in range(60))) for k in range(2800)]
    docs = [items[k][1][r.randrange(100) :] for k in range(0, 2800, 40)] + [" ".join(f"w{r.randrange(20_000)}" for _ in range(500)) for _ in range(50)]
    part, ranges, found = local(docs, items)
    assert part.automaton.bytes < 75 * sum(len(t) for _, t in items)
    assert [x for x in found[:70]] == [[f"q{k}"] for k in range(0, 2800, 40)] and not any(found[70:]) and not any(ranges[70:])


@pytest.mark.parametrize("spoiled", [False, True])
def test_words_that_share_a_hash_with_the_benchmark(monkeypatch, spoiled):
    if spoiled:  # hashes of the length alone: the benchmark's words have different ones, the documents' words don't
        short = lambda data, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(50)
        monkeypatch.setattr("textwarden.llm.words.hash_ranges", short)
        monkeypatch.setattr(d, "hash_ranges", short)
    items = [("x", "a bb ccc"), ("y", "dddd a")]
    texts = ["a bb ccc", "a bx ccc a bb ccc", "dddd b a", "ddxd a dddd a", ""]
    _, ranges, found = local(texts, items, 3)
    assert found == [["x"], ["x"], [], ["y"], []]
    assert [[(r["first_word"], r["n_words"]) for r in x] for x in ranges] == [[(0, 3)], [(3, 3)], [], [(2, 2)], []]
