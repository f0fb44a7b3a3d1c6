from collections import Counter

import pytest

from textwarden.llm import sharding as s


def brute(names, size):
    """The fill as a plain simulation over whole preference lists."""
    orders = {n: [(s._preference(n, size)[0] + j * s._preference(n, size)[1]) % size for j in range(size)] for n in sorted(names)}
    owner = {}
    while True:
        for n, order in orders.items():
            owner[next(x for x in order if x not in owner)] = n
            if len(owner) == size:
                return [owner[k] for k in range(size)]


@pytest.mark.parametrize("n,size", [(1, 2), (3, 7), (5, 101), (13, 13)])
def test_equals_simulation(n, size):
    names = [f"n{k}" for k in range(n)]
    assert [names[k] for k in s.lookup_table(names, size)] == brute(names, size)
    back = names[::-1]
    assert [back[k] for k in s.lookup_table(back, size)] == brute(names, size)


def test_even_and_stable():
    full = [s.SHARDS[k] for k in s.lookup_table()]
    shares = Counter(full)
    assert len(shares) == 64 and max(shares.values()) - min(shares.values()) <= 1
    less = s.SHARDS[:20] + s.SHARDS[21:]
    now = [less[k] for k in s.lookup_table(less)]
    moved = sum(a != b and a != s.SHARDS[20] for a, b in zip(full, now, strict=True))
    assert moved < 0.06 * s.SIZE


def test_errors():
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            s.lookup_table(names, size)


def test_query_and_edges(spark, sf="/root/testdata/sf0.01"):
    got = s.op7_sharding(spark, sf).collect()
    table = s.lookup_table()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(s.SHARDS[table[r.slot]] == r.shard for r in got)
    again = {r.doc_id: r.shard for r in s.op7_sharding(spark, sf).collect()}
    assert all(again[r.doc_id] == r.shard for r in got)
    df = spark.createDataFrame([(None, "x", 1), (None, "y", 2), (5, "z", 3), (5, "z", 3)], "doc_id long, slot string, shard int")
    out = s.place(df, ["doc_id"], prefix="to_")
    assert out.columns == [*df.columns, "to_slot", "to_shard"]
    rows = out.collect()
    assert len(rows) == 4 and len({r.to_shard for r in rows if r.doc_id is None}) == 1
    assert s.place(df.limit(0), ["doc_id", "slot"], prefix="to_").count() == 0


def test_query_places_whole_rows(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = s.op7_sharding(spark, sf)
    assert got.columns == [*docs.columns, "slot", "shard"]
    assert Counter(map(tuple, got.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))


def test_columns_of_the_same_names_pass(spark):
    df = spark.createDataFrame([(1, "x", 7, "c"), (None, None, None, None)], "slot long, shard string, doc_id long, c0 string")
    out = s.place(df, ["doc_id"])
    assert out.columns == ["slot", "shard", "doc_id", "c0", "slot", "shard"]
    assert {tuple(r)[:4] for r in out.collect()} == {(1, "x", 7, "c"), (None, None, None, None)}
    assert [r[-1] for r in s.place(df, ["slot"]).where("c0 = 'c'").collect()] == [r[-1] for r in s.place(df.withColumnRenamed("slot", "k"), ["k"]).where("c0 = 'c'").collect()]
