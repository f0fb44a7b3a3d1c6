import random

import duckdb
from pyspark.sql import functions as F

from textwarden.llm import revisits as v

SCHEMA = "record_id long, url string, ts long, status int, headers array<struct<name:string,value:string>>, key string"


def get(headers, name):
    return next((x for n, x in headers or [] if n.lower() == name), None)


def brute(records):
    keys = {}
    out = []
    for i, url, ts, status, headers in records:
        if status != 304:
            continue
        best = max(((t, j, h) for j, u, t, s, h in records if s == 200 and None not in (u, t, url, ts) and keys.setdefault(u, u.split("#")[0]) == keys.setdefault(url, url.split("#")[0]) and t < ts), key=lambda x: x[:2], default=None)
        if best is None:
            out.append((i, None, "no_response"))
            continue
        a, b = ((get(h, "etag") or "").removeprefix("W/") for h in (best[2], headers))
        if not (a and b):
            a, b = (get(h, "last-modified") for h in (best[2], headers))
        out.append((i, best[1], "unverified" if not (a and b) else "resolved" if a == b else "changed"))
    return sorted(out)


def test_equals_brute_force_with_a_hot_url(spark):
    r = random.Random(1)
    records = []
    for i in range(600):
        url = r.choice([None, "a.b/x", "a.b/x#f", "a.b/x", "a.b/y", f"a.b/{r.randrange(40)}"])
        headers = r.choice([None, [], [("ETag", r.choice(['"1"', 'W/"1"', '"2"']))], [("last-modified", r.choice("ab")), ("X", "y")]])
        records.append((i, url, r.choice([None, *range(200)]), r.choice([200, 304, 304, 404]), headers))
    df = spark.createDataFrame([(*x, "k") for x in records], SCHEMA)
    assert sorted((x.record_id, x.target_id, x.verdict) for x in v.resolve(df).collect()) == brute(records)
    assert v.resolve(df.limit(0)).count() == 0
    twice = v.resolve(df.union(df)).count()
    assert twice == 2 * sum(x[3] == 304 for x in records)


def test_headers_that_may_be_renewed(spark):
    old = [("Content-Type", "t"), ("ETag", '"1"'), ("Date", "d1"), ("Set-Cookie", "c"), ("Vary", "v")]
    new = [("etag", 'W/"1"'), ("date", "d2"), ("Content-Type", "no"), ("Set-Cookie", "no")]
    row = v.resolve(spark.createDataFrame([(1, "a/b", 1, 200, old, ""), (2, "http://A/b/", 2, 304, new, "")], SCHEMA)).first()
    assert [tuple(h) for h in row.headers] == [("Content-Type", "t"), ("Set-Cookie", "c"), ("Vary", "v"), ("etag", 'W/"1"'), ("date", "d2")]


def test_canonical_urls(spark):
    same = ["http://www.Ex.org:80/a/?b=2&a=1#x", "https://ex.org/a?a=1&utm_source=q&b=2", "ex.org:443/a//?a=1&b=2&", " HTTP://WWW2.ex.org/a?UTM_x=1&a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://ex.org", "http://ex.org/A", "", None]], "u string").select(v.canonical_url(F.col("u")).alias("c")).collect()
    assert [r.c for r in rows] == ["ex.org/a?a=1&b=2"] * 4 + ["ex.org/", "ex.org/A", "/", None]


def test_query_equals_sql(spark, sf="/root/testdata/sf0.01"):
    got = sorted(map(tuple, v.op4_revisits(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(v.OP4_SQL).fetchall())


def test_repeated_record_ids_and_hot_targets_have_one_result(spark):
    """Responses that share a record_id give their greatest headers, in whatever order they come."""
    old = [[("ETag", '"1"'), ("Vary", x)] for x in "abc"]
    rows = [(1, "a/b", 1, 200, h, "") for h in old] + [(k, "a/b", k, 304, [("ETag", '"1"')], "") for k in range(2, 200)] + [(k, None, k, 304, [], "") for k in range(300, 400)]
    for n in (1, 7):
        got = v.resolve(spark.createDataFrame(rows[::-1] if n == 7 else rows, SCHEMA).repartition(n)).collect()
        assert len(got) == 298 and {(r.verdict, r.headers[0].value if r.headers else None) for r in got} == {("resolved", "c"), ("no_response", None)}
