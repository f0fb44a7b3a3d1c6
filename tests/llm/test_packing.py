import random
import struct
import zlib

import pytest

from textwarden.llm import packing as p
from textwarden.llm.tokens import tokenizer_path

TEXTS = [None, "", " ", "hello <|endoftext|> <|ENDOFTEXT|> it's", "It's 'S we'LL !'s x!'s a1b22 é!É́ é!", "\x01 a \x01", "a b c\x1cd", "word " * 9000, "x" * 3000, "Don't___stop 中文 αΣ ΑΣ", "a b", "a b"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]


def check(rows, docs, encode):
    """Pieces and places against a plain encoding. docs: id to text."""
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(docs)
    for i, text in docs.items():
        ids, got = encode(text), sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in got] == [(k, 4096 * k) for k in range(-(-len(ids) // 4096))]
        for r in got:
            cut = ids[r.start : r.start + 4096]
            assert r.length == len(cut) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), -(-sum(r.length for r in rows) // 4096)


def test_edge_texts(spark, encode):
    docs = dict(enumerate(TEXTS))
    made = p.pieces(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    packed = p.pack(made).cache()
    check(packed.withColumnRenamed("id", "doc_id").collect(), docs, encode)
    whole = {(x.id, x.piece): s.ids[2 * x.offset : 2 * (x.offset + x.length)] for s in p.sequences(packed).collect() for x in s.pieces}
    for r in made.collect():
        assert whole[r.id, r.piece] == r.ids == struct.pack(f"<{r.length}H", *encode(docs[r.id])[r.start : r.start + r.length])
    assert p.pack(p.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert p.pack(p.pieces(spark.createDataFrame([(None, "a", "x")] * 3, "doc_id long, text string, ids string"))).count() == 3


def test_whole_table_is_packed_tightly(spark, encode, sf="/root/testdata/sf0.01"):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check(p.op8_pack(spark, sf).collect(), docs, encode)
    assert used <= least + 1


def brute_fullest(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    return max(s for m in range(1 << len(items)) if (s := sum(x for i, x in enumerate(items) if m >> i & 1)) <= room)


def test_fullest_equals_all_subsets():
    r = random.Random(1)
    for _ in range(60):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(0, 90)
        got = p.fullest(counts, room)
        assert all(n <= counts[k] for k, n in got)
        assert sum(k * n for k, n in got) == brute_fullest(counts, room)


def test_plan_uses_every_piece():
    r = random.Random(2)
    histogram = {r.randrange(1, 4097): r.randrange(1, 50) for _ in range(900)} | {4096: 5000, 1: 40}
    used = {}
    for s in p.plan(histogram):
        assert sum(k * n for k, n in s.parts) <= 4096
        for k, n in s.parts:
            used[k] = used.get(k, 0) + n * s.times
    assert used == histogram
