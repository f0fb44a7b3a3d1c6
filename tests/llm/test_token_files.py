import heapq
import struct
import zlib

import numpy as np
import pytest

from textwarden.llm import token_files as tf
from textwarden.llm.tokens import tokenizer_path

TEXTS = [None, "", "hello <|endoftext|> it's", "word " * 9000, "x" * 3000, "a b", "a b"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]


def expected(docs, encode):
    out, start = [], 0
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = encode(text)
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [None, 1])
def test_edge_texts(spark, encode, tmp_path, shards):
    docs = [(10 * i - 30, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "a"), (7, "a")]
    tf.write(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, shard string").repartition(3), f"file://{tmp_path}/t", shards=shards)
    got = [tuple(r) for r in tf.read(spark, f"file://{tmp_path}/t").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(docs, encode)


def test_a_repeated_id_is_dealt_to_several_shards(spark, encode, tmp_path):
    docs = [(7 if k % 3 else None, f"text {k} " * (k % 5 + 1)) for k in range(400)] + [(k, "x") for k in range(20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    tf.write(rows, f"file://{tmp_path}/t", shards=12)
    got = sorted((tuple(r) for r in tf.read(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[1])
    assert got == expected(docs, encode)
    sizes = [r.n for r in spark.read.parquet(f"file://{tmp_path}/t/shards").join(spark.read.parquet(f"file://{tmp_path}/t/blocks"), "shard").groupBy("shard").agg({"n_ids": "sum"}).withColumnRenamed("sum(n_ids)", "n").collect()]
    assert len(sizes) > 8 and max(sizes) < sum(sizes) / 4


def test_reading_begins_at_a_checkpoint(encode):
    r = np.random.default_rng(5)
    counts = np.array([1, 700, 256, 3000])
    ids = r.integers(0, 300, counts.sum()).astype(np.uint32)
    lengths = tf.code_lengths(np.bincount(ids, minlength=49_408))
    bits, begin, at = tf.encode(ids, counts, lengths, tf.canonical(lengths))
    first, _ = tf._runs(counts)
    points, cut, ends = at[first], np.cumsum(-(-counts // tf.CHECKPOINT)), np.cumsum(counts)
    docs = [(k, int(n), bits[begin[k] : begin[k + 1]], (points[cut[k] - -(-n // tf.CHECKPOINT) : cut[k]] - 8 * begin[k]).astype("<u4").tobytes()) for k, n in enumerate(counts)]
    block, table = tf.pack_block(docs), tf.decode_table(lengths)
    assert (tf.unpack_block(block, table)[2] == ids).all()
    for k, n in enumerate(counts.tolist()):
        own = ids[ends[k] - n : ends[k]]
        for a, m in ((0, None), (n // 2, None), (n // 2, 10), (n - 1, 5), (255, 2), (n, 1), (0, n)):
            assert (tf.ids_from(block, k, a, table, m) == own[a : None if m is None else a + m]).all()


def test_empty(spark, tmp_path):
    tf.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t")
    assert tf.read(spark, f"file://{tmp_path}/t").count() == 0


def test_whole_table(spark, encode, sf="/root/testdata/sf0.01"):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in tf.op3_token_files(spark, sf).collect())
    assert got == [x[:4] for x in expected(docs, encode)]


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_code_lengths():
    r = np.random.default_rng(1)
    for n in (2, 3, 17, 400):
        counts = r.integers(0, 1000, n)
        lengths = tf.code_lengths(counts)
        used = lengths[lengths > 0].astype(float)
        assert len(used) < 2 or (2.0**-used).sum() == 1
        if len(used) > 1:
            assert int((counts * lengths).sum()) == huffman_cost(counts)  # no limit binds here
    steep = np.array([2**k for k in range(40)])
    lengths = tf.code_lengths(steep)
    assert lengths.max() == tf.LIMIT and (2.0 ** -lengths.astype(float)).sum() == 1


def test_round_trip():
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 20_000), 49_407).astype(np.uint32)
    counts = np.array([1, 255, 256, 257, 0, 5000, 14_231])
    lengths = tf.code_lengths(np.bincount(ids, minlength=49_408))
    bits, begin, at = tf.encode(ids, counts, lengths, tf.canonical(lengths))
    first, run = tf._runs(counts)
    assert (tf.decode(np.frombuffer(bits, np.uint8), at[first], run, tf.decode_table(lengths)) == ids).all()
    middle = slice(5, 9)  # from a checkpoint in the middle
    got = tf.decode(np.frombuffer(bits, np.uint8), at[first[middle]], run[middle], tf.decode_table(lengths))
    assert (got == ids[first[5] : first[5] + run[middle].sum()]).all()
