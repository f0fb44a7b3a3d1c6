import zlib

import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import quality_model as qm


def test_held_out_accuracy(spark, sf="/root/testdata/sf0.1"):
    rows = qm.op2_quality_model(spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.count() == docs.count()
    some = rows.limit(200).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in some)
    held = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = {r.quality: r for r in held.groupBy("quality").agg(F.avg("predicted").alias("p"), F.avg("score").alias("s")).collect()}
    assert got[1].p > 0.98 and got[0].p < 0.05
    assert abs(held.agg(F.avg(F.col("score") - F.col("quality"))).first()[0]) < 0.02  # calibrated


def test_contexts_equal_brute_force():
    import pyarrow as pa

    texts = ["A b a!! c\nb", None, "", "a b", "x1 Ünd ... x1 x1"]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    got = np.zeros(-(-qm.UNITS * (qm.DIMS + 1) // 4096) * 4096)
    for b in qm._contexts(iter([batch])):
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[part * 4096 : part * 4096 + len(cells) // 8] += np.frombuffer(cells)
    dims, signs = qm._index(np.arange(qm.UNITS))
    want, n = np.zeros((qm.UNITS, qm.DIMS)), np.zeros(qm.UNITS)
    for t in texts:
        for w in qm.groups(pa.array([t], pa.string())):
            units = list(zip(*qm._units(qm.segment(w[1], w[2], qm.SPACES, w[0])), strict=True))
            for i, mine in enumerate(units):
                for u in mine:
                    n[u] += 1
                    for j in (i - 1, i + 1):
                        for v in units[j] if 0 <= j < len(units) else ():
                            for dim, sign in zip(dims[v], signs[v]):
                                want[u, dim] += sign
    assert np.allclose(got[: qm.UNITS * qm.DIMS], want.ravel()) and np.allclose(got[qm.UNITS * qm.DIMS : qm.UNITS * (qm.DIMS + 1)], n)


def plain_scores(docs, labels):
    """The whole query without batches or Spark: loops over words, dictionaries of units, one row at a time."""
    dims, signs = qm._index(np.arange(qm.UNITS))
    index = np.zeros((qm.UNITS, qm.DIMS))
    for u in range(qm.UNITS):
        for dim, sign in zip(dims[u], signs[u]):
            index[u, dim] += sign
    texts = []
    for _, t in docs:
        (_, data, offsets), = qm.groups(qm.pa.array([t], qm.pa.string()))
        texts.append(list(zip(*(x.tolist() for x in qm._units(qm.segment(data, offsets, qm.SPACES, slice(0, 1)))), strict=True)))
    context, n = {}, {}
    for words in texts:
        for i, units in enumerate(words):
            around = sum((index[v] for j in (i - 1, i + 1) if 0 <= j < len(words) for v in words[j]), np.zeros(qm.DIMS))
            for u in units:
                context[u] = context.get(u, 0) + around
                n[u] = n.get(u, 0) + 1
    vectors = {}
    for low, high in ((0, qm.FORMS), (qm.FORMS, qm.FORMS + qm.SHAPES), (qm.FORMS + qm.SHAPES, qm.UNITS)):
        own = [u for u in n if low <= u < high]
        total = sum(n[u] for u in own)
        common = sum(context[u] for u in own) / total
        for u in own:
            c = context[u] - n[u] * common
            norm = np.sqrt(c @ c)
            vectors[u] = (c / norm if norm > 1e-9 else 0 * c) * (1e-3 / (1e-3 + n[u] / total) if low == 0 else 1)
    x = np.zeros((len(docs), qm.FEATURES))
    for row, words in zip(x, texts):
        for k in range(3):
            if words:
                row[k * qm.DIMS : (k + 1) * qm.DIMS] = sum(vectors[w[k]] for w in words) / len(words)
        row[-1] = np.log1p(len(words)) / 10
    learnt = sorted((i, y, k) for k, (i, _) in enumerate(docs) for j, y in labels if i == j and zlib.crc32(str(i).encode()) % 5)
    net = qm.fit(x[[k for _, _, k in learnt]], np.array([float(y) for _, y, _ in learnt]))
    return [(i, zlib.crc32(str(i).encode()) % 5 == 0, s) for (i, _), s in zip(docs, net.scores(x).tolist())]


def test_query_equals_a_plain_version(spark, tmp_path):
    r = np.random.default_rng(3)
    prose, junk = "the of and with for river house green walks over old stone bridge they say".split(), "BUY!! *** $$$ $9.99 %%% now!! ### CLICK x1x1 <b> &&&".split()
    docs = [(k, " ".join(r.choice(junk if k % 3 == 0 else prose, int(r.integers(3, 60))))) for k in range(150)] + [(200, ""), (201, "one")]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 150, 2)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in qm.op2_quality_model(spark, str(tmp_path)).collect()}
    want = plain_scores(docs, labels)
    assert len(got) == len(want)
    for i, held_out, score in want:
        assert got[i].held_out == held_out and abs(got[i].score - score) < 1e-3 and (got[i].predicted == int(score >= 0.3) or abs(score - 0.3) < 1e-3)


DOCS = [(1, "a b c d"), (2, None), (3, ""), (None, "a b"), (3, "word " * 20_000), (4, "a b c d"), (4, "a b c d")]


def test_edge_rows_and_one_kind_of_label(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    got = qm.classify(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert qm.classify(docs.limit(0), labels).count() == 0
    assert qm.classify(docs, labels.limit(0)).count() == len(DOCS)


def test_sample_bound(spark):
    made = spark.createDataFrame([(i, bytearray(np.full(qm.FEATURES, i % 2, np.float32).tobytes())) for i in range(500)], "id long, features binary")
    labels = made.select("id", (F.col("id") % 2).alias("label"))
    net = qm.learn(made, labels, F.lit(True), 100)
    assert net.scores(np.ones((1, qm.FEATURES)))[0] > 0.9 > 0.1 > net.scores(np.zeros((1, qm.FEATURES)))[0]
