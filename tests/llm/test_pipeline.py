import re

import pyarrow as pa
import test_decontaminate
import test_near_dedup
import test_packing
import test_quality_rules
from test_packing import encode  # noqa: F401

import corpus_pipeline
from textwarden.llm import personal_data, quality_rules
from textwarden.llm.store import stored

SF = "/root/testdata/sf0.001"


def rejected(text):
    """The rules of policy v1, plainly."""
    n, chars, symbols, dup, repeat = test_quality_rules.brute(text)
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    odd, bang = sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words), sum(w.endswith("!") for w in words)
    data = text.encode()
    upper, letters = len(re.findall(rb"[A-Z]", data)), len(re.findall(rb"[A-Za-z\xC0-\xFF]", data))
    return any(
        [n < 50, 100 * repeat > 50 * n, 10 * symbols > n and symbols >= 8, 10 * odd > n and odd >= 8, 2 * upper > letters and letters >= 20]
        + [10 * bang > n and bang >= 8, 5 * dup > len(lines) and dup >= 3, chars > 16 * n, chars < 2 * n, 2 * letters < chars and n > 0]
    )


def test_stages_equal_plain_versions(spark, encode):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id: r.text for r in docs.collect()}
    plain = [
        lambda d: {i: t for i, t in d.items() if not rejected(t)},
        lambda d: {i: t for i, t in d.items() if test_near_dedup.brute(list(d.items()), 5)[i][1] == i},
        lambda d: {r[0]: d[r[0]] for r in test_decontaminate.brute(list(d.items()), items) if not r[-1]},
        lambda d: {i: personal_data.redacted(t, personal_data.find(pa.array([t]), personal_data.trained())[0]) for i, t in d.items()},
    ]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "personal_data", "packing"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        columns = docs.columns
        docs, want = stored(stage(spark, docs, SF), name), brute(want)
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == want and want
    assert docs.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    used, least = test_packing.check(last, want, encode)
    assert used <= least + 1
    ran = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()
    assert sorted(map(tuple, ran)) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in last)


def test_empty_and_null_rows_go_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    text = " ".join(f"word{i}" for i in range(90))
    odd = spark.createDataFrame([(None, text, None, None, None), (1, None, None, None, None), (2, text, None, None, None), (2, text, None, None, None)], docs.schema)
    odd.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == [2, 2, None]
    assert set(quality_rules.POLICIES["base"]) <= set(quality_rules.POLICIES["v1"])
