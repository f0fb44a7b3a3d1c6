import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from colliding import thue_morse
from pyspark.sql import functions as F

from textwarden.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failures string, n_words string"


def brute(text):
    x = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x y\nx y\n\nx y\n", "ü#|é \x0b日本 <b>\n" * 40, "wörd " * 3000, "one two three four\nfive" * 17, "A" * 100_000, "a b c d e f g " * 2 + "z", "\na\n a\na"]


def test_measures_equal_brute_force(spark, sf="/root/testdata/sf0.01"):
    rows = [(i, t, "en", None, 1, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None, None, None, None)] * 2
    got = q.ledger(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        assert tuple(by[i][m] for m in q.MEASURES[:5]) == brute(t), t
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in q.op5_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_stage_passes_columns_of_any_name_and_empty_tables(spark):
    rows = [(i, t, "en", None, 1, "x", "y") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, (99, " ".join(f"word{i}" for i in range(80)), "en", "s", 1, "f", "w")], SCHEMA)
    out = q.quality_rules_stage(spark, docs, "")
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [99]
    assert q.quality_rules_stage(spark, docs.limit(0), "").count() == 0


def test_policies_and_ablation(spark, sf="/root/testdata/sf0.01"):
    rows = q.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = {p: q.apply_policy(rows, p).where("kept").count() for p in q.POLICIES}
    assert kept["base"] >= kept["lenient"] >= kept["v1"] > 0
    ablated = {r.rule: r for r in q.ablation(rows, "v1").collect()}
    assert ablated["too_few_words"].failed == rows.where("n_words < 50").count()
    without = q.apply_policy(rows, [r for r in q.RULES if r != "too_few_words"]).where("kept").count()
    assert without - kept["v1"] == ablated["too_few_words"].failed_alone


def test_good_documents_stay(spark, sf="/root/testdata/sf0.1"):
    rows = q.op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = rows.where("quality = 1 and not base_failed")
    assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.99
    assert rows.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.1


@pytest.mark.parametrize("spoiled", [False, True])
def test_colliding_lines_and_windows(monkeypatch, spoiled):
    """Equal hashes alone make no equal lines or windows, even where all words and lines have one hash."""
    if spoiled:
        same = lambda data, starts, ends: np.full(len(starts), 7, np.uint64)
        monkeypatch.setattr(q, "hash_ranges", same)
        monkeypatch.setattr("textwarden.llm.words.hash_ranges", same)
    a, b = thue_morse()
    texts = [f"{a}\n{b}", f"{a} x y {b} x y {a} x z", *(t for t in TEXTS if t is None or len(t) < 2000), f"{a}\n{a}\n{b}\n{b}"]
    got = q.measure(pa.array(texts))
    assert [tuple(int(got[m][i]) for m in q.MEASURES[:5]) for i in range(len(texts))] == [brute(t) for t in texts]
