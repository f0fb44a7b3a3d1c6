"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores all measurements and one failure bit per
rule. ``apply_policy`` is then a bitwise AND with a version's mask, and ``ablation`` counts what each
rule decides alone, over the ledger, without touching the texts again.

Cases: a null or empty text has no words and fails ``too_few_words``; a text of one huge word, repeated
rows and rows with a null doc_id are measured like any other, one ledger row for each input row.
Extra columns pass through ``keep``; nothing is grouped, so ties and hot keys do not matter. Equal lines and windows
are found by hash and compared byte for byte; texts in which two different ones share a hash are measured plainly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import SPACES, U, Words, combine, eights, equal_eights, hash_ranges, lean, mix, word_groups

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_symbol_words", "n_bang_words")
#: Bit by place. Each rule is a SQL condition over the measurements; true fails the document.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words and n_symbols >= 8",
    "symbol_words": "10 * n_symbol_words > n_words and n_symbol_words >= 8",
    "shouting": "2 * n_upper > n_letters and n_letters >= 20",
    "exclaiming": "10 * n_bang_words > n_words and n_bang_words >= 8",
    "repeated_lines": "5 * n_dup_lines > n_lines and n_dup_lines >= 3",
    "long_words": "word_chars > 16 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "too_few_letters": "2 * n_letters < word_chars and n_words > 0",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Policy versions: the rules that reject. base holds the two rules every version has.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
    "lenient": ("too_few_words", "repeated_windows", "symbol_heavy", "shouting"),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True


def policy_mask(policy: str | Sequence[str]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _count_true(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _plain(w: Words, text: int) -> tuple[int, list[bool]]:
    """(lines equal to an earlier one, whether each word lies in a window found twice) of one text, without hashes."""
    raw = w.data[w.offsets[text] : w.offsets[text + 1]].tobytes()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    own = range(int(w.first[text]), int(w.first[text + 1]))
    words = [w.data[w.starts[k] : w.ends[k]].tobytes() for k in own]
    places: dict[tuple[bytes, ...], list[int]] = {}
    for k in range(len(words) - 2):
        places.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = [False] * len(words)
    for at in places.values():
        for k in at if len(at) > 1 else ():
            covered[k : k + 3] = [True] * 3
    return len(lines) - len(set(lines)), covered


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of whole texts."""
    out: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
    for w in word_groups(texts, SPACES, lower=False):
        n, counts, text_of = len(w.counts), w.counts, w.text_of
        lead = (w.data & 0xC0) != 0x80
        symbol = _SYMBOL[w.data]
        # Lines: ranges between newlines and text ends; equal lines have equal hashes.
        line_starts = np.unique(np.concatenate((w.offsets[:-1], np.flatnonzero(w.data == 10) + 1)))
        line_starts = line_starts[line_starts < len(w.data)] if len(w.data) else line_starts[:0]
        line_ends = np.append(line_starts[1:], len(w.data))[: len(line_starts)]
        trimmed = line_ends - ((line_ends > line_starts) & (w.data[np.maximum(line_ends - 1, 0)] == 10)) if len(line_starts) else line_ends
        worded = np.searchsorted(w.starts, line_starts) < np.searchsorted(w.starts, trimmed)
        line_starts, trimmed = line_starts[worded], trimmed[worded]
        line_text = np.searchsorted(w.offsets, line_starts, side="right") - 1
        view, unsure = eights(w.data), [np.empty(0, np.int64)]
        keys = mix(hash_ranges(w.data, line_starts, trimmed) + line_text.astype(U) * U(0x9E3779B97F4A7C15))
        by = np.argsort(keys, kind="stable")
        again = np.flatnonzero(keys[by][1:] == keys[by][:-1])
        x, y = by[again], by[again + 1]
        size = trimmed - line_starts
        agree = (line_text[x] == line_text[y]) & (size[x] == size[y])
        agree &= equal_eights(view, line_starts[x], view, line_starts[y], np.where(agree, size[x], 0))
        unsure += [line_text[x[~agree]], line_text[y[~agree]]]
        lines = np.bincount(line_text, minlength=n)
        dup_lines = np.bincount(line_text[y], minlength=n)
        # 3-word windows that occur twice or more in their text, and the words they cover.
        covered = np.zeros(len(w.starts) + 1, np.int64)
        windows = combine(w.hashes(), 3)
        within = np.flatnonzero(text_of[:-2] == text_of[2:]) if len(text_of) > 2 else np.empty(0, np.int64)
        if len(within):
            keys = mix(windows[within] + text_of[within].astype(U) * U(0x9E3779B97F4A7C15))
            by = np.argsort(keys)
            again = np.flatnonzero(keys[by][1:] == keys[by][:-1])
            x, y = within[by[again]], within[by[again + 1]]
            agree, size = text_of[x] == text_of[y], w.ends - w.starts
            for k in range(3):
                agree &= size[x + k] == size[y + k]
                agree &= equal_eights(view, w.starts[x + k], view, w.starts[y + k], np.where(agree, size[x + k], 0))
            unsure += [text_of[x[~agree]], text_of[y[~agree]]]
            hit = np.unique(np.concatenate((x, y)))
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + 3, -1)
        repeated = np.cumsum(covered)[:-1] > 0
        for text in np.unique(np.concatenate(unsure)).tolist():
            dup_lines[text], repeated[w.first[text] : w.first[text + 1]] = _plain(w, text)
        symbols_before = np.concatenate(([0], np.cumsum(symbol, dtype=np.int64)))
        last = w.data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
        for name, x in {
            "n_words": counts,
            "word_chars": w.sums(lead & ~SPACES[w.data]),
            "n_symbols": w.sums(symbol),
            "n_dup_lines": dup_lines,
            "n_repeat_words": _count_true(repeated, w.first),
            "n_upper": w.sums(_UPPER[w.data]),
            "n_letters": w.sums(_LETTER[w.data]),
            "n_lines": lines,
            "n_symbol_words": _count_true(symbols_before[w.ends] > symbols_before[w.starts], w.first),
            "n_bang_words": _count_true(last == 0x21, w.first),
        }.items():
            out[name].append(x.astype(np.int64))
    return {m: np.concatenate(x) if x else np.empty(0, np.int64) for m, x in out.items()}


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, every measurement, and ``failures`` (a long with one bit for each failed rule)."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(b.num_columns - 1))
            yield pa.record_batch([*b.columns[:-1], *(pa.array(m[x], pa.int64()) for x in MEASURES)], [*(f"k{i}" for i in range(len(keep))), *MEASURES])

    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)), *(f"{m} long" for m in MEASURES)])
    measured = inner.mapInArrow(lean(run), schema)
    bits: Column = F.lit(0).cast("long")
    for name, condition in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, bits.alias("failures"))


def apply_policy(rows: DataFrame, policy: str | Sequence[str], kept: str = "kept") -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn(kept, F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str | Sequence[str]) -> DataFrame:
    """One row for each rule of the policy: how many documents it fails, and how many only it rejects."""
    mask = policy_mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    under = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.struct(F.lit(r).alias("rule"), F.count_if(under.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias("failed"), F.count_if(under == BIT[r]).alias("failed_alone")) for r in names]
    return rows.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v1")
    base = F.col("failures").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps, with all their columns, whatever these are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = ledger(docs.toDF(*names), names[docs.columns.index("text")], names)
    return apply_policy(rows, "v1").where("kept").select(*names).toDF(*docs.columns)
