"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Texts are lower-cased (A-Z) and taken as words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. The automaton (:mod:`.automaton`)
holds every window of ``window`` consecutive words of every benchmark column (questions, answers); an item
column with fewer words, but not none, is one window. Each document is scanned once, whole; hits are kept as the merged
ranges of words that windows cover, with their code points in the original text, and as the items they come from, so
a text of any length that items share any number of windows with stays small.

The automaton is sent to the executors, so its size is bounded: it takes about 45 bytes a state and at most ``window`` states a
benchmark word, 75 bytes for each byte of benchmark text. A benchmark of more than MAX_STATES states (360 MB) is split by
items into several automata; the documents are still read once, and each task passes what it holds (HOLD_BYTES of
texts) through one automaton after another, of which it keeps one.

Cases: a null or empty document has no words and is clean; a null or wordless item has no window; repeated
items count once; items that share a window all count; an item without an id counts as "null"; extra columns
are kept where ``keep`` names them; empty tables give results without hits. Words are looked up by hash, and what a hit
covers is compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton
from .tokens import HashTable
from .words import LOWER, NOT_ALNUM, eights, equal_eights, groups, hash_ranges, lean, segment, string_bytes

WINDOW = 10
MAX_STATES = 8_000_000
HOLD_BYTES = 64 << 20

RANGES = "array<struct<first_word:int,n_words:int,start:int,end:int>>"
_RANGE = pa.struct([(x, pa.int32()) for x in ("first_word", "n_words", "start", "end")])


@dataclass
class Part:
    """Items' windows as an automaton over the words they hold."""

    automaton: Automaton
    words: HashTable  # hash of a word to its number
    text: np.ndarray  # the words' bytes, eight more behind
    start: np.ndarray
    size: np.ndarray
    sets: np.ndarray  # of each state: the items of the pattern that ends there, -1 for none
    set_first: np.ndarray  # of each set its first place in set_items, and one more
    set_items: np.ndarray


def _words(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    w = segment(data, np.array([0, len(data)]), NOT_ALNUM, slice(0, 1))
    raw = data.tobytes()
    return [raw[i:j] for i, j in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _part(texts: list[tuple[int, list[bytes]]], window: int) -> Part:
    """texts: item number and words, at least one."""
    known: dict[bytes, int] = {}
    windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for item, words in texts:
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        n = min(window, len(ids))
        found = np.lib.stride_tricks.sliding_window_view(ids, n)
        windows.setdefault(n, []).append((found, np.full(len(found), item)))
    patterns = [np.concatenate([x for x, _ in w]) for w in windows.values()]
    items = np.concatenate([x for w in windows.values() for _, x in w])
    made = Automaton(patterns, len(known))
    size = np.array([len(w) for w in known])
    text = np.frombuffer(b"".join(known) + bytes(8), np.uint8)
    start = np.cumsum(size) - size
    hashes = hash_ranges(text, start, start + size)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two words of the benchmark have one hash")
    table = HashTable(max(4, (2 * len(known)).bit_length()))
    table.add(hashes)
    # Patterns of the same items share one set.
    order = np.lexsort((items, made.ends))
    ends, items = made.ends[order], items[order]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (items[1:] != items[:-1])
    ends, items = ends[new], items[new]
    states, first = np.unique(ends, return_index=True)
    numbers: dict[bytes, int] = {}
    cut = [*first.tolist(), len(ends)]
    sets = np.full(made.n, -1, np.int32)
    sets[states] = [numbers.setdefault(items[i:j].tobytes(), len(numbers)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    lists = [np.frombuffer(x, items.dtype) for x in numbers]
    return Part(made, table, text, start, size, sets, np.concatenate(([0], np.cumsum([len(x) for x in lists]))), np.concatenate(lists))


def _parts(benchmark: DataFrame, item: str, texts: Sequence[str], window: int) -> tuple[list[str], Iterator[Part]]:
    """(item ids ascending as strings, parts of at most MAX_STATES states or one text)."""
    name = F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null"))
    rows = [(row[0], _words(text.encode())) for row in benchmark.select(name, *[F.col(f"`{t}`") for t in texts]).toLocalIterator() for text in row[1:] if text]
    rows = [(name, words) for name, words in rows if words]
    names = sorted({name for name, _ in rows})
    number = {name: k for k, name in enumerate(names)}

    def parts() -> Iterator[Part]:
        held, states = [], 0
        for name, words in rows:
            n = len(words) * min(window, len(words))
            if held and states + n > MAX_STATES:
                yield _part(held, window)
                held, states = [], 0
            held.append((number[name], words))
            states += n
        if held:
            yield _part(held, window)

    return names, parts()


@dataclass
class Found:
    """Of one run of texts: what is covered, and which items it comes from."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray  # of the words
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    covered: np.ndarray  # of each word
    pairs: list[np.ndarray]  # text * items + item

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _look(x: Found, part: Part, n_items: int) -> None:
    """Add one part's hits."""
    made, text_of = part.automaton, x.text_of
    ids = part.words.get(x.hashes).astype(np.int64)
    at = np.arange(len(ids)) + text_of
    view = eights(x.data)
    while True:
        stream = np.full(len(ids) + len(x.first) - 1, -1, np.int64)
        stream[at] = ids
        out = made.scan(stream)[at]
        hit = np.flatnonzero(out)
        if not len(hit):
            return
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, hit - made.size[out[hit]] + 1, 1)
        np.add.at(change, hit + 1, -1)
        covered = np.cumsum(change)[:-1] > 0
        # Words that only share a hash with one of the benchmark's are none of its words.
        words = np.flatnonzero(covered)
        size = (x.ends - x.starts)[words]
        same = size == part.size[ids[words]]
        held = np.ndarray(len(part.text) - 7, "<u8", part.text, strides=(1,))
        same &= equal_eights(view, x.starts[words], held, part.start[ids[words]], np.where(same, size, 0))
        if same.all():
            break
        ids[words[~same]] = -1
    x.covered |= covered
    # Each text's distinct patterns, then the shorter ones that end with them, then the sets of their items.
    n, pairs, sets = np.int64(made.n), np.unique(text_of[hit] * np.int64(made.n) + out[hit]), []
    while len(pairs):
        sets.append(pairs // n * len(part.set_first) + part.sets[pairs % n])
        shorter = made.shorter[pairs % n]
        pairs = np.unique((pairs // n * n + shorter)[shorter > 0])
    sets = np.unique(np.concatenate(sets))
    text, which = sets // len(part.set_first), sets % len(part.set_first)
    many = part.set_first[which + 1] - part.set_first[which]
    place = np.arange(many.sum()) + np.repeat(part.set_first[which] - (np.cumsum(many) - many), many)
    x.pairs.append(np.unique(np.repeat(text, many) * n_items + part.set_items[place]))


def _columns(runs: list[Found], names: pa.Array) -> list[pa.Array]:
    """n_words, ranges and items of the texts of all runs."""
    counts, many, ranges, many_items, items = [], [], [], [], []
    for x in runs:
        n = len(x.first) - 1
        counts.append(np.diff(x.first))
        text_of, inside = x.text_of, x.covered
        head, tail = np.ones(len(inside), bool), np.ones(len(inside), bool)
        head[1:] = (text_of[1:] != text_of[:-1]) | ~inside[:-1]
        tail[:-1] = (text_of[1:] != text_of[:-1]) | ~inside[1:]
        a, b = np.flatnonzero(inside & head), np.flatnonzero(inside & tail)
        own = text_of[a]
        points = np.concatenate(([0], np.cumsum((x.data & 0xC0) != 0x80))) if len(a) else np.zeros(len(x.data) + 1, np.int64)
        base = points[x.offsets[own]]
        ranges.append(np.stack([a - x.first[own], b - a + 1, points[x.starts[a]] - base, points[x.ends[b]] - base]))
        many.append(np.bincount(own, minlength=n))
        pairs = np.unique(np.concatenate([np.empty(0, np.int64), *x.pairs]))
        many_items.append(np.bincount(pairs // max(1, len(names)), minlength=n))
        items.append(pairs % max(1, len(names)))
    offsets = lambda x: pa.array(np.concatenate(([0], np.cumsum(np.concatenate([np.empty(0, np.int64), *x])))).astype(np.int32))
    fields = np.concatenate([np.empty((4, 0), np.int64), *ranges], axis=1)
    return [
        pa.array(np.concatenate([np.empty(0, np.int64), *counts]), pa.int64()),
        pa.ListArray.from_arrays(offsets(many), pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in fields], fields=list(_RANGE))),
        pa.ListArray.from_arrays(offsets(many_items), names.take(pa.array(np.concatenate([np.empty(0, np.int64), *items])))),
    ]


def _scan(parts: list[Broadcast], names: list[str], text_at: int):
    def begun(b: pa.RecordBatch) -> list[Found]:
        out = []
        for rows, data, offsets in groups(b.column(text_at)):
            w = segment(LOWER[data], offsets, NOT_ALNUM, rows)
            out.append(Found(data, offsets, w.starts, w.ends, w.first, w.hashes(), np.zeros(len(w.starts), bool), []))
            out[-1].data = w.data
        return out

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        some, size = [], 0
        for b in batches:
            some.append(b)
            size += string_bytes(b.column(text_at))[1][-1]
            if len(parts) < 2 or size > HOLD_BYTES:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_names = pa.array(names, pa.string())
        for some in held(batches):
            found = [begun(b) for b in some]
            for p in parts:
                part = p.value
                for x in (x for runs in found for x in runs):
                    if len(x.starts):
                        _look(x, part, len(names))
                if len(parts) > 1:  # one at a time; the next ``value`` reads it again
                    del part
                    vars(p).pop("_value", None)
            for b, runs in zip(some, found, strict=True):
                yield pa.record_batch([*b.columns, *_columns(runs, all_names)], [*b.schema.names, "n_words", "ranges", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), item: str = "item_id", texts: Sequence[str] = ("text",), window: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_words, ranges (first_word, n_words, start and end in code points; merged, ascending) and items (ascending as strings)."""
    names = [f"k{i}" for i in range(len(keep) + 1)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias(names[-1]))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "n_words long", f"ranges {RANGES}", "items array<string>"])
    items, parts = _parts(benchmark, item, texts, window)
    sent = [docs.sparkSession.sparkContext.broadcast(p) for p in parts]
    rows = rows.mapInArrow(lean(_scan(sent, items, len(keep))), schema)
    return rows.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "ranges", "items")


def summary(rows: DataFrame) -> DataFrame:
    """Adds n_hit (words inside any window), item_ids and contaminated; drops ranges and items."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["n_words"])
    return rows.withColumn("n_hit", n_hit).withColumnRenamed("items", "item_ids").withColumn("contaminated", F.size("ranges") > 0).drop("ranges")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.col("item_ids")
    return summary(rows).select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = contamination(docs.toDF(*names), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names[docs.columns.index("text")], names)
    return rows.where(F.size("ranges") == 0).select(*names).toDF(*docs.columns)
