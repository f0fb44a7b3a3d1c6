"""Packing token pieces into sequences of bounded length by minimum bin slack.

Lengths take at most ``capacity`` values, so the whole corpus is planned from its length histogram: per
bin, a bitset subset-sum over the lengths that are left (with their counts) finds the fullest feasible
combination beside the longest piece, which is removed as often as the counts allow. The plan's size
depends on the capacity and not on the corpus. Pieces find their place by their rank among those of
equal length: they are dealt by ranges of (length, task that made them, number there), so that a length that a third of all
pieces have is spread over many partitions, and are numbered within their partition; the counts of each length in
each partition, at most as many as partitions and lengths together, tell what lies before.

Cases: a null or empty text is one piece holding the end id alone; repeated rows and rows without an id
are documents of their own; a text of more than ``capacity`` ids is cut into full pieces and a rest; ties of
length are ranked by place; extra columns are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_stored, stored
from .tokens import crc32_of, encoded_groups, tokenizer_path
from .words import lean

CAPACITY = 4096


@dataclass(frozen=True)
class Step:
    times: int  # bins filled in this way
    parts: tuple[tuple[int, int], ...]  # (length, how many in each bin), longest first


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of lengths (at most as many of each as counts has) with the largest sum up to room."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before, more = reach, reach
        for _ in range(min(counts[length], room // length)):
            more = (more << length) & mask
            new = reach | more
            if new == reach:
                break
            reach = new
        steps.append((length, before))
        if reach & full:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            out.append((length, n))
    return out[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    left, steps = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = dict(fullest({k: n for k, n in left.items() if n}, capacity - longest))
        left[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(left[k] // n for k, n in rest.items())
        for k, n in rest.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        steps.append(Step(times, tuple(sorted(rest.items(), reverse=True))))
    return steps


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Stored rows: id, piece, start, length, ids (little-endian uint16; on demand), ids_crc32, task, local_rank (among the task's pieces of that length)."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for rows, ids, counts in encoded_groups(b.column(1), path):
                n = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[owner] - start, capacity)
                begin = (np.cumsum(counts) - counts)[owner] + start
                by = np.argsort(length, kind="stable")
                rank = np.empty(len(by), np.int64)
                values, first, many = np.unique(length[by], return_index=True, return_counts=True)
                rank[by] = np.arange(len(by)) - np.repeat(first, many) + np.repeat(seen[values], many)
                seen[values] += many
                small = ids.astype("<u2") if with_ids else None
                cut = [(i, i + k) for i, k in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        b.column(0).slice(rows.start, len(counts)).take(pa.array(owner)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        *([pa.array([small[i:j].tobytes() for i, j in cut], pa.binary())] if with_ids else []),
                        pa.array([crc32_of(ids[i:j]) for i, j in cut], pa.int64()),
                        pa.array(np.full(len(owner), task), pa.int32()),
                        pa.array(rank, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", *["ids"] * with_ids, "ids_crc32", "task", "local_rank"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return stored(rows.mapInArrow(lean(run, "tokens"), f"id long, piece int, start long, length long, {'ids binary, ' * with_ids}ids_crc32 long, task int, local_rank long"), "pieces")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of the ranks."""
    order, columns = ["length", "task", "local_rank"], [c for c in made.columns if c not in ("task", "local_rank")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            values, first, many = np.unique(b.column(b.schema.get_field_index("length")).to_numpy(), return_index=True, return_counts=True)
            nth = np.arange(b.num_rows) + np.repeat(seen[values] - first, many)  # the lengths ascend
            seen[values] += many
            yield pa.record_batch([*b.columns[:-2], pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(nth)], [*b.schema.names[:-2], "part", "nth"])

    dealt = made.select(*columns, "task", "local_rank").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*columns).schema), "part int, nth long"])
    ordered = stored(dealt.mapInArrow(lean(number), schema), "ordered")
    # At most as many rows as partitions and lengths together: a partition holds a run of the ordered lengths.
    counts = np.array([tuple(r) for r in ordered.groupBy("length", "part").count().collect()], np.int64).reshape(-1, 3)
    counts = counts[np.lexsort((counts[:, 1], counts[:, 0]))]
    firsts, sums = np.unique(counts[:, 0], return_index=True)[1], np.cumsum(counts[:, 2]) - counts[:, 2]
    base = sums - np.repeat(sums[firsts], np.diff(np.append(firsts, len(counts))))
    base_keys = (counts[:, 0] << 32) | counts[:, 1]
    histogram = {k: int(n) for k, n in enumerate(np.bincount(counts[:, 0], counts[:, 2])) if n}
    # Places: for each length, ranks from lo on lie in bins from seq on, so many to a bin, from offset on.
    length, lo, seq, many, offset, used, bins = [], [], [], [], [], {}, 0
    for s in plan(histogram, capacity):
        at = 0
        for k, n in s.parts:
            length.append(k)
            lo.append(used.get(k, 0))
            seq.append(bins)
            many.append(n)
            offset.append(at)
            used[k] = used.get(k, 0) + n * s.times
            at += k * n
        bins += s.times
    places = np.array([length, lo, seq, many, offset], np.int64).reshape(5, -1)
    places = places[:, np.lexsort(places[1::-1])]
    shift = 44
    keys = (places[0] << shift) | places[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, part, nth = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "part", "nth"))
            rank = base[np.searchsorted(base_keys, (size << 32) | part)] + nth
            i = np.searchsorted(keys, (size << shift) | rank, side="right") - 1
            within = rank - places[1, i]
            yield pa.record_batch(
                [*b.columns[:-2], pa.array(places[2, i] + within // places[3, i]), pa.array(places[4, i] + within % places[3, i] * size)],
                [*columns, "sequence_id", "offset"],
            )

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*columns).schema), "sequence_id long", "offset long"])
    return ordered.mapInArrow(lean(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: sequence_id, n_ids, ids (little-endian uint16), pieces in order. A sequence is at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", "n_ids", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text)."""
    made = pieces(docs, with_ids=False)
    out = pack(made).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    drop_stored(made)
    return out


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places, as :func:`placed` gives them; null and empty texts are one piece holding the end id."""
    return placed(docs)
