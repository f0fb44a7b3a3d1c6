"""Token ids in binary shards: length-limited canonical Huffman codes in independent blocks.

Global counts of the ids give code lengths (package-merge, at most LIMIT bits), which fix the canonical
code; the code book is one byte for each id. Documents are coded where they are tokenised, dealt to
shards of about SHARD_IDS ids by ascending doc_id (nulls first; MAX_SHARDS shards at most, which then grow), and joined to
blocks of about BLOCK_IDS ids. A block can be decoded
by itself: it holds its documents' ids and lengths and the bit offset of every CHECKPOINT-th id of each
document, so a decoder steps through all checkpoints at once by table lookups, or starts at any of them.

Files are Parquet shards with one binary block in a row, so Spark's committer leaves no partial block behind
when an executor is lost, and any store that Spark reaches can hold them.

Block, little-endian: b"HUF1", uint32 number of documents, uint64 number of ids, uint32 number of checkpoints;
for each document int64 doc_id, uint8 whether it has one, uint32 number of ids; uint32 bit offset of each
checkpoint; the bits, each document's beginning on a byte. A document has ceil(ids / CHECKPOINT) checkpoints.

Cases: a null or empty text is the end id alone; repeated and null doc_ids are documents of their own, in the
order of their places in the input, and are dealt to several shards where they are many; ids are cast to long; a text of any length is one document, in a block of its own size; extra columns are not looked at;
an empty table gives no blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import drop_stored, fresh_path, stored
from .tokens import VOCABULARY, crc32_of, encoded_groups, tokenizer_path
from .vectors import SCHEMA, summed, vector_rows
from .words import lean

LIMIT = 16
CHECKPOINT = 256
BLOCK_IDS = 1 << 18
SHARD_IDS = 1 << 23
MAX_SHARDS = 1 << 16
MAGIC = b"HUF1"
HEAD = "<4sIQI"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 for what never occurs."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) <= 1:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols need more than {limit} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n = len(order)
    # Each level merges the leaves with the pairs of the level below; made[k] tells which of its items are leaves.
    weights, made = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaf, pairs))
        by = np.argsort(both, kind="stable")
        weights = both[by]
        made.append(by < n)
    # Of the top level the first 2n - 2 items are taken; the pairs among them take twice as many below.
    depth, take = np.zeros(n + 1, np.int64), 2 * n - 2
    for is_leaf in reversed(made):
        leaves = int(is_leaf[:take].sum())
        depth[0] += 1
        depth[leaves] -= 1
        take = 2 * (take - leaves)
    lengths[order] = np.cumsum(depth)[:n]
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: codes ascend by (length, id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint32)
    size = lengths[order].astype(np.int64)
    if len(order):
        # A code begins where the codes before it end on the line of LIMIT-bit words.
        begin = np.concatenate(([0], np.cumsum(1 << (LIMIT - size))))[:-1]
        codes[order] = begin >> (LIMIT - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for each word of LIMIT bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    many = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    ids[: many.sum()] = np.repeat(order, many)
    size[: many.sum()] = np.repeat(lengths[order], many)
    return ids, size


def encode(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bits, byte offset of each document (n + 1), bit offset of every id) of documents of counts ids."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(counts)
    bits = np.concatenate(([0], np.cumsum(size)))
    own = bits[ends] - bits[ends - counts]
    begin = np.concatenate(([0], np.cumsum((own + 7) // 8)))
    at = bits[:-1] + np.repeat(8 * begin[:-1] - bits[ends - counts], counts)
    word = codes[ids].astype(np.int64) << (24 - (at & 7) - size)
    out, byte = np.zeros(begin[-1] + 3), at >> 3
    for k in range(3):
        out += np.bincount(byte + k, (word >> (16 - 8 * k)) & 0xFF, len(out))
    return out[: begin[-1]].astype(np.uint8).tobytes(), begin, at


def decode(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of runs of at most CHECKPOINT ids that begin at bit ``starts``, one run after another."""
    symbol, size = table
    data = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    out = np.empty((len(counts), CHECKPOINT), np.uint16)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))
        pos = at[:n]
        word = (window[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[order[:n], k] = symbol[word]
        at[:n] += size[word]
    return out[np.arange(CHECKPOINT) < counts[:, None]]


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id, number of ids) of each checkpoint's run, documents of counts ids one after another."""
    n = -(-counts // CHECKPOINT)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[owner] + nth * CHECKPOINT
    return first, np.minimum(counts[owner] - nth * CHECKPOINT, CHECKPOINT)


def pack_block(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """docs: doc_id, number of ids, bits, checkpoints (uint32 bit offsets within the document's bits)."""
    table = b"".join(struct.pack("<qBI", i or 0, i is not None, n) for i, n, _, _ in docs)
    points, at = [], 0
    for _, _, bits, own in docs:
        points.append(np.frombuffer(own, "<u4") + np.uint32(8 * at))
        at += len(bits)
    points = np.concatenate(points).astype("<u4")
    head = struct.pack(HEAD, MAGIC, len(docs), sum(n for _, n, _, _ in docs), len(points))
    return b"".join([head, table, points.tobytes(), *(bits for _, _, bits, _ in docs)])


def unpack_block(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, number of ids of each, all ids)."""
    magic, n_docs, n_ids, n_points = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(HEAD)
    docs = np.frombuffer(block, np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")]), n_docs, at)
    at += docs.nbytes
    points = np.frombuffer(block, "<u4", n_points, at).astype(np.int64)
    counts = docs["n"].astype(np.int64)
    ids = decode(np.frombuffer(block, np.uint8, offset=at + 4 * n_points), points, _runs(counts)[1], table)
    if len(ids) != n_ids:
        raise ValueError("a block is damaged")
    return [i if has else None for i, has in zip(docs["id"].tolist(), docs["has"].tolist(), strict=True)], counts, ids


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY)
    for b in batches:
        for x in b.column(0):
            total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=VOCABULARY)
    yield vector_rows(total)


#: A null id's place in the order of ids.
_NULL = -(1 << 63)


def _bounds(tokens: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, place) pairs, ascending, at most n - 1: each shard begins at one. Ids that stand for several shards are split by place."""
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keyed = tokens.select(F.coalesce("id", F.lit(_NULL)).alias("id"), "place")
    found = keyed.select(F.percentile_approx("id", [k / n for k in range(1, n)], 8 * n)).first()[0] or []
    ids, many = np.unique(np.array(found, np.int64), return_counts=True)
    pairs = {(i, -1) for i in ids.tolist()}
    hot = ids[many > 1].tolist()  # fewer than n
    if hot:
        m = int(many.max())
        rows = keyed.where(F.col("id").isin(hot)).groupBy("id").agg(F.percentile_approx("place", [k / (m + 1) for k in range(1, m + 1)], 8 * m).alias("p"))
        pairs |= {(r.id, place) for r in rows.collect() for place in r.p}
    ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return ordered[:, 0], ordered[:, 1]


def _shard(bounds: tuple[np.ndarray, np.ndarray], ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bounds are at or before each (id, place)."""
    low, high = (np.searchsorted(bounds[0], ids, side=s) for s in ("left", "right"))
    split = np.flatnonzero(high - low > 1)
    for k in split[np.unique(ids[split], return_index=True)[1]].tolist():  # ids with bounds of their own, each once
        same = split[ids[split] == ids[k]]
        high[same] = low[k] + np.searchsorted(bounds[1][low[k] : high[k]], places[same], side="right")
    return high


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, shards: int | None = None) -> None:
    """Write path/book (code lengths), path/blocks (shard, block, n_ids, data) and path/shards (shard, start)."""
    spark = docs.sparkSession
    vocabulary = tokenizer or tokenizer_path()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            for rows, ids, counts in encoded_groups(b.column(1), vocabulary):
                ends, small = np.cumsum(counts), ids.astype("<u2")
                yield pa.record_batch(
                    [b.column(0).slice(rows.start, len(counts)), pa.array(place + np.arange(len(counts))), pa.array([small[i:j].tobytes() for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.binary())],
                    ["id", "place", "ids"],
                )
                place += len(counts)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    tokens = stored(rows.mapInArrow(lean(tokenise, "tokens"), "id long, place long, ids binary"), "tokens")
    total = summed(tokens.select("ids").mapInArrow(lean(_count), SCHEMA), VOCABULARY)
    lengths = code_lengths(total)
    codes = canonical(lengths)
    # A small table is spread over the tasks that there are, a block each at least.
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.sum() // BLOCK_IDS))
    n = shards or int(min(MAX_SHARDS, max(1, least, -(-total.sum() // SHARD_IDS))))
    bounds = _bounds(tokens, n)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                own = [np.frombuffer(x.as_buffer(), "<u2") for x in part.column(2)]
                counts = np.array([len(x) for x in own])
                bits, begin, at = encode(np.concatenate(own), counts, lengths, codes)
                first, _ = _runs(counts)
                n_points = -(-counts // CHECKPOINT)
                points = (at[first] - 8 * np.repeat(begin[:-1], n_points)).astype("<u4")
                cut = np.concatenate(([0], np.cumsum(n_points))).tolist()
                ids = part.column(0)
                shard = _shard(bounds, ids.fill_null(_NULL).to_numpy(), part.column(1).to_numpy())
                yield pa.record_batch(
                    [
                        pa.array(shard, pa.int32()),
                        ids,
                        part.column(1),
                        pa.array(counts, pa.int64()),
                        pa.array([bits[x:y] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()),
                        pa.array([points[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    ["shard", "id", "place", "n", "bits", "points"],
                )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard, nth = [], 0, None, 0
        for b in batches:
            for s, i, _, n_ids, bits, points in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s != shard or size + n_ids > BLOCK_IDS):
                    yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_block(held)], pa.binary())], ["shard", "block", "n_ids", "data"])
                    nth = nth + 1 if s == shard else 0
                    held, size = [], 0
                shard = s
                held.append((i, n_ids, bits, points))
                size += n_ids
        if held:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([nth], pa.int32()), pa.array([size], pa.int64()), pa.array([pack_block(held)], pa.binary())], ["shard", "block", "n_ids", "data"])

    coded = tokens.mapInArrow(lean(code), "shard int, id long, place long, n long, bits binary, points binary")
    dealt = coded.repartition("shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "place")
    dealt.mapInArrow(lean(block), "shard int, block int, n_ids long, data binary").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/book")
    drop_stored(tokens)


def ids_from(block: bytes, document: int, at: int, table: tuple[np.ndarray, np.ndarray], n: int | None = None) -> np.ndarray:
    """Ids of one document of a block (its number there) from id ``at`` on, all or n; decoding starts at the checkpoint before."""
    magic, n_docs, _, n_points = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    begin = struct.calcsize(HEAD)
    counts = np.frombuffer(block, np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")]), n_docs, begin)["n"].astype(np.int64)
    begin += 13 * n_docs
    of = -(-counts // CHECKPOINT)
    stop = int(counts[document]) if n is None else min(int(counts[document]), at + n)
    if at >= stop:
        return np.empty(0, np.uint16)
    first, last = at // CHECKPOINT, (stop - 1) // CHECKPOINT
    points = np.frombuffer(block, "<u4", last - first + 1, begin + 4 * (int(of[:document].sum()) + first)).astype(np.int64)
    runs = np.minimum(counts[document] - CHECKPOINT * np.arange(first, last + 1), CHECKPOINT)
    ids = decode(np.frombuffer(block, np.uint8, offset=begin + 4 * n_points), points, runs, table)
    return ids[at - first * CHECKPOINT : stop - first * CHECKPOINT]


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on demand, ids."""
    table = decode_table(np.frombuffer(spark.read.parquet(f"{path}/book").first()[0], np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, nth, data in zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
                docs, counts, flat = unpack_block(data, table)
                ends = np.cumsum(counts)
                cut = [flat[i:j] for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([s] * len(docs), pa.int32()), pa.array([nth] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([crc32_of(x) for x in cut], pa.int64())]
                names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).join(spark.read.parquet(f"{path}/shards"), "shard")
    docs = blocks.select("shard", "block", "data").mapInArrow(lean(run), "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    start = (F.col("start") + F.col("base") + F.col("within")).alias("start")
    return docs.join(bases, ["shard", "block"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, ids=False)
