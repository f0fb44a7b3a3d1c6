"""MinHash near-dedup with sequential Bayesian verification.

Texts are sets of distinct word shingles (64-bit hashes). Documents of equal sets collapse to their
smallest id first, so thousands of copies cost one row. The rest is banded; in each bucket all members
are compared with its most central member, the hub. Members of one hub's buckets that this leaves in
different components are compared with each other, on longer signatures and in blocks; pairs are not made into rows before they pass. A candidate pair is compared one batch of signature
values at a time and given up as soon as the posterior probability of a similarity at or over the
threshold falls below ``miss``; survivors are verified exactly on their full shingle sets, by their words' bytes.
In groups of over ``block`` members the second pass compares those that agree on a longer band.

Cases: null and empty texts have no set and link with nothing; texts shorter than a shingle are one shingle
of all their words; rows with a null id are returned as they are, with no component of their own
(component_id null, kept true); repeated rows with one id are one document in the linking and each
returned (if their texts differ, each joins the copies of its own text, and near links are those of the
least by size and fingerprint); extra columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, drop_stored
from .words import SPACES, U, Words, combine, equal_ranges, lean, mix, word_groups


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    percent: int = 80  # documents are linked if 100 * intersection >= percent * union
    bands: int = 24
    rows: int = 4
    batch: int = 16  # signature values compared at a time
    miss: float = 1e-5  # posterior probability at which a pair is given up
    long: int = 1024  # signature values in the second pass
    long_bands: int = 64  # bands of these, of twice as many rows, that group members of large groups again
    block: int = 256  # members compared at once in the second pass

    @property
    def size(self) -> int:
        return self.bands * self.rows


def _binomial(n: int, p: float) -> np.ndarray:
    """P(Binomial(n, p) = k) for k from 0 to n."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    k = np.arange(n + 1)
    return np.exp(logs[n] - logs - logs[::-1] + k * math.log(p) + (n - k) * math.log(1 - p))


def least_matches(spec: NearDedup, size: int) -> list[tuple[int, int]]:
    """(values compared, matches a pair must have by then to go on).

    With a uniform prior the similarity after m of n matches has the posterior Beta(m + 1, n - m + 1), whose
    mass over t is P(Binomial(n + 1, t) <= m).
    """
    t, out = min(max(spec.percent / 100, 1e-9), 1 - 1e-9), []
    for n in range(spec.batch, size + 1, spec.batch):
        out.append((n, int(np.argmax(np.cumsum(_binomial(n + 1, t)) >= spec.miss))))
    return out


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    hashes = w.hashes()
    windows = combine(hashes, k)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if j - i >= k:
            out.append(np.unique(windows[i : j - k + 1]))
        else:
            out.append(combine(hashes[i:j], j - i) if j > i else np.empty(0, U))
    return out


def _seeds(n: int) -> np.ndarray:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0xD6E8FEB86659FD93)).reshape(n, 2)
    return x | np.array([1, 0], U)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(sets, size) uint16, the low halves of minima; sets must not be empty. Longer ones begin like shorter ones."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((len(sets), size), np.uint16)
    for k, (a, b) in enumerate(_seeds(size)):
        out[:, k] = np.minimum.reduceat(((flat * a) + b) >> U(32), at).astype(np.uint16)
    return out


def _sketch(spec: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_groups(b.column(1), SPACES):
                sets = shingle_sets(w, spec.shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = dict(zip(full, signatures([sets[i] for i in full], spec.size), strict=True)) if full else {}
                yield pa.record_batch(
                    [
                        b.column(0).slice(w.rows.start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([np.bitwise_xor.reduce(mix(s + U(7))).astype(np.int64) if len(s) else None for s in sets], pa.int64()),
                        pa.array([sig[i].tobytes() if i in sig else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["id", "n", "f1", "f2", "sig"],
                )

    return run


def _sketches(texts: DataFrame, spec: NearDedup) -> DataFrame:
    """(id, sig): long signatures of texts (id, f1, text), one for each id, of the row whose set f1 names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1 = b.column(1).to_numpy()
            for w in word_groups(b.column(2), SPACES):
                sets = shingle_sets(w, spec.shingle)
                meant = [i for i, s in enumerate(sets) if len(s) and _fingerprint(s) == f1[w.rows.start + i]]
                if meant:
                    sig = signatures([sets[i] for i in meant], spec.long)
                    ids = b.column(0).slice(w.rows.start, len(sets)).take(pa.array(meant))
                    yield pa.record_batch([ids, pa.array([s.tobytes() for s in sig], pa.binary())], ["id", "sig"])

    return texts.mapInArrow(lean(run), "id long, sig binary").dropDuplicates(["id"])


def _survives(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs (rows of a and b) that no batch gives up."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        go = matches >= least
        alive, matches, done = alive[go], matches[go], n
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, size)


def prune(pairs: DataFrame, sigs: DataFrame, spec: NearDedup) -> DataFrame:
    """The pairs (a, b) that pass all signature batches. Both tables are written ones: Spark splits the pairs of a hot hub."""
    steps = least_matches(spec, spec.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keep = pa.array(_survives(_matrix(part.column(2), spec.size), _matrix(part.column(3), spec.size), steps))
                yield pa.record_batch([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


#: Ids that are sent to all tasks at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _texts_of(docs: DataFrame, ids: DataFrame, sigs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, f1 (of the set meant) and text of the rows of docs with one of ``ids`` (distinct).

    Few ids go to the texts; if they are many, both are shuffled.
    """
    ids = scratch.stored(ids.join(sigs.select("id", "f1"), "id"), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "id").select("id", "f1", "text")


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=U).astype(np.int64))


#: Bytes of both sides' texts that pairs are verified in at once; a longer pair is verified alone.
PAIR_BYTES = 2 << 20
#: Pairs that a task verifies, about.
PAIRS = 2000


def _word_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number) of each word; numbers are equal where, and only where, the words' bytes are."""
    h = w.hashes()
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    size, like = w.ends - w.starts, first[ids]
    if (size == size[like]).all() and equal_ranges(w.data, w.starts, w.data, w.starts[like], size).all():
        return h, ids
    raw, known = w.data.tobytes(), {}
    return h, np.array([known.setdefault(raw[i:j], len(known)) for i, j in zip(w.starts.tolist(), w.ends.tolist(), strict=True)], np.int64)


def _window_ids(hashes: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each window of k words, equal where, and only where, all their words are."""
    keys = combine(hashes, k)
    _, first, out = np.unique(keys, return_index=True, return_inverse=True)
    like, n = first[out], len(keys)
    if all((ids[j : n + j] == ids[like + j]).all() for j in range(k)):
        return out
    out = ids[:n]
    for j in range(1, k):
        out = np.unique(out * (int(ids.max()) + 1) + ids[j : n + j], return_inverse=True)[1]
    return out


def similar(left: pa.Array, right: pa.Array, spec: NearDedup) -> np.ndarray:
    """Whether the full shingle sets of left[i] and right[i], words compared and not hashes, are similar enough.

    Of texts shorter than a shingle, equal ones have been one document since before; different ones are not similar.
    """
    m = len(left)
    texts = pa.concat_arrays([left, right])
    w = next(word_groups(texts, SPACES, limit=1 << 62))
    if len(w.starts) < spec.shingle:
        return np.zeros(m, bool)
    windows = _window_ids(*_word_ids(w), spec.shingle)
    text = w.text_of[: len(windows)]
    inside = np.flatnonzero(text == w.text_of[spec.shingle - 1 :])
    width = len(w.starts)
    of = np.unique(text[inside] * width + windows[inside])
    n = np.bincount(of // width, minlength=2 * m)
    pair = np.sort(of // width % m * width + of % width)
    common = np.bincount(pair[1:][pair[1:] == pair[:-1]] // width, minlength=m)
    return (common > 0) & (100 * common >= spec.percent * (n[:m] + n[m:] - common))


def verify(pairs: DataFrame, docs: DataFrame, sigs: DataFrame, spec: NearDedup, scratch: Scratch) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. docs: id, text; sigs: id, f1, which tells rows of one id apart."""

    def meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [_fingerprint(s) if len(s) else 0 for w in word_groups(b.column(2), SPACES) for s in shingle_sets(w, spec.shingle)]
            keep = pa.array(np.flatnonzero(np.array(prints, np.int64) == b.column(1).to_numpy()))
            yield pa.record_batch([b.column(0).take(keep), b.column(2).take(keep)], ["id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, i = np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(b.column(2), b.column(3), strict=True)]), 0
            while i < b.num_rows:
                before = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + PAIR_BYTES, side="right")))
                keep = pa.array(np.flatnonzero(similar(b.column(2).slice(i, j - i), b.column(3).slice(i, j - i), spec)) + i)
                yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])
                i = j

    # Pairs are small and their comparison is not: they are spread before the texts join them.
    n = min(8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    pairs = pairs.repartition(max(1, n))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    found = _texts_of(docs, ids, sigs, scratch).mapInArrow(lean(meant), "id long, text string")
    full = scratch.stored(found.dropDuplicates(["id"]), "texts")
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long")


#: Pairs of one group that are compared at once.
PAIRS_AT_ONCE = 1 << 16


def _rest(spec: NearDedup):
    """Of two blocks of one group's members: pairs of different components that pass all signature batches.

    A pair that agrees on several bands is in the groups of all of these; it counts in the first one.
    """
    steps, rows, bands = least_matches(spec, spec.long), 2 * spec.rows, spec.long_bands

    def run(table: pa.Table) -> pa.Table:
        ids, comps, block = (table.column(c).combine_chunks().to_numpy() for c in ("id", "component", "block"))
        p, q, band = (table.column(c)[0].as_py() for c in ("p", "q", "band"))
        sig = _matrix(table.column("sig").combine_chunks(), spec.long)
        xs, ys = np.flatnonzero(block == p), np.flatnonzero(block == q)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        per = max(1, PAIRS_AT_ONCE // max(1, len(ys)))
        for at in range(0, len(xs), per):
            x, y = np.repeat(xs[at : at + per], len(ys)), np.tile(ys, len(xs[at : at + per]))
            open_ = (comps[x] != comps[y]) & ((ids[x] < ids[y]) if p == q else True)
            x, y = x[open_], y[open_]
            matches, done = np.zeros(len(x), np.int32), 0
            for n, least in steps:
                if not len(x):
                    break
                matches = matches + (sig[x, done:n] == sig[y, done:n]).sum(axis=1, dtype=np.int32)
                go = matches >= least
                x, y, matches, done = x[go], y[go], matches[go], n
            if band >= 0 and len(x):
                first = (sig[x, : bands * rows] == sig[y, : bands * rows]).reshape(-1, bands, rows).all(axis=2).argmax(axis=1)
                x, y = x[first == band], y[first == band]
            a.append(np.minimum(ids[x], ids[y]))
            b.append(np.maximum(ids[x], ids[y]))
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _bands(bands: int, rows: int, column: str):
    """(id, key, band) of every band of ``rows`` values of each signature; a column of components is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1), len(b.column(1)[0].as_buffer()) // 2)
            m = m[:, : bands * rows].reshape(b.num_rows, bands, rows).astype(U)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F), (b.num_rows, bands))
            for k in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + m[:, :, k] + U(1))
            yield pa.record_batch([*(pa.array(np.repeat(c.to_numpy(), bands)) for c in (b.column(0), *b.columns[2:])), pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), b.num_rows))], ["id", *b.schema.names[2:], column, "band"])

    return lean(run)


def near_duplicates(docs: DataFrame, spec: NearDedup = NearDedup(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id (cast to long), n_shingles, component_id, kept."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, spec, scratch)


def _near_duplicates(docs: DataFrame, spec: NearDedup, scratch: Scratch) -> DataFrame:
    # Aggregates are written before they are joined: both sides of such a join are plain shuffles, whose hot keys
    # Spark splits over tasks.
    keep = scratch.stored
    sketched = keep(docs.mapInArrow(lean(_sketch(spec)), "id long, n long, f1 long, f2 long, sig binary"), "sketch")
    known = sketched.where("id is not null and n > 0")
    # One row for each distinct set; a repeated id with different texts belongs to several of them.
    classes = keep(known.groupBy("n", "f1", "f2", "sig").agg(F.min("id").alias("id"), F.max("id").alias("last")), "classes")
    members = known.join(classes.where("last > id").select("n", "f1", "f2", F.col("id").alias("rep")), ["n", "f1", "f2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    sigs = keep(classes.groupBy("id").agg(F.min(F.struct("n", "f1", "f2", "sig")).alias("s")).select("id", "s.f1", "s.sig"), "signatures")
    banded = keep(sigs.select("id", "sig").mapInArrow(_bands(spec.bands, spec.rows, "bucket"), "id long, bucket long, band int").drop("band"), "bands")
    # The hub of a bucket is the member whose buckets hold the most members in all: of a group of near
    # copies, most likely the text that the others were made from.
    sizes = keep(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = keep(banded.join(sizes, "bucket"), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    shared = shared.join(weight, "id")
    hubs = keep(shared.groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), F.col("id"))).alias("s")).select("bucket", F.col("s.id").alias("hub")), "hubs")
    buckets = keep(shared.select("id", "bucket", "size").join(hubs, "bucket"), "buckets")
    stars = keep(buckets.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "stars")
    first = keep(verify(keep(prune(stars, sigs, spec), "survivors"), docs, sigs, spec, scratch), "links")
    # Second pass: members of a hub's buckets that the stars left apart.
    labels = components(first)
    groups = buckets.where("size > 2").select("hub", "id").distinct().join(labels, "id", "left").select(F.col("hub").alias("group"), "id", F.coalesce("component", "id").alias("component"))
    apart = keep(_apart(groups), "apart")
    members_of = keep(groups.join(apart, "group"), "members")
    long = keep(_sketches(_texts_of(docs, members_of.select("id").distinct(), sigs, scratch), spec), "long")
    # Members of a large group are compared where they agree on a longer band of the long signatures; a pair at the
    # threshold misses all of these with a probability of about 1e-5. Of small groups all members are compared.
    large = members_of.where(F.col("size") > spec.block).select("id", "component").distinct()
    closer = keep(long.join(large, "id").select("id", "sig", "component").mapInArrow(_bands(spec.long_bands, 2 * spec.rows, "group"), "id long, component long, group long, band int"), "closer")
    again = keep(_apart(closer), "again")
    members_of = members_of.where(F.col("size") <= spec.block).withColumn("band", F.lit(-1)).unionByName(closer.join(again, "group"))
    members_of = members_of.withColumn("blocks", F.ceil(F.col("size") / spec.block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = members_of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", "band", "id", "component", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    rest = tasks.join(long, "id").groupBy("group", "band", "p", "q").applyInArrow(_rest(spec), "a long, b long").distinct()
    rest = keep(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    second = verify(rest, docs, sigs, spec, scratch)
    # The first pass's components stand for its links: they are stars already.
    final = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second).unionByName(members))
    drop_stored(labels)
    out = sketched.select("id", "n").join(final, "id", "left")
    component = F.coalesce("component", "id")
    # What the result reads stays: one narrow row for each document.
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    out = scratch.stored(out, "components", keep=True)
    drop_stored(final)
    return out


def _apart(groups: DataFrame) -> DataFrame:
    """(group, size) of the groups whose members are of several components."""
    return groups.groupBy("group").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y").select("group", "size")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), NearDedup(shingle=4))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (five-word shingles). Rows without an id stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("doc_id")]
    groups = near_duplicates(docs)
    with Scratch(spark) as scratch:
        out = scratch.stored(groups.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone", keep=True)
    drop_stored(groups)
    gone = F.broadcast(out) if out.count() <= BROADCAST_IDS else out.hint("merge")
    return docs.toDF(*names).join(gone, F.col(at) == F.col("gone"), "left_anti").toDF(*docs.columns)
