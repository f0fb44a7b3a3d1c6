"""A hidden Markov language model, with exact likelihoods of whole texts.

A text is its words (white space parts them, A-Z lower-cased) and one end. Hidden states emit word classes:
the ``own`` most frequent words and the end are classes by themselves, all other words share ``suffixes`` classes
by their last three bytes. Within a shared class a word has its add-half share of the training counts, one
place being left for what was never seen, so the model is a distribution over all texts:
P(text) = P_hmm(classes) * product of P(word | class).

Baum-Welch: each round, tasks add up expected counts of their whole training texts and
``vectors.summed`` adds those of all tasks; only arrays of a size fixed by the parameters reach the driver.
Long texts are worked off in runs of ``run`` tokens: the product of a run's steps, a matrix of states by states, carries alpha
forward and beta backward over all runs of a text, and the counts inside a run are made between these.
Word counts are a table over all training words. Words above a count that at most ``frequent`` words reach are sent to
the tasks; all others are looked up by a join. Scoring runs the scaled forward recursion over whole texts.

Cases: a null or empty text is the end alone; rows with a null doc_id have remainder null, are not
trained on and not held out; repeated rows count and are scored each; without training rows every count is 0 and every class
equally likely; extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored
from .tokens import HashTable
from .vectors import SCHEMA, summed, vector_rows
from .words import SPACES, U, Words, crc32_mod5, lean, mix, word_groups

_STEPS = 32  # of the count histogram, by factor of two


@dataclass(frozen=True)
class Sizes:
    """What bounds the arrays that reach the driver and the tasks."""

    frequent: int = 1 << 18
    own: int = 1 << 14
    suffixes: int = 1 << 10
    run: int = 512

    @property
    def end(self) -> int:
        """The end's class."""
        return self.own + self.suffixes

    @property
    def classes(self) -> int:
        return self.end + 1


@dataclass
class Counts:
    """Of the training words: all of them as a table, the frequent ones as arrays."""

    table: DataFrame  # word, suffix, c
    total: int  # N, ends included
    distinct: int  # V
    texts: int
    words: np.ndarray  # hashes of the frequent ones, most frequent first
    c: np.ndarray
    sizes: Sizes
    suffix_c: np.ndarray  # of the words that have no class of their own
    suffix_v: np.ndarray

    @property
    def class_c(self) -> np.ndarray:
        own = np.zeros(self.sizes.own)
        n = min(len(own), len(self.c))
        own[:n] = self.c[:n]
        return np.concatenate([own, self.suffix_c, [self.texts]])


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K, K
    emit: np.ndarray  # classes, K


def suffixes(w: Words, n: int) -> np.ndarray:
    key = np.zeros(len(w.starts), U)
    for k in range(1, 4):
        at = np.maximum(w.ends - k, 0)
        key = (key << U(8)) | np.where(w.ends - k >= w.starts, w.data[at] if len(w.data) else 0, 0).astype(U)
    return (mix(key + U(1)) % U(n)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """(word, suffix, n), each word once for about every 4 million words of the task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, suffix, n = (np.concatenate(x) for x in zip(*held, strict=True))
        new, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        return new, suffix[first], np.bincount(inverse, n, len(new))

    def rows(x) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int16)), pa.array(x[2].astype(np.int64))], ["word", "suffix", "n"])

    size = 0
    for b in batches:
        for w in word_groups(b.column(0), SPACES):
            h = w.hashes()
            new, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((new, suffixes(w, sizes.suffixes)[first], n.astype(np.float64)))
            size += len(new)
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield rows(held[0])
                    held, size = [], 0
    if held:
        yield rows(merged())


def count_words(docs: DataFrame, sizes: Sizes = Sizes()) -> Counts:
    """docs: text, train (boolean)."""
    training = docs.where("train")
    rows = training.select("text").mapInArrow(lean(lambda b: _count_words(b, sizes)), "word long, suffix short, n long")
    table = stored(rows.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("c")), "words")
    texts = training.count()
    step = F.floor(F.log2("c") * _STEPS).cast("int")
    shared = table.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect()  # at most 64 * _STEPS rows
    least, held = None, 0
    for r in sorted(shared, key=lambda r: -r.step):
        held += r.v
        if held > sizes.frequent:
            break
        least = r.step
    top = table.where(step >= least).select("word", "suffix", "c").toArrow() if least is not None else None
    words, suffix, c = (top.column(k).to_numpy() for k in range(3)) if top is not None else (np.empty(0, np.int64),) * 3
    order = np.lexsort((words, -c))
    words, suffix, c = words[order].view(U), suffix[order], c[order]
    suffix_c, suffix_v = np.zeros(sizes.suffixes), np.zeros(sizes.suffixes)
    for r in table.groupBy("suffix").agg(F.count("*").alias("v"), F.sum("c").alias("c")).collect():
        suffix_c[r.suffix], suffix_v[r.suffix] = r.c, r.v
    suffix_c -= np.bincount(suffix[: sizes.own], c[: sizes.own], sizes.suffixes)
    suffix_v -= np.bincount(suffix[: sizes.own], minlength=sizes.suffixes)
    total, distinct = sum(r.c for r in shared) + texts, sum(r.v for r in shared) + (texts > 0)
    return Counts(table, int(total), int(distinct), texts, words, c, sizes, suffix_c, suffix_v)


def classify(docs: DataFrame, counts: Counts) -> DataFrame:
    """Stored rows: place, id, held_out, train, n_tokens, known, log_c (frequent words only), log_class, classes, rare words and their numbers."""
    words, c, texts, sizes = counts.words, counts.c, counts.texts, counts.sizes
    log_c = np.log10(c + 0.5)
    log_share = np.log10(counts.suffix_c + 0.5 * (counts.suffix_v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable()
        table.add(words)
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            for w in word_groups(b.column(3), SPACES):
                h, n = w.hashes(), len(w.counts)
                rank = table.get(h)
                known = rank >= 0
                own = (rank >= 0) & (rank < sizes.own)
                suffix = suffixes(w, sizes.suffixes)
                classes = np.where(own, rank, sizes.own + suffix)
                log = np.zeros(len(h))
                log[known] = log_c[rank[known]]
                share = np.where(own, 0.0, -log_share[suffix])
                share[known & ~own] += log[known & ~own]
                sums = lambda x: np.add.reduceat(np.append(x, 0), w.first[:-1]) * (w.counts > 0)
                rare = np.flatnonzero(~known)
                text_of = w.text_of[rare]
                by = np.lexsort((h[rare], text_of))
                key_t, key_h = text_of[by], h[rare][by]
                new = np.ones(len(by), bool)
                new[1:] = (key_t[1:] != key_t[:-1]) | (key_h[1:] != key_h[:-1])
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(by)))
                cut = np.searchsorted(key_t[first], np.arange(n + 1)).astype(np.int32)
                ended = np.insert(classes, w.first[1:], sizes.end).astype("<u2")
                at = (w.first + np.arange(n + 1)).tolist()
                rows = slice(w.rows.start, w.rows.stop)
                yield pa.record_batch(
                    [
                        pa.array(place + np.arange(n)),
                        *(b.column(k).slice(rows.start, n) for k in range(3)),
                        pa.array(w.counts.astype(np.int64) + 1),
                        pa.array(sums(known.astype(np.int64)) + (texts > 0)),
                        pa.array(sums(log) + np.log10(texts + 0.5)),
                        pa.array(sums(share)),
                        pa.array([ended[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(key_h[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(many.astype(np.int32))),
                    ],
                    ["place", "id", "held_out", "train", "n_tokens", "known", "log_c", "log_class", "classes", "rare", "rare_n"],
                )
                place += n

    schema = "place long, id long, held_out boolean, train boolean, n_tokens long, known long, log_c double, log_class double, classes binary, rare array<long>, rare_n array<int>"
    return stored(docs.select("id", "held_out", "train", "text").mapInArrow(lean(run), schema), "classes")


def initial(counts: Counts, states: int) -> Model:
    prior = (counts.class_c + 0.5) / (counts.class_c + 0.5).sum()
    noise = (mix(np.arange(1, len(prior) * states + 1, dtype=U)) >> U(11)).astype(np.float64) / 2**53
    emit = prior[:, None] * np.exp(2 * noise.reshape(-1, states))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _by_length(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts in that order, how many sequences are longer than t)."""
    order = np.argsort(-lengths, kind="stable")
    longer = len(lengths) - np.cumsum(np.bincount(lengths))[:-1] if len(lengths) else np.empty(0, int)
    return order, (np.cumsum(lengths) - lengths)[order], longer


def forward(m: Model, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each class sequence; lengths are 1 or more."""
    order, starts, longer = _by_length(flat, lengths)
    out = np.zeros(len(lengths))
    alpha = None
    for t, n in enumerate(longer.tolist()):
        e = m.emit[flat[starts[:n] + t]]
        alpha = m.start * e if alpha is None else (alpha[:n] @ m.move) * e
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        out[:n] += np.log10(scale)
    result = np.empty(len(lengths))
    result[order] = out
    return result


def expected(m: Model, flat: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, move, emit) of class sequences; lengths are 1 or more.

    before: alpha at the token before each sequence, zeros where a text begins; the move into the sequence is counted with it.
    after: beta at its last token, to any scale. Without them sequences are whole texts.
    """
    k = len(m.start)
    order, starts, longer = _by_length(flat, lengths)
    n_at = longer.tolist()
    before = np.zeros((len(lengths), k)) if before is None else before[order]
    begins = ~before.any(axis=1)
    first = np.concatenate(([0], np.cumsum(longer)))
    # Rows of alpha and e stand by step, then by sequence.
    where = np.concatenate([starts[:n] + t for t, n in enumerate(n_at)])
    classes = flat[where]
    e = m.emit[classes]
    alpha, scale = np.empty((len(where), k)), np.empty(len(where))
    for t, n in enumerate(n_at):
        i = first[t]
        a = alpha[i : i + n]
        if t:
            np.matmul(alpha[first[t - 1] : first[t - 1] + n], m.move, out=a)
            a *= e[i : i + n]
        else:
            np.multiply(np.where(begins[:, None], m.start, before @ m.move), e[:n], out=a)
        s = a.sum(axis=1)
        scale[i : i + n] = s
        a /= s[:, None]
    gamma, move = np.empty_like(alpha), np.zeros((k, k))
    if after is None:
        beta = np.ones((n_at[0], k))
    else:
        last = alpha[first[lengths[order] - 1] + np.arange(len(order))]
        beta = after[order] / (last * after[order]).sum(axis=1, keepdims=True)
    for t in range(len(n_at) - 1, -1, -1):
        i, n = first[t], n_at[t]
        np.multiply(alpha[i : i + n], beta[:n], out=gamma[i : i + n])
        weighted = e[i : i + n] * beta[:n] / scale[i : i + n, None]
        if t:
            j = first[t - 1]
            move += alpha[j : j + n].T @ weighted
            beta[:n] = weighted @ m.move.T
        else:
            move += before.T @ weighted
    emit = np.stack([np.bincount(classes, gamma[:, s], len(m.emit)) for s in range(k)], axis=1)
    return gamma[: n_at[0]][begins].sum(axis=0), move * m.move, emit


def _products(m: Model, flat: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each run the product of its steps (move, then emission), to any scale; where a text begins all rows are start."""
    k = len(m.start)
    order, starts, longer = _by_length(flat, lengths)
    p = np.empty((len(lengths), k, k))
    for t, n in enumerate(longer.tolist()):
        q = p[:n]
        q[:] = (q.reshape(-1, k) @ m.move).reshape(-1, k, k) if t else np.where(begins[order][:, None, None], m.start, m.move)
        q *= m.emit[flat[starts[:n] + t]][:, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(p)
    out[order] = p
    return out


def counted(m: Model, flat: np.ndarray, lengths: np.ndarray, run: int, tokens: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """expected() of whole texts, worked off in runs of ``run`` tokens and at most ``tokens`` tokens at once."""
    k = len(m.start)
    n = -(-lengths // run)
    ends = np.cumsum(n)
    first = ends - n
    runs = np.full(n.sum(), run)
    runs[ends - 1] = lengths - (n - 1) * run
    begins = np.zeros(len(runs), bool)
    begins[first] = True
    at = np.concatenate(([0], np.cumsum(runs)))
    cuts = [*range(0, len(runs), max(1, tokens // run)), len(runs)]
    before, after = np.zeros((len(runs), k)), np.ones((len(runs), k))
    many = np.repeat(n > 1, n)
    if many.any():
        product = np.zeros((len(runs), k, k))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = np.flatnonzero(many[i:j]) + i
            if len(own):
                part = np.concatenate([flat[at[x] : at[x + 1]] for x in own])
                product[own] = _products(m, part, runs[own], begins[own])
        by = np.argsort(-n, kind="stable")
        longer = len(n) - np.cumsum(np.bincount(n))[:-1]
        for r in range(1, len(longer)):  # the run r of all texts that have it
            x = first[by[: longer[r]]] + r
            alpha = np.einsum("ni,nij->nj", before[x - 1] if r > 1 else np.full((len(x), k), 1 / k), product[x - 1])
            before[x] = alpha / alpha.sum(axis=1, keepdims=True)
            x = ends[by[: longer[r]]] - 1 - r
            beta = np.einsum("nij,nj->ni", product[x + 1], after[x + 1])
            after[x] = beta / beta.sum(axis=1, keepdims=True)
    total = [np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        for x, y in zip(total, expected(m, flat[at[i] : at[j]], runs[i:j], before[i:j], after[i:j]), strict=True):
            x += y
    return total[0], total[1], total[2]


def _sequences(batches: Iterator[pa.RecordBatch], column: int, tokens: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, all classes, lengths) of slices of at most ``tokens`` classes, or one longer row."""
    for b in batches:
        lengths = np.array([len(x) // 2 for x in b.column(column).to_pylist()], np.int64)
        ends, i = np.cumsum(lengths), 0
        while i < b.num_rows:
            before = ends[i] - lengths[i]
            j = max(i + 1, int(np.searchsorted(ends, before + tokens, side="right")))
            part = b.slice(i, j - i)
            yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), "<u2"), lengths[i:j]
            i = j


def train(rows: DataFrame, counts: Counts, states: int = 8, rounds: int = 3) -> Model:
    """rows: classes (binary) of the training texts."""
    m = initial(counts, states)
    prior = counts.class_c + 0.5
    prior /= prior.sum()
    run_length, classes = counts.sizes.run, counts.sizes.classes
    size = states + states * states + classes * states

    def run(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))]
        for _, flat, lengths in _sequences(batches, 0, 1 << 19):
            for x, y in zip(total, counted(m, flat, lengths, run_length), strict=True):
                x += y
        yield vector_rows(np.concatenate([x.ravel() for x in total]))

    for _ in range(rounds if counts.texts else 0):
        got = summed(rows.select("classes").mapInArrow(lean(lambda b, m=m: run(b, m)), SCHEMA), size)
        start, move, emit = got[:states] + 0.01, got[states : states + states**2].reshape(states, states) + 0.01, got[states + states**2 :].reshape(classes, states)
        emit = emit + 20.0 * prior[:, None]
        m = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return m


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train_on: Column | None = None, held_out: Column | None = None, states: int = 8, rounds: int = 3, sizes: Sizes = Sizes()) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    mod = crc32_mod5(F.col(f"`{id_col}`"))
    train_on = mod != 1 if train_on is None else train_on
    held_out = mod == 1 if held_out is None else held_out
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out.alias("held_out"), F.coalesce(train_on, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))
    counts = count_words(docs, sizes)
    rows = classify(docs, counts)
    model = train(rows.where("train"), counts, states, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, lengths in _sequences(batches, 7, 1 << 22):
            yield pa.record_batch([*part.columns[:7], pa.array(forward(model, flat, lengths))], [*part.schema.names[:7], "hmm"])

    columns = ["place", "id", "held_out", "n_tokens", "known", "log_c", "log_class"]
    likely = rows.select(*columns, "classes").mapInArrow(lean(run), "place long, id long, held_out boolean, n_tokens long, known long, log_c double, log_class double, hmm double")
    rare = rows.select("place", F.inline(F.arrays_zip("rare", "rare_n")).alias("word", "n"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts.table.select("word", "c"), "word", "left").groupBy("place").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    bottom = float(np.log10(counts.total + 0.5 * (counts.distinct + 1)))
    return likely.join(sums, "place", "left").select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare_log - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        (F.col("hmm") + F.col("log_class") + rare_log).alias("score"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
