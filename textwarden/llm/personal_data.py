"""Personal data: fixed patterns, plus a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans. The field labels white-space separated words as
nothing, ``secret`` (credentials) or ``account`` (bank and identity numbers) by their shape, by cue words
at and before them and by their neighbours' labels; it is trained on the driver from the small labelled table
below. Its spans are added where no base span lies.

Decoding is exact Viterbi over whole texts. A word whose lead for "nothing" is greater than all that
transitions beside it could gain is "nothing" on every best path; such words part the text into short
runs, which are decoded together, step by step, in numpy batches.

Cases: a null or empty text has no spans; a text of one huge word or of a million words is decoded whole; repeated
rows and null ids get a row each; extra columns go through ``keep``; an empty table gives an empty result.
Kinds may overlap each other; spans of one kind don't.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import LOWER, SPACES, U, Words, groups, hash_ranges, lean, segment

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account")
LABELS = ("nothing", "secret", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The kinds' patterns in forms that a text of any shape takes linear time to search: possessive, and begun at
# the front of a run of digits only. An address is searched outwards from its @.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and non-overlapping."""
    free = 0  # what lies before is matched or can't begin an address
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, leftmost and non-overlapping for each kind."""
    out = []
    out += [(s, "email", e) for s, e in _emails(text)]
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_is_byte, m[0].split(".")))]
    out += [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# The labelled table: rows of words, values in braces stand for generated ones of that label.
CUES = {
    "secret": "token secret password passwd pwd api_key apikey access_key secret_key auth_token client_secret bearer credential passphrase private_key".split(),
    "account": "iban konto account ssn passport steuernummer dni siren kontonummer cuenta compte".split(),
}
_PATTERNS = {
    "secret": ['{cue} = "{value}"', "{cue}={value}", "{cue}: {value}", '{cue}="{value}"', "{cue} = {value}", "{cue}:{value}", "{key}", "{key}.", '"{key}"', "my {cue} is {value}", "{cue} {value}"],
    "account": ["{cue} {value}", "{cue}: {value}", "{cue} = {value}", "{cue} no. {value}", "my {cue} is {value}"],
}
_PLAIN = (
    "Version 2.0 of 3.0. or 2.0.1, in 1999 and 2024-05-06 at 12:30:00 for $19.99 (50%) | a | b | --- ### the*** of$$$ to%%% and&&& "
    "DIE!! DAS.!! IEGEZU!! ISO-8859-1 H2O B2B 3D x86_64 utf-8 sha256 mp3 COVID19 4040549990366437 5555444433332222 +1 (499) 555-6503 "
    "192.168.10.1 10.0.0.1. a.b@example.org http://www.example.org/a/b?c=1 https://example.com/index.html note: key: = == => := "
    "x=1 n=10 i++ <b> </p> class=\"top\" {} [12] (a) 'quoted' \"quoted\" \"Quoted,\" 1,234,567 1.5e-7 No.7 A4 Q3"
).split()
_PROSE = "the of and that with for la les des une der die und mit para que los token password secret account key is was".split()


def labelled_table(rows: int = 3000, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """(words, labels) rows made from the table above; the same for the same seed."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    chars = lambda alphabet, low, high: "".join(pick(alphabet) for _ in range(int(r.integers(low, high))))
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def word() -> str:
        w = chars(lower + "eaeaeoinrstn" + "éöüñ"[: int(r.integers(5))], 1, pick([5, 9, 14, 30]))
        w = pick([w, w, w, w, w.title(), w.title() + ",", w + ",", w + ".", w.upper(), w.upper() + "!!", w.upper() + ".!!", w + pick(["***", "$$$", "%%%", "&&&", "###"])])
        return pick([w, w, w, w, w, w, pick(_PLAIN), pick(_PLAIN), pick(_PROSE), chars(digit, 1, 7)])

    def secret() -> str:
        return pick([chars("abcdef" + digit, 12, 48), chars("abcdef" + digit, 16, 41), chars(upper * int(r.integers(1, 5)) + digit, 12, 24), chars(upper + lower + digit, 12, 44), chars(upper + lower + digit, 6, 12) + pick("!#%7")])

    def key() -> str:
        return pick(["AKIA", "ASIA", "ghp_", "sk-", "xoxb-"]) + chars(upper * int(r.integers(1, 5)) + digit, 16, 17)

    def account() -> str:
        return pick([pick(["DE", "FR", "ES", "GB"]) + chars(digit, 20, 21), f"{chars(digit, 3, 4)}-{chars(digit, 2, 3)}-{chars(digit, 4, 5)}", pick(upper) + chars(digit, 8, 9)])

    out = []
    for k in range(rows):
        words, labels = [], []
        for _ in range(int(r.integers(1, 4))):
            plain = [word() for _ in range(int(r.integers(2, 9)))]
            words += plain
            labels += [0] * len(plain)
            if k % 2:
                kind = pick(["secret", "secret", "account"])
                value = secret() if kind == "secret" else account()
                made = pick(_PATTERNS[kind]).format(cue=pick([str.lower, str.lower, str.upper, str.title])(pick(CUES[kind])), value="\0".join(f"\1{v}" for v in value.split()), key="\1" + key())
                for w in made.replace("\0", " ").split():
                    labels.append(LABELS.index(kind) if "\1" in w else 0)
                    words.append(w.replace("\1", ""))
                if r.random() < 0.2:
                    words[-1] += pick([".", ",", "***", "###", "!!"])
        out.append((words, labels))
    return out


_BITS = np.zeros(256, np.uint8)
_BITS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_BITS[0x41:0x5B] = 2
_BITS[0x30:0x3A] = 4
_BITS[[k for k in range(0x21, 0x80) if not _BITS[k]]] = 8
_BITS[[0x3D, 0x3A]] = 8 | 16  # = and :
_AT = 0x40
SHAPES = 32 * 8 * 4


def _cue_ids() -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, id from 1) of all cue words and of what may stand between a cue and its value."""
    names = [*CUES["secret"], *CUES["account"], "=", ":"]
    h = np.array([_hash(n) for n in names], U)
    by = np.argsort(h)
    return h[by], by + 1


def _hash(word: str) -> int:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(hash_ranges(data, np.array([0]), np.array([len(data)]))[0])


N_CUES = 1 + sum(map(len, CUES.values())) + 2


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(shape, cue) of each word; w holds the texts as they are."""
    n = len(w.starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = _BITS[w.data]
    kinds = np.bitwise_or.reduceat(bits, w.starts).astype(np.int64)
    code = (bits & 4) > 0
    letter = (bits & 3) > 0
    turn = np.zeros(len(bits), np.uint8)
    turn[1:] = (code[1:] & letter[:-1]) | (letter[1:] & code[:-1])
    turn[w.starts] = 0
    # Two turns or more between letters and digits are a mark of keys.
    turns = np.add.reduceat(turn, w.starts, dtype=np.int64)
    length = np.searchsorted([2, 4, 6, 9, 12, 16, 24], w.ends - w.starts, side="right")
    shape = kinds + 32 * (length + 8 * np.minimum((turns + 1) // 2, 3))
    # Cues: the word without symbols around it, or what stands before its first = or :.
    s, e = w.starts.copy(), w.ends.copy()
    other = bits == 8
    for _ in range(3):
        e -= (e - s > 1) & other[e - 1]
        s += (e - s > 1) & other[s]
    mark = np.flatnonzero((kinds & 16) > 0)
    if len(mark):
        marks = np.flatnonzero((bits & 16) > 0)
        first = marks[np.searchsorted(marks, w.starts[mark])]
        inside = (first > s[mark]) & (first < e[mark] + 1)
        e[mark[inside]] = first[inside]
        at = mark[~inside]
        s[at], e[at] = w.starts[at], w.starts[at] + 1
    hashes = hash_ranges(LOWER[w.data], s, e)
    known, ids = _cue_ids()
    i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return shape, np.where(known[i] == hashes, ids[i], 0)


@dataclass
class Field:
    shape: np.ndarray  # SHAPES, K
    cue: np.ndarray  # 3, N_CUES, K: at the word, one and two words before
    move: np.ndarray  # K, K
    begin: np.ndarray  # K

    def emissions(self, shape: np.ndarray, cue: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: index of each text's first word."""
        out = self.shape[shape] + self.cue[0][cue]
        place = np.arange(len(shape)) - np.repeat(first[:-1], np.diff(first))
        for back in (1, 2):
            before = np.zeros_like(cue)
            before[back:] = cue[:-back]
            before[place < back] = 0
            out += self.cue[back][before]
        return out


def _feature_rows(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = np.frombuffer(" ".join(" ".join(r) for r in rows).encode(), np.uint8), [0]
    for r in rows:
        offsets.append(offsets[-1] + len(" ".join(r).encode()) + 1)
    offsets[-1] -= 1
    w = segment(data, np.array(offsets), SPACES, slice(0, len(rows)))
    return *word_features(w), w.first


@cache
def trained(rows: int = 3000, seed: int = 7, steps: int = 300, penalty: float = 2e-6) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole labelled table."""
    table = labelled_table(rows, seed)
    shape, cue, first = _feature_rows([w for w, _ in table])
    y = np.concatenate([labels for _, labels in table])
    k = len(LABELS)
    field = Field(np.zeros((SHAPES, k)), np.zeros((3, N_CUES, k)), np.zeros((k, k)), np.zeros(k))
    # Words stand by their place in the row, then by row, longer rows first: step t is a slice, and so is what it goes on from.
    length = np.diff(first)
    by = np.argsort(-length, kind="stable")
    many = [int((length > t).sum()) for t in range(int(length.max()))]
    where = np.concatenate([first[:-1][by[:m]] + t for t, m in enumerate(many)])
    begin = np.concatenate(([0], np.cumsum(many)))
    place = np.repeat(np.arange(len(many)), many)
    befores = [np.where(place >= back, cue[np.maximum(where - back, 0)], 0) for back in range(3)]
    shape, y = shape[where], y[where]
    weights = [field.shape, field.cue, field.move, field.begin]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in weights]
    target, pairs = np.eye(k)[y], np.zeros((k, k))
    for t in range(1, len(many)):
        np.add.at(pairs, (y[begin[t - 1] : begin[t - 1] + many[t]], y[begin[t] : begin[t + 1]]), 1)
    counted = lambda ids, gap, size: np.stack([np.bincount(ids, gap[:, label], size) for label in range(k)], axis=1)
    alpha, beta, scale = np.empty((len(y), k)), np.empty((len(y), k)), np.empty((len(y), 1))
    for step in range(1, steps + 1):
        e = field.shape[shape]
        for back, ids in enumerate(befores):
            e += field.cue[back][ids]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        m = np.exp(field.move - field.move.max())
        for t, n in enumerate(many):
            i = begin[t]
            a = alpha[begin[t - 1] : begin[t - 1] + n] @ m if t else np.exp(field.begin)
            a = a * e[i : i + n]
            scale[i : i + n] = a.sum(axis=1, keepdims=True)
            alpha[i : i + n] = a / scale[i : i + n]
        beta[:] = 1.0
        got_pairs = np.zeros((k, k))
        for t in range(len(many) - 1, 0, -1):
            i, j, n = begin[t], begin[t - 1], many[t]
            b = e[i : i + n] * beta[i : i + n] / scale[i : i + n]
            got_pairs += alpha[j : j + n].T @ b
            beta[j : j + n] = b @ m.T
        gap = (alpha * beta - target) / len(y)
        slopes = [counted(shape, gap, SHAPES), np.stack([counted(ids, gap, N_CUES) for ids in befores]), (got_pairs * m - pairs) / len(y), gap[: many[0]].sum(axis=0)]
        for a, g, (m1, m2) in zip(weights, slopes, moments, strict=True):
            g += penalty * a
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            a -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return field


def viterbi(field: Field, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of all texts (words first[i]:first[i + 1] are text i's), exactly."""
    n, move = len(scores), field.move
    labels = np.zeros(n, np.int64)
    if not n:
        return labels
    # Whatever stands beside a word, another label than 0 gains at most this by its transitions.
    into = np.vstack([move, field.begin])
    gain = (into - into[:, :1]).max(axis=0) + np.maximum((move - move[:1]).max(axis=1), 0)
    open_ = (scores[:, 1:] + gain[1:] >= scores[:, :1]).any(axis=1)
    at = np.flatnonzero(open_)
    if not len(at):
        return labels
    head, tail = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    head[first[:-1]] = True
    tail[first[1:]] = True
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | head[at[1:]]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    order = np.argsort(-length, kind="stable")
    start, length = at[begin[order]], length[order]
    # Before a run stands the text's begin or a 0, behind it the text's end or a 0.
    best = np.where(head[start][:, None], field.begin, move[0]) + scores[start]
    back: list[np.ndarray] = []
    closing = np.where(tail[start + length][:, None], 0.0, move[:, 0])
    for t in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -t, side="left"))
        through = best[:m, :, None] + move
        back.append(through.argmax(axis=1))
        best[:m] = through.max(axis=1) + scores[start[:m] + t]
    label = (best + closing).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(np.searchsorted(-length, -t, side="left"))
        labels[start[:m] + t] = label[:m]
        if t:
            label[:m] = back[t - 1][np.arange(m), label[:m]]
    return labels


def _field_spans(data: np.ndarray, labels: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points of one text: a marked word's value, without symbols around it."""
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bits, out = _BITS[data], []
    for k in np.flatnonzero(labels).tolist():
        s, e = int(starts[k]), int(ends[k])
        marks = np.flatnonzero(bits[s : e - 1] & 16)
        s += int(marks[-1]) + 1 if len(marks) else 0
        while e > s and bits[e - 1] & 8:
            e -= 1
        while s < e and bits[s] & 8:
            s += 1
        if e > s:
            out.append((int(points[s]), LABELS[labels[k]], int(points[e])))
    return out


def _apart_from(spans: list[tuple[int, str, int]], more: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Those of ``more`` that overlap none of ``spans``."""
    starts = sorted(s for s, _, _ in spans)
    reach = list(accumulate((e for _, _, e in sorted(spans)), max))
    # Of the spans that begin before x ends, the one that reaches furthest must end where x begins or before.
    return [x for x in more if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[0]]


def find(texts: pa.Array, field: Field) -> list[list[tuple[int, str, int]]]:
    """The spans of each text, by start, then kind in the order of KINDS."""
    out: list[list[tuple[int, str, int]]] = []
    order = {k: i for i, k in enumerate(KINDS)}
    for rows, data, offsets in groups(texts):
        w = segment(data, offsets, SPACES, rows)
        shape, cue = word_features(w)
        labels = viterbi(field, field.emissions(shape, cue, w.first), w.first) if len(shape) else np.empty(0, np.int64)
        marked = np.zeros(len(offsets) - 1, bool)
        marked[w.text_of[labels > 0]] = True
        flags = ((data >= 0x30) & (data <= 0x39)) | (data == _AT)
        coded = w.sums(flags) > 0
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            spans = base_spans(raw[a:b].decode()) if coded[i] else []
            if marked[i]:
                own = slice(w.first[i], w.first[i + 1])
                more = _field_spans(data[a:b], labels[own], w.starts[own] - a, w.ends[own] - a)
                spans += _apart_from(spans, more)
            out.append(sorted(spans, key=lambda x: (x[0], order[x[1]])))
    return out


def _arrow(spans: list[list[tuple[int, str, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in spans], kind)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Each span, or run of overlapping ones, replaced by [KIND] of its first."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), redact: bool = False) -> DataFrame:
    """``keep`` columns, spans (kind, start, end in code points) and, on demand, the redacted text."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1]), f"spans {SPANS}", *(["redacted string"] * redact)])
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            spans = find(texts, field)
            columns = [*b.columns[:-1], _arrow(spans)]
            if redact:
                columns.append(pa.array([t.as_py() if not x else redacted(t.as_py(), x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.record_batch(columns, [*names, "spans", *(["redacted"] * redact)])

    return rows.mapInArrow(lean(run), schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "spans", *(["redacted"] * redact))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their spans replaced in the text and counted out of n_chars."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = personal_data(docs.toDF(*names), at["text"], names, redact=True)
    text = F.col("redacted")
    out = {at["text"]: text} | ({at["n_chars"]: F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))} if "n_chars" in at else {})
    return rows.select(*[out.get(n, F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])
