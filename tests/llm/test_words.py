import re

import numpy as np
import pyarrow as pa
import pytest
from colliding import thue_morse
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import tokens, words

TEXT = st.text(st.one_of(st.sampled_from("aAbB zZ09 \t\n\x0b\x0c\r\x1c\x85'!-_|<>é É́ßſKİ日本　"), st.characters(exclude_categories=["Cs"])), max_size=60)
LISTS = st.lists(st.one_of(st.none(), TEXT), max_size=8)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=300, deadline=None)
@given(LISTS, st.integers(1, 40))
def test_words_equal_regular_expressions(texts, limit):
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    for separators, pattern in ((words.SPACES, r"[^\x20\x09-\x0D]+"), (words.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got, hashes = [], []
        for w in words.word_groups(array, separators, limit=limit):
            raw = w.data.tobytes()
            found = [raw[i:j].decode() for i, j in zip(w.starts.tolist(), w.ends.tolist())]
            hashes += zip(found, w.hashes().tolist())
            got += [found[i:j] for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
        assert got == [re.findall(pattern, lower(t)) for t in texts]
        assert len(set(hashes)) == len({w for w, _ in hashes}) == len({h for _, h in hashes})


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    encoder = tokens.encoder(tokens.tokenizer_path())
    got = [(ids, counts) for _, ids, counts in tokens.encoded_groups(pa.array(texts), tokens.tokenizer_path())]
    flat, counts = np.concatenate([g[0] for g in got]).tolist(), np.concatenate([g[1] for g in got])
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]
    assert flat == [i for ids in want for i in ids] and counts.tolist() == list(map(len, want))


def test_cache_starts_anew(monkeypatch):
    encoder = tokens.ChunkEncoder(tokens.tokenizer_path())
    monkeypatch.setattr(tokens, "CACHE", 50)
    for k in range(6):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        data = np.frombuffer(text.encode(), np.uint8)
        ids, counts = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]


def test_hash_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 50_000).astype(np.uint64))
    keys = np.concatenate((keys, np.array([0, 1, 2], np.uint64)))
    t = tokens.HashTable()
    t.add(keys[:20_000])
    t.add(keys[20_000:])
    assert (t.get(keys) == np.arange(len(keys))).all() and (t.get(keys + np.uint64(1 << 63)) == -1).all()


def bits_of(raws):
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    return data, ends - [len(r) for r in raws], ends


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=12), st.lists(st.integers(1, 2000), max_size=3))
def test_hashes_of_ranges_depend_on_all_bytes_and_nothing_else(raws, sizes):
    raws = [*raws, *(b"x" * n for n in sizes), *(b"x" * n + b"y" for n in sizes), b"a", b"a\0", b"", b"a\0\0\0\0\0\0\0"] * 2
    data, starts, ends = bits_of(raws)
    h = words.hash_ranges(data, starts, ends).tolist()
    assert len(set(zip(raws, h))) == len(set(raws)) == len(set(h))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.integers(1, 200), st.integers(0, 8000)), min_size=1, max_size=8))
def test_equal_ranges(parts):
    raws = [x * n for x, n, _ in parts]
    other = []
    for raw, (_, _, at) in zip(raws, parts):
        x = bytearray(raw)
        if x and at % 3:
            x[at % len(x)] ^= 1 << at % 8
        other.append(bytes(x))
    (a, s, e), (b, t, _) = bits_of(raws), bits_of(other)
    assert words.equal_ranges(a, s, b, t, e - s).tolist() == [x == y for x, y in zip(raws, other)]


def test_colliding_words_and_windows():
    a, b = thue_morse()
    data, starts, ends = bits_of([a.encode(), b.encode(), a[:64].encode(), b[:64].encode(), a[:100].encode(), b[:100].encode()])
    h = words.hash_ranges(data, starts, ends)
    assert len(set(h.tolist())) == 6
    assert len(set(words.combine(h, 2).tolist())) == 5


@pytest.mark.parametrize("spoiled", [False, True])
def test_ids_of_colliding_chunks(monkeypatch, spoiled):
    """Two chunks of one hash, even where all of eight bytes or more share one, keep their own ids."""
    if spoiled:
        plain = words.hash_ranges
        monkeypatch.setattr(words, "hash_ranges", lambda data, starts, ends: np.where(ends - starts < 8, plain(data, starts, ends), np.uint64(7)))
    encoder = tokens.ChunkEncoder(tokens.tokenizer_path())
    for text in (*thue_morse(), "one two", "two one three", "seventeen nineteen", "nineteen seventeen six", *thue_morse()):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, counts = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]
