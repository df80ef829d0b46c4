"""Words of thousands of bytes that are permutations of each other: no operator may take one for another."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import fm_dedup, near_dedup, packing
from loomspark.llm.texthash import NOT_SPACE, word_bounds, word_chunks, word_hashes


def long_words(seed: int, n: int = 24) -> list[str]:
    """Permutations of pieces of 8, 4096 and odd numbers of bytes, of 5,000 to 20,000 bytes."""
    rng, out = random.Random(seed), []
    for k in range(n):
        size = (8, 4096, 1000, 37)[k % 4]
        parts = [chr(97 + j % 26) * size for j in range(-(-rng.randint(5000, 18_000) // size))]
        rng.shuffle(parts)
        out += ["".join(parts), "".join(reversed(parts)), "".join(parts[1:] + parts[:1])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
def test_hashes_tell_words_apart(words):
    words = [bytes(x if x not in b" \t\n\v\f\r" else 65 for x in w) for w in words]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_SPACE)
    for block in (1, 7, 1 << 20):
        h = word_hashes(data, starts, ends, block)
        assert len(set(h.tolist())) == len(set(words)) and len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words))
    chunks, at = word_chunks(data, starts, ends)
    assert [chunks[a:b].tobytes()[: len(w)] for w, a, b in zip(words, at[:-1], at[1:], strict=True)] == words


def test_hashes_of_long_words():
    words = sorted({w.encode() for s in range(6) for w in long_words(s)})
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), NOT_SPACE)
    assert len(np.unique(word_hashes(data, starts, ends))) == len(words)


def texts_of(seed: int) -> list[str]:
    rng, words, out = random.Random(seed), long_words(seed, 4), []
    for k in range(14):
        plain = [rng.choice(["river", "stone", "idea", "blue"]) for _ in range(30)]
        plain[rng.randrange(30)] = words[k % len(words)]
        out.append(" ".join(plain))
    return [*out, "a" * 4096 + "b" * 4096 + " x", "b" * 4096 + "a" * 4096 + " x", " ".join(words[:3]), " ".join(words[1:4]), out[0], out[3]]


def test_window_dedup(frame):
    for seed in (1, 2):
        texts = texts_of(seed)
        seen, want = set(), {}
        for d, t in enumerate(texts):
            w = t.split()
            gone = [False] * len(w)
            for p in range(len(w) - 19):
                k = tuple(w[p : p + 20])
                if k in seen:
                    gone[p : p + 20] = [True] * 20
                seen.add(k)
            want[d] = sum(gone)
        got = fm_dedup.window_dedup(frame([(d, t, "s") for d, t in enumerate(texts)])).collect()
        assert {r.doc_id: r.n_removed for r in got} == want and sum(want.values()) > 0


def test_near_dedup(frame):
    from test_operators import jaccard_components

    for seed in (1, 2):
        rows = [(d, t, "s") for d, t in enumerate(texts_of(seed))]
        _, root = jaccard_components(rows, 85)
        got = near_dedup.near_duplicates(frame(rows), percent=85).collect()
        assert {r.doc_id: r.component_id for r in got} == root


def test_equal_digests_are_not_trusted(frame, monkeypatch):
    """Groups of one digest are compared on their sets: where all digests are equal, the result stays the same."""
    rows = [(d, " ".join(f"w{d // 2 * 10 + k}" for k in range(9)), "s") for d in range(12)]
    docs = frame(rows)
    table = docs.select("doc_id", near_dedup.F.length("text").cast("long").alias("weight"), near_dedup.F.lit(1).alias("one"), near_dedup.F.lit(1).alias("two"), near_dedup.F.lit(5).alias("n"))
    texts = docs.select(near_dedup.F.col("doc_id").alias("id"), near_dedup.F.col("text").cast("binary").alias("text"))
    assert sorted(map(tuple, near_dedup.confirmed(texts, table, 5).collect())) == [(0, 1)]


def test_packing(frame, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = texts_of(3)
    want = {}
    for d, t in enumerate(texts):
        want[d] = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
    parts = defaultdict(dict)
    for r in packing.pack(frame([(d, t, "s") for d, t in enumerate(texts)]).coalesce(1)).collect():
        parts[r.doc_id][r.start] = bytes(r.ids)
    assert {d: b"".join(x for _, x in sorted(p.items())) for d, p in parts.items()} == want
    # one hash for all words: the spelling decides
    monkeypatch.setattr(packing, "chunk_hashes", lambda x, first, lengths: np.zeros(len(lengths), np.uint64))
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    data = [f"word{k} and some more {k}".encode() for k in range(9)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    ids, at = words.encode(offsets, np.frombuffer(b"".join(data), np.uint8))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(b.decode(), add_special_tokens=False).ids for b in data]
    assert zlib.crc32(want[0])
