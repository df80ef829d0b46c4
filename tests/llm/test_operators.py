"""Each operator against a brute-force version, on rows with every awkward case, and on an empty table."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from re import _constants as sre

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import exact_dedup, fm_dedup, licenses, media, mixing, near_dedup, packing, passages, sharding, suffix_dedup, toxicity
from loomspark.llm.components import components

SPACE = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(got, want) -> None:
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 5).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows])
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n))
    # fewer copies are apart than a random placement leaves
    by_text = defaultdict(set)
    for r in got:
        by_text[r.text_crc32, r.size].add(r["shard"])
    sizes = Counter((r.text_crc32, r.size) for r in got)
    assert sum(len(by_text[k]) > 1 for k, n in sizes.items() if n > 1) <= sum(n > 1 for n in sizes.values()) // 4
    # links cut, by brute force; a random placement cuts four in five
    linked = defaultdict(Counter)
    for r in got:
        linked[r.text_crc32, r["size"]][r["shard"]] += 1
    nulls = {8} if any(t is None for _, t, _ in rows) else set()
    for r in got:
        of = linked[r.text_crc32, r["size"]]
        if r["size"] not in nulls:
            assert (r.beside, r.apart) == (of[r["shard"]] - 1, sum(of.values()) - of[r["shard"]])
    pairs = sum(r.beside + r.apart for r in got)
    assert sum(r.apart for r in got) <= pairs / 3
    assert sharding.shard_documents(empty, 5).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(docs.limit(3), 24).collect()} <= set(range(24))


def test_sharding_of_a_group_larger_than_a_shard(frame):
    got = sharding.shard_documents(frame([(i, "same" if i < 40 else f"own {i}", "s") for i in range(60)]), 6).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {10}


@pytest.mark.parametrize("first", [1, 48])
def test_exact_dedup(docs, rows, empty, first):
    groups = defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            groups[SPACE.sub(" ", t or "")].append(d)
    want = []
    for d, t, _ in rows:
        n = SPACE.sub(" ", t or "")
        want.append((d, None, 1, True, sha(n)) if d is None else (d, min(groups[n]), len(groups[n]), d == min(groups[n]), sha(n)))
    same(exact_dedup.exact_dedup(docs, first=first).collect(), want)
    assert exact_dedup.exact_dedup(empty).count() == 0


def jaccard_components(rows, percent: int):
    sets = defaultdict(set)
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        if d is not None and w:
            sets[d] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {d: d for d, _, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sets, {d: find(d) for d in root}


@pytest.mark.parametrize("block", [50, near_dedup.BLOCK])
def test_near_dedup(docs, rows, empty, block):
    sets, root = jaccard_components(rows, 80)
    want = [(d, 0 if d is None and not WORD.findall(t or "") else len(sets[d]) if d is not None else None, root.get(d), d is None or root[d] == d) for d, t, _ in rows]
    got = near_dedup.near_duplicates(docs, block=block).collect()
    same([(r.doc_id, r.component_id, r.kept) for r in got], [(d, c, k) for d, _, c, k in want])
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {d: n for d, n, _, _ in want if d is not None}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_finds_links_past_a_lead_that_links_with_nothing(frame):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each copy is near the base (id 39) and not near another copy
        w = list(base)
        if i < 39:
            for k in range(3):
                w[(i * 5 + k * 67) % 200] = f"n{i}x{k}"
        rows.append((i, " ".join(w), "s"))
    _, root = jaccard_components(rows, 85)
    for block in (300, near_dedup.BLOCK):
        got = near_dedup.near_duplicates(frame(rows), percent=85, block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == root


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 150), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_id(rows):
    out = {}
    for d, t, _ in rows:
        if d is not None:
            out[d] = (t or "").encode()
    return out


def covered_bytes(texts: dict[int, bytes], window: int) -> dict[int, list[bool]]:
    first, out = {}, {}
    for d in sorted(texts):
        b, own = texts[d], []
        cov = [False] * len(b)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in first:
                cov[p : p + window] = [True] * window
            else:
                own.append(w)
        first.update(dict.fromkeys(own, d))
        out[d] = cov
    return out


def test_substring_dedup_of_bytes(docs, rows, empty):
    texts = by_id(rows)
    cov = covered_bytes(texts, 50)
    want = []
    for d, t, _ in rows:
        b = (t or "").encode()
        c = cov[d] if d is not None else [False] * len(b)
        spans = sum(x and not (i and c[i - 1]) for i, x in enumerate(c))
        want.append((d, len(b), sum(c), spans, sha(bytes(x for x, gone in zip(b, c, strict=True) if not gone))))
    same(suffix_dedup.substring_dedup(docs).collect(), want)
    assert suffix_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_of_words(docs, rows, empty):
    seen, cov = set(), {}
    for d, b in sorted(by_id(rows).items()):
        w = b.split()
        c = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                c[p : p + 20] = [True] * 20
            seen.add(k)
        cov[d] = c
    want = []
    for d, t, _ in rows:
        w = (t or "").encode().split()
        c = cov[d] if d is not None else [False] * len(w)
        want.append((d, len(w), sum(c), sha(b" ".join(x for x, gone in zip(w, c, strict=True) if not gone))))
    same(fm_dedup.window_dedup(docs).collect(), want)
    assert fm_dedup.window_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(set(r)) for r in runs]
    shared = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    lcps = [[0, *(shared(a, b) for a, b in zip(r, r[1:], strict=False))] for r in runs]
    out = list(suffix_dedup.LoserTree(runs, lcps, 6))
    assert [s for _, s, _ in out] == sorted(s for r in runs for s in r)
    assert all(n == shared(a[1], s) for a, (_, s, n) in zip(out, out[1:], strict=False))
    for r in runs:
        if r:
            blob = suffix_dedup.front_coded(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 6))
            assert suffix_dedup.decoded(blob, 6)[0] == r


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=8, max_size=120))
def test_fm_index(text):
    t = np.array([*text, 0], np.int32)
    index = fm_dedup.FMIndex(t, 5)
    q = [(a, b, c) for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)]
    table = np.array(q)
    reached, low, high = index.search(lambda k, i: table[k, i], len(q), 3)
    for k, pattern in enumerate(q):
        places = {n: [p for p in range(len(text) - n + 1) if tuple(text[p : p + n]) == pattern[3 - n :]] for n in (1, 2, 3)}
        n = max((n for n, at in places.items() if len(at) > 1), default=0)
        assert reached[k] == n  # the matching statistic
        if n:
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == places[n]
    assert sorted(index.locate(np.arange(len(t))).tolist()) == list(range(len(t)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding(values, w):
    a = np.array(values)
    if w <= len(a):
        assert passages.sliding(a, w, np.minimum).tolist() == [min(values[i : i + w]) for i in range(len(a) - w + 1)]
    x, y = passages.unpack(passages.pack(a, a.astype(np.uint8)), "i8", "u")
    assert x.tolist() == values and y.tolist() == values


def test_licenses(docs, rows, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect()}
    want = set()
    for d, t, _ in rows:
        w, places, labels = word.findall((t or "").translate(LOWER)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        want.add((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert got == want
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the gnu general public license, version 3.", {"gpl-3"}),
        ("under the gnu lesser general public license v2.1", {"lgpl-2.1"}),
        ("spdx-license-identifier: bsd-3-clause", {"bsd-3-clause"}),
        ("licensed under cc by-nc 4.0 and cc-by-sa-4.0", {"cc-by-nc", "cc-by-sa"}),
        ("see http://opensource.org/licenses/isc.html", {"isc"}),
        ("admitted a licence of mitigation", set()),
        ("", set()),
    ],
)
def test_license_rules(text, labels):
    scanner = licenses.Scanner()
    found = scanner.scan(text)
    assert {x[2] for x in found} == labels
    assert not any(a[0] <= b[0] and b[1] <= a[1] and a != b for a in found for b in found)


def written(tree, rng: random.Random) -> str:
    """A text that a parsed expression matches."""
    out = ""
    for op, x in tree:
        if op is sre.LITERAL:
            out += chr(x)
        elif op is sre.ANY:
            out += rng.choice("ab ")
        elif op is sre.IN:
            kind, y = rng.choice(x)
            if kind is sre.RANGE:
                out += chr(rng.randint(*y))
            else:
                out += chr(y) if kind is sre.LITERAL else rng.choice([" ", "\n", "  ", "\t", "\n * ", "\n# "]) if y is sre.CATEGORY_SPACE else rng.choice("0123456789")
        elif op is sre.BRANCH:
            out += written(rng.choice(x[1]), rng)
        elif op is sre.SUBPATTERN:
            out += written(x[-1], rng)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(written(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
        else:
            assert op is sre.ASSERT_NOT  # no letter or digit beside the match
    return out


def contained(found: list[tuple], rules: list) -> list[tuple]:
    """Suppression by brute force: in order, one that lies in a granted one is dropped."""
    out: list[tuple] = []
    for a, b, i in sorted(found, key=lambda x: (-rules[x[2]][0].priority, x[0] - x[1], x[0], x[2])):
        if not any(c <= a and b <= d for c, d, _ in out):
            out.append((a, b, i))
    return sorted(out)


def test_license_scan_equals_all_rules_without_a_gate():
    scanner, rng = licenses.Scanner(), random.Random(5)
    trees = [re._parser.parse(r.pattern) for r, _ in scanner.rules]
    assert len(scanner.rules) > 300 and all(scanner.need)
    for _ in range(60):
        text = "".join(written(rng.choice(trees), rng) + rng.choice([" ", "\n", ". ", " and "]) for _ in range(rng.randint(1, 25)))
        every = [(m.start(), m.end(), i) for i, (_, p) in enumerate(scanner.rules) for m in p.finditer(text)]
        want = [(a, b, scanner.rules[i][0].label, scanner.rules[i][0].priority) for a, b, i in contained(every, scanner.rules)]
        assert scanner.scan(text) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12), st.integers(0, 40)), max_size=40))
def test_license_suppression(found):
    scanner = licenses.Scanner()
    found = [(a, a + n, i) for a, n, i in dict.fromkeys(found)]
    assert scanner.granted(found) == contained(found, scanner.rules)


def test_license_labels_and_scores(frame):
    """Labels and scores of whole tables against all rules without a gate, base phrases included."""
    scanner, rng = licenses.Scanner(), random.Random(9)
    trees = [re._parser.parse(r.pattern) for r, _ in scanner.rules]
    texts = [written(rng.choice(trees), rng).title() + " under the MIT license" * (k % 3 == 0) + " x" * (k % 50) for k in range(120)] + [None, "", "under the mit license"]
    got = {r.doc_id: (r.labels, r.score, r.detections) for r in licenses.scan_licenses(frame([(k, t, "s") for k, t in enumerate(texts)])).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for k, t in enumerate(texts):
        low = (t or "").translate(LOWER)
        granted = contained([(m.start(), m.end(), i) for i, (_, p) in enumerate(scanner.rules) for m in p.finditer(low)], scanner.rules)
        padded = " " + " ".join(word.findall(low)) + " "
        base = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in padded}
        priorities = [scanner.rules[i][0].priority for *_, i in granted] + [90] * bool(base)
        assert got[k] == (",".join(sorted(base | {scanner.rules[i][0].label for *_, i in granted})), max(priorities, default=0) / 100, len(granted))


def test_licenses_of_a_text_full_of_mentions():
    began, text = time.monotonic(), "licensed under the mit license and " * 200_000
    assert len(licenses.Scanner().scan(text)) == 200_000 and time.monotonic() - began < 30  # linear, not quadratic


def test_license_gate_lets_every_match_pass():
    scanner, rng = licenses.Scanner(), random.Random(3)
    for rule, pattern in scanner.rules:
        tree = re._parser.parse(rule.pattern)
        for _ in range(30):
            text = written(tree, rng)
            assert pattern.search(text), (rule, text)
            gated = set(scanner.matching(scanner.seen(text)))
            assert {i for i, (_, p) in enumerate(scanner.rules) if p.search(text)} <= gated, (rule, text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("placed in the public\ndomain", {"public-domain"}),
        ("under the sil open\nfont license", {"ofl-1.1"}),
        ("gnu general\npublic license, version 3", {"gpl-3"}),
        ("creative  commons\nzero", {"cc0"}),
        ("gnu general\npublic license version 2", {"gpl-2"}),
        ("microsoft\npublic license", {"ms-pl"}),
        ("permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\n * documentation files", {"mit"}),
        ("redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\n# conditions are met", {"bsd"}),
        ("the gnu general public license as published by\nthe free software foundation; either version 2 of the license, or\n(at your option) any later version", {"gpl-2"}),
        ("in accordance with mit license", {"mit"}),
    ],
)
def test_license_rules_across_lines(text, labels):
    assert {x[2] for x in licenses.Scanner().scan(text)} == labels


def test_toxicity(frame, spark, empty):
    rows = [(i, f"plain words about river {i} " * 5 + ("you Idiot scumbag " if i % 4 == 0 else ""), "s") for i in range(600)] + [(None, "idiot", None), (5000, None, "s"), (5001, "", "s"), (5, "plain words", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(frame(rows), labels, unlabelled=300).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1 and next(r.score for r in got if r.doc_id == 5001) < 0.5
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(frame(rows), labels.limit(0)).count() == len(rows)


def test_toxicity_learns_nothing_from_the_held_out_fold(frame, spark):
    rows = [(i, f"word{i % 7} river " + ("bad " if i % 3 == 0 else ""), "s") for i in range(300)]
    true = [(i, int(i % 3 == 0)) for i in range(300)]
    turned = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in true]
    a, b = ({r.doc_id: r.score for r in toxicity.score(frame(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (true, turned))
    assert a == b


def test_media(docs, rows, empty, spark, tmp_path):
    want = []
    for d, t, _ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        stored = media.encode_png(b)
        want.append((d, len(b), len(p), sha(p), zlib.crc32(p[-64:]), len(stored), sha(stored), media.features(p), None))
        assert media.decode_png(stored) == (p, len(b))
    same(media.media_columns(docs).collect(), want)
    assert media.media_columns(empty).count() == 0
    # small ranges, and a damaged member: the others are read
    folder = f"file://{tmp_path}/a"
    n = media.write_archives(docs.coalesce(1), folder, archive_bytes=20_000)
    assert n == len(rows) and media.read_archives(spark, folder, rangeBytes="700", batchBytes="500").count() == n
    path = sorted((tmp_path / "a").glob("*.zip"))[0]
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT") + 6
    data[at] ^= 255
    path.write_bytes(data)
    found = media.read_archives(spark, folder).collect()
    bad = [r for r in found if r.error]
    assert len(found) == n and len(bad) == 1 and bad[0].tries == media.TRIES and bad[0].payload is None
    # what another attempt left behind is not read, and a member that is no picture has its error
    (tmp_path / "a" / "part-0000000-00009-77-left.zip").write_bytes(path.read_bytes())
    assert media.read_archives(spark, folder).count() == n and sum(m for *_, m in media.manifest(folder)) == n
    (tmp_path / "b").mkdir()
    with media.zipfile.ZipFile(tmp_path / "b" / "x.zip", "w") as z:
        z.writestr("7", b"text")
        z.writestr("8", media.encode_png(b"picture")[:-20])
        z.writestr("9", media.encode_png(b"picture"))
    found = media.read_archives(spark, f"file://{tmp_path}/b").select("member", "payload", "error").mapInArrow(media.described, media.COLUMNS).collect()
    assert {r.doc_id: (r.n_bytes, r.error is None) for r in found} == {7: (None, False), 8: (None, False), 9: (7, True)}


def shared_out(sizes: list[tuple[str | None, int]], share: float) -> dict:
    """Targets by brute force: fill up by weight, stop at twice a size, share the excess anew."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weigh = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(order)}
    out, left, open_ = dict.fromkeys(weigh, 0.0), share * sum(n for _, n in sizes), dict(sizes)
    while open_:
        unit = left / sum(weigh[s] for s in open_)
        full = [s for s, n in open_.items() if unit * weigh[s] >= 2 * n]
        for s in full or list(open_):
            out[s] = 2.0 * open_[s] if full else unit * weigh[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize(
    ("sizes", "share"),
    [([("a", 100), ("b", 100), ("c", 100)], 1.5), ([("a", 10), ("b", 0), (None, 10)], 1.5), ([("a", 5)], 3.0), ([(f"s{i}é", i * i % 71) for i in range(40)] + [(None, 9)], 1.5), ([("Z", 7), ("a", 1), ("é", 50), ("\U0001f600", 4), ("\uffee", 3)], 1.2)],
)
def test_mixing_targets(spark, sizes, share):
    got = mixing.targets(spark.createDataFrame(sizes, "source string, size long"), share).collect()
    assert {r.src: r.target for r in got} == pytest.approx(shared_out(sizes, share))
    assert sorted(r.i for r in got) == list(range(len(sizes)))
    assert mixing.targets(spark.createDataFrame([], "source string, size long"), share).count() == 0


def test_mixing_permutes_blocks(spark):
    rows = [(i, s, n) for i, n in enumerate((1, 2, 3, 5, 17, 100, 2500)) for s in range(2 * n)]
    got = mixing.blocks_of(spark.createDataFrame(rows, "i long, slot long, blocks long"), 3).collect()
    passes = defaultdict(list)
    for r in got:
        passes[r.i, r.slot // r.blocks].append((r.slot, r.block))
    for (_, p), found in passes.items():
        n = len(found)
        assert sorted(b for _, b in found) == list(range(n))
        if n > 50:
            assert sum(b == s % n for s, b in found) < 10 and len({(b - s) % n for s, b in found}) > n // 3
            if p:
                first = dict(passes[next(k for k in passes if len(passes[k]) == n and k[1] == 0)])
                assert sum(b == first[s - n] for s, b in found) < 10
    far = [(0, 10**11 - 1 - k * 7, 10**11) for k in range(300)] + [(0, 2 * 10**11 - 1 - k, 10**11) for k in range(300)]
    got = [r.block for r in mixing.blocks_of(spark.createDataFrame(far, "i long, slot long, blocks long"), 3).collect()]
    assert len(got) == 600 and len(set(got)) >= 598 and all(0 <= b < 10**11 for b in got)


def test_mixing_counts_are_those_of_the_drawn_slots(spark, frame):
    rows = [(i, "w " * (1 + i * 13 % 400), None if i % 9 == 0 else f"s{i % 9 // 3}") for i in range(900)]
    docs = frame(rows)
    sources = {r.src: r for r in mixing.targets(docs.select("source", mixing.F.regexp_count("text", mixing.F.lit("w")).cast("long").alias("size")), 1.5).collect()}
    table = [(int(r.i), -(-r.n // 32), round(r.target * -(-r.n // 32) / r.n)) for r in sources.values()]
    slots = mixing._drawn(spark.createDataFrame(table, "i long, blocks long, want long"), mixing.SEED, 64)
    drawn = [(r.i, r.block, r.shard) for r in mixing.blocks_of(slots, mixing.SEED).collect()]
    assert Counter(i for i, _, _ in drawn) == {i: n for i, _, n in table}
    assert max(Counter((i, b) for i, b, _ in drawn).values()) <= 2
    whole = [n for s, n in Counter(s for *_, s in drawn).items()]
    assert sum(n > 40 for n in whole) > len(whole) // 2
    placed, _ = mixing._draw(docs, 1.5, mixing.WEIGHTS, mixing.SEED, 32, 64)
    want = {}
    for r in placed.collect():
        words = Counter(p // 32 for p in range(r["at"], r["to"]))
        hits = [(b, s) for i, b, s in drawn if i == r.i and b in words]
        want[r.doc_id] = sum(words[b] for b, _ in hits), len({s for _, s in hits})
    got = {r.doc_id: (r.taken, r.shards) for r in mixing.mix(docs, block=32, slots=64).collect()}
    assert got == want
    for s, r in sources.items():  # streams of a source have no gap
        spans = sorted((x["at"], x["to"]) for x in placed.collect() if x.source == s)
        assert spans[0][0] == 0 and spans[-1][1] == r.n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_mixing(docs, rows, empty, frame):
    got = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    same([(r.doc_id, r["size"], r.source) for r in got], [(d, size(t), s) for d, t, s in rows])
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix(frame([(1, None, None), (2, "", "a")])).agg({"taken": "sum"}).first()[0] == 0
    many = [(i, "w " * (20 + i % 300), f"s{i % 5}") for i in range(1500)]
    one, two = (mixing.mix(frame(many).repartition(k)).collect() for k in (2, 7))
    same(one, map(tuple, two))  # whatever the partitions
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in one:
        per[r.source][0] += r.taken
        per[r.source][1:] = [r.target, r.source_size]
    for taken, target, n in per.values():
        assert abs(taken - target) <= 0.05 * target + 256 and target <= 2 * n


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [*packing.pack(docs, window=256).withColumn("ids_crc32", mixing.F.crc32("ids")).collect()]
    ids = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t, _ in rows]
    want = Counter((d, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256].tobytes()), len(x)) for d, x in ids for s in range(0, len(x), 256))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) == -(-sum(r.length for r in got) // 256) or len(sequences) <= sum(r.length for r in got) / 256 * 1.05 + 1
    assert sorted(sequences) == list(range(len(sequences))) and packing.pack(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB é'1.<|>\t\n\r\x0b\x0c\x1ć ", max_size=30), max_size=6))
def test_word_ids_are_the_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*texts, "a<|endoftext|>b IT'S"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    ids, at = packing.word_ids(path).encode(offsets, np.frombuffer(b"".join(data), np.uint8))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [w.ids for w in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14))
def test_fill_is_optimal(lengths):
    counts = Counter(lengths)
    need = packing.fill(dict(counts), 40)
    best = {max(lengths)}
    rest = sorted(lengths)[:-1]
    for x in rest:
        best |= {b + x for b in best if b + x <= 40}
    assert sum(k * n for k, n in need.items()) == max(best) and all(n <= counts[k] for k, n in need.items())
    entries = packing.plan(dict(counts), 40)
    assert sum(len(v) > 0 for v in entries.values()) == len(counts)
