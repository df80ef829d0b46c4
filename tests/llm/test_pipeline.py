from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from loomspark.llm import mixing
from test_operators import SPACE, WORD, jaccard_components


def exact_kept(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text, source) rows that stay, by brute force."""
    least: dict[str, int] = {}
    for d, t, _ in rows:
        if d is not None:
            n = SPACE.sub(" ", t or "")
            least[n] = min(d, least.get(n, d))
    out, seen = [], set()
    for d, t, s in rows:
        n = SPACE.sub(" ", t or "")
        if d is None or (d == least[n] and (d, n) not in seen):
            out.append((d, n))
            seen.add((d, n))
    return out


def near_kept(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text) rows that stay; rows take part singly."""
    own = {k: (k, t, s) for k, (d, t, s) in enumerate(rows) if d is not None}
    _, root = jaccard_components(list(own.values()), 80)
    groups = defaultdict(list)
    for k in own:
        groups[root[k]].append(k)
    return groups


def run_stages(spark, docs, folder):
    """Rows before and after each stage but the last, as tuples."""
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, now, folder)
        assert after.columns == now.columns
        after.write.parquet(f"{folder}/{k}")
        old = [(r.doc_id, r.text, r.source) for r in now.collect()]
        now = spark.read.parquet(f"{folder}/{k}")
        out[name] = old, [(r.doc_id, r.text, r.source) for r in now.collect()]
    return out, now


def test_stages(frame, rows, spark, tmp_path):
    rng = random.Random(4)
    # toxic rows, and rows that repeat a doc_id with other texts
    toxic = [(20_000 + i, " ".join(rng.choice(["river", "stone", "idea", "blue", f"w{i}"]) for _ in range(30)) + (" idiot scumbag" if i % 3 == 0 else ""), "s1") for i in range(400)]
    twice = [(3, f"something else entirely of row {k} that no other row says " * 3, "s2") for k in range(2)] + [(6, toxic[4][1], "s0")]
    rows = [*rows, *toxic, *twice]
    docs = frame(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1 if i % 3 == 0 else 0) for i, (d, _, _) in enumerate(toxic)] + [(d, 0) for d, _, _ in rows[:40] if d is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    found, last = run_stages(spark, docs, d)

    old, kept = found["toxicity"]
    assert sorted(kept, key=str) == sorted((r for r in old if "scumbag" not in (r[1] or "")), key=str)
    old, kept = found["exact_dedup"]
    assert sorted(((i, SPACE.sub(" ", t or "")) for i, t, _ in kept), key=str) == sorted(exact_kept(old), key=str)
    assert sum(i == 3 for i, _, _ in kept) >= 2  # texts that only share their doc_id
    old, kept = found["near_dedup"]
    groups, left = near_kept(old), Counter((i, t) for i, t, _ in kept)
    assert sum(left.values()) == len(groups) + sum(i is None for i, _, _ in old)
    for members in groups.values():  # one of each group, that with the smallest doc_id where ids tell
        stay = [k for k in members if left[old[k][0], old[k][1]]]
        ids = Counter(old[k][0] for k in members)
        assert len({old[k][:2] for k in stay}) == 1
        if all(n == 1 for n in ids.values()) and not any(sum(r[0] == i for r in old) > 1 for i in ids):
            assert old[stay[0]][0] == min(ids)
    old, kept = found["mixing"]
    words = lambda t: len(WORD.findall(t or ""))
    got, took = Counter(), Counter()
    for i, t, _ in kept:
        got[i] += words(t)
    for r in mixing.mix(spark.read.parquet(f"{d}/2")).collect():
        took[r.doc_id] += r.taken
    assert got == took and {(i, t) for i, t, _ in old if not words(t)} <= {(i, t) for i, t, _ in kept}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, last, d).collect(), kept)
    pieces = corpus_pipeline.run(spark, d)
    assert pieces.count() == corpus_pipeline.STAGES[-1][1](spark, last, d).count()


def check_packing(pieces, rows: list[tuple]) -> None:
    """Pieces hold each row's ids once, in sequences without gaps that are at most a window long."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((d, s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048))
    assert Counter((p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces) == want
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_tables(frame, spark, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_mixing_emits_the_words_it_draws(frame, spark):
    docs = {"s0": 60, "s1": 90, "s2": 39, "s3": 60, "s4": 12, "s5": 39}  # s1 is large and of small weight
    rows = [(n, s) for s, k in docs.items() for n in range(k)]
    rows = [(i, " \n" * (i % 3) + "".join(f"d{i}w{n}" + ("  " if n % 7 else "\n") for n in range(1500)), s) for i, (_, s) in enumerate(rows)]
    rows += [(None, " ".join(f"null{k}w{n}" for n in range(300)), "s1") for k in range(2)] + [(9000, None, "s0"), (9001, "  ", "s0")]
    table = frame(rows)
    out = corpus_pipeline.mix_sources(spark, table, "").collect()
    by_doc, by_source, texts = Counter(), Counter(), defaultdict(list)
    for i, t, s in rows:
        texts[i].append(t)
    for r in out:
        n = len((r.text or "").split())
        by_doc[r.doc_id] += n
        by_source[r.source] += n
        assert any(r.text is t or (r.text or "") in (t or "") for t in texts[r.doc_id])
        assert r.n_chars == len(r.text or "")
    took, goal = Counter(), {}
    for r in mixing.mix(table).collect():
        took[r.doc_id] += r.taken
        goal[r.source] = r.target
    assert by_doc == took and sum(r.doc_id in (9000, 9001) for r in out) == 2
    assert all(abs(by_source[s] - x) <= 0.05 * x + 256 for s, x in goal.items()), (by_source, goal)
    assert corpus_pipeline.mix_sources(spark, frame(rows[-2:]), "").count() == 2 and corpus_pipeline.mix_sources(spark, frame([]), "").count() == 0
