from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, link string, id long, component long, row long, n long, values string, spans string"


def words(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(["the", "of", "thing", "Éa", "on", "blue", "river", "stone", "x", "idea", "MIT", "ñu"]) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 3, 8, 40, 120])) for _ in range(n)]
    passage = words(rng, 60)
    rows = []
    for i, t in enumerate(texts):
        kind = i % 10
        if kind == 1:
            t = texts[i - 1]
        elif kind == 2:
            t = passage[: rng.randint(60, len(passage))] + t
        elif kind == 3:
            t = t + " under the MIT\nLicense " + passage
        elif kind == 4:
            parts = texts[i - 1].split(" ")
            parts[len(parts) // 2] = "changed"
            t = " ".join(parts)
        elif kind == 5:
            t = texts[i - 5].replace(" ", " \n")
        rows.append((i * 3, t, f"s{i % 4}" if i % 7 else None))
    rows += [(1000, None, "s1"), (1001, "", "s2"), (1002, "   \n", None), (1003, words(rng, 30_000), "s1"), (1004, "a" * 300, "s3"), (1005, "a" * 300, "s3"), (None, texts[0], "s1"), (None, None, None)]
    rows += [rows[5], rows[5], rows[2]]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session", params=[1, 2])
def rows(request):
    return corpus(request.param)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows: list[tuple]):
        full = [(d, t, "en", s, len(t or ""), 0.5, 3, "x", 7, 8, 9, 10, "v", "s") for d, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(5) if full else df

    return make


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
