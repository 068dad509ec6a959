"""The exact join against brute force, on tables with near copies, chains, size limits and large regions."""

import random

import brute
import numpy as np
import pytest

from lattica.llm import graph, jaccard


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.4:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: int(len(words) * rng.uniform(0.85, 1))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 6, 9, 10, 12, 20, 40, 120]))]
            if kind > 0.7:
                words = passage + words
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "slab"), [(4, 85, 256), (5, 80, 256), (4, 85, 3)])
def test_components(spark, monkeypatch, k, percent, slab):
    monkeypatch.setattr(jaccard, "SLAB", slab)
    rows = texts(k * percent, 250)
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(rows, k, percent)


def test_links_share_regions():
    rng = np.random.default_rng(3)
    
    for _ in range(3000):
        n = int(rng.integers(6, 90))
        total = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a = np.unique(total[:n])
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.85, 1))], total[n : n + int(rng.integers(0, 2 + n // 10))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            shared = np.intersect1d(jaccard.region_keys(a, 85), jaccard.region_keys(b, 85))
            assert len(shared)


def test_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{x: 1 for x in range(1, 60)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
