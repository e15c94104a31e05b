"""The vocabulary of topics: the same terms whatever the cells are, and rare pairs are not counted by name."""

import random
from collections import Counter

import numpy as np

from newsloom.operators import svd, topics


def test_vocabulary_by_cells(spark, monkeypatch):
    r = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    texts = [r.choices(names, weights=[30 - i for i in range(30)], k=r.randint(0, 15)) for _ in range(80)]
    grams = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in texts]
    tf, df = Counter(g for t in grams for g in t), Counter(g for t in grams for g in set(t))
    found = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "k int, grams array<string>")
    made, real = [], topics.written
    monkeypatch.setattr(topics, "written", lambda d, label: made.append(label) or real(d, label))
    for most in (3, 20, 1000):
        first = sorted((g for g in tf if df[g] >= 2), key=lambda g: (-tf[g], g))[:most]
        want = [(g, df[g], i) for i, g in enumerate(sorted(first))]
        for cells in (1, 7, 1 << 20):
            made.clear()
            assert [tuple(x) for x in topics.vocabulary(found, most, cells=cells).orderBy("place").collect()] == want
            assert ("topic-cells" in made) == (most < 1000)


def test_blocks_are_multiplied_packed(monkeypatch):
    """A block over its own columns, or by sums of its entries where that would be large: the same product."""
    r = np.random.default_rng(1)
    columns, row, values = r.integers(0, 50, 200), np.sort(r.integers(0, 20, 200)), r.standard_normal(200)
    q, x = r.standard_normal((50, 4)), np.zeros((20, 50))
    np.add.at(x, (row, columns), values)
    for cells in (1 << 21, 10):
        monkeypatch.setattr(svd, "CELLS", cells)
        assert (svd._packed(columns, values, row, 20) is None) == (cells == 10)
        got = np.zeros((50, 4))
        of, sums = svd._gram(columns, values, row, 20, q)
        got[of] += sums
        assert np.allclose(got, x.T @ (x @ q))
