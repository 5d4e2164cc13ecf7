import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import ngram_join as J
from loomline.llm.graph import components

from . import rows as R


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """{row: (class_id, n_links)} by comparing all rows."""
    sets = [grams(t) for _, t in docs]
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs]
    n = len(docs)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if words[i] == words[j] or (both and both >= 0.8 * (len(a) + len(b) - both)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r, d = find(i), docs[i][0]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(least[find(i)], links[i]) for i in range(n)]


def compare(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = J.ngram_join(df).collect()
    key = lambda r: str(r)
    want = sorted([(docs[i][0], *x) for i, x in enumerate(brute(docs))], key=key)
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=key) == want


def near_copies(rng, n, length=150, changes=2):
    base = R.words(rng, length)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = R.words(rng, 1)[0]
        out.append(" ".join(w))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 60) + near_copies(rng, 7, 400, 6) + [" ".join(R.words(rng, 50)) for _ in range(30)]
    texts += texts[:20] + [texts[3]] * 10
    rng.shuffle(texts)
    compare(spark, [(i * 3, t) for i, t in enumerate(texts)])


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    texts = near_copies(rng, 90, 80, 1) + near_copies(rng, 30, 100, 3)
    monkeypatch.setattr(J, "BLOCK_CLASSES", 20)
    compare(spark, list(enumerate(texts)))


def test_awkward_rows(spark):
    df = R.awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.ngram_join(df).collect()), key=str)
    assert got == sorted([(docs[i][0], *x) for i, x in enumerate(brute(docs))], key=str)
    kept = J.keep_first_of_near(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({1: 1, 4: 3, 5: 1, 8: 1, 10: 1, 12: 1, 13: 1, 14: 1, 15: 1, 17: 1})


def test_empty(spark):
    assert J.ngram_join(R.empty(spark)).count() == 0
    assert J.keep_first_of_near(R.empty(spark)).count() == 0


def test_driver_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(spark, [(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("m", [2, 3, 40, 200])
def test_intersections(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(m)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (J.intersections(sets) == np.array(want)).all()


def test_bands_reach_recall():
    assert J.BANDS >= J.bands_for(J.ROWS)
    rng = random.Random(1)
    band, found = J.Bander(), 0
    for _ in range(300):
        common, own = [rng.getrandbits(64) for _ in range(160)], [[rng.getrandbits(64) for _ in range(20)] for _ in "ab"]
        a, b = (set(band(np.unique(np.array(common + x, np.uint64)))) for x in own)  # similarity 0.8
        found += bool(a & b)
    assert found >= 298


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(500, 500)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
