import re
from collections import Counter

import corpus_pipeline as P

from . import rows as R
from .test_ngram_join import grams


def test_stages_keep_columns(spark):
    docs = R.awkward(spark)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == R.awkward(spark).columns
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count() > 0


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.n_tokens == len(r.ids) for r in got)


def test_empty_tables(spark):
    for _, stage in P.STAGES:
        assert stage(spark, R.empty(spark), "").count() == 0


def brute(docs):
    """What stays of (doc_id, text) before the mix, by plain comparison of all pairs."""
    docs = [(i, t) for i, t in docs if any(map(str.isalpha, t or ""))]
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    docs = list(first.values())
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [d for k, d in enumerate(docs) if find(k) == k]


def test_stages_keep_what_a_plain_pass_keeps(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, rows[0][1], "en", "s", 1), (9001, None, "en", "s", None), (9002, "12 34 ...", None, None, 9), (9003, rows[1][1] + "\n", "en", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, "")
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=str) == sorted(brute([(r[0], r[1]) for r in rows]), key=str)


def test_mix_takes_whole_documents_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    taken = Counter(r.doc_id for r in P.mixed(spark, docs, "").collect())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), 1.5 * sum(total.values())
    while free:  # clamp and share again until none is above
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2 * total[s] for s in over}
        rest -= sum(2 * total[s] for s in over)
        free -= over
    for s in sources:
        words = sum(taken[r.doc_id] * size[r.doc_id] for r in rows if r.source == s)
        assert abs(words - target[s]) <= max(size[r.doc_id] for r in rows if r.source == s)
    assert max(taken.values()) <= 2
