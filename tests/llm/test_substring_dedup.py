import random
import re

from loomline.llm import substring_dedup as D

from . import rows as R
from .test_ngram_join import grams, near_copies


def brute(docs, least=50):
    """Rows by comparing all paragraphs."""
    paras = []
    for i, t in docs:
        start = 0
        for k, line in enumerate((t or "").split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= least:
                paras.append((i, k, start, start + len(line), grams(line)))
            start += len(line) + 1
    root = list(range(len(paras)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(paras)):
        for b in range(a):
            x, y = paras[a][4], paras[b][4]
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(paras)):
        groups.setdefault(find(a), []).append(a)
    out = []
    for g in groups.values():
        if len(g) > 1:
            first = min(((paras[a][0] is None, paras[a][0] or 0, paras[a][1]) for a in g))
            keep = (None if first[0] else first[1], first[2])
            out += [(*paras[a][:4], *keep, len(g), (paras[a][0], paras[a][1]) != keep) for a in g]
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    shared = near_copies(rng, 12, 70, 1) + near_copies(rng, 5, 60, 0)
    docs = []
    for i in range(40):
        lines = [" ".join(R.words(rng, rng.randint(3, 90))) for _ in range(rng.randint(1, 5))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(50, docs[0][1] + "\n" + docs[0][1]), (None, docs[1][1]), (51, None), (52, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, D.repeated_paragraphs(df).collect()), key=str) == brute(docs)
    cut = {r.doc_id: r.text for r in D.remove_repeats(df).collect()}
    gone = {(x[0], x[1]) for x in brute(docs) if x[7]}
    for i, t in docs:
        want = None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone)
        assert cut[i] == want


def test_awkward_and_empty(spark):
    df = R.awkward(spark)
    got = D.repeated_paragraphs(df).collect()
    assert {r.doc_id for r in got if r.class_id == 10} == {10, 11}
    assert D.remove_repeats(df).columns == df.columns
    assert D.repeated_paragraphs(R.empty(spark)).count() == 0 and D.remove_repeats(R.empty(spark)).count() == 0


def test_driver_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, D.repeated_paragraphs(df).collect()), key=str) == brute(docs)


def windows_twice(docs, n=50):
    """{(row, first word)} of the windows of n words that are in two places."""
    at = {}
    for k, (_, t) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), []).append((k, i))
    return {x for places in at.values() if len(places) > 1 for x in places}


def check_passages(docs, found):
    """All rows repeat word for word, and no window of 50 words that repeats is without a row.

    Returns the share of the windows' words that rows cover."""
    every = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    joined = [" " + " ".join(w) + " " for w in every]
    windows = windows_twice(docs)
    have = want = 0
    for k, (i, t) in enumerate(docs):
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        spans = []
        for r in {(r.start, r.end, r.para) for r in found if r.doc_id == i}:
            inside = [j for j, (a, b) in enumerate(words) if r[0] <= a and b <= r[1]]
            assert (words[inside[0]][0], words[inside[-1]][1]) == r[:2] and t.count("\n", 0, r[0]) == r[2] and len(inside) >= 25
            text = " " + " ".join(every[k][inside[0] : inside[-1] + 1]) + " "
            places = sum(len(re.findall(f"(?={re.escape(text)})", x)) for x in joined if text in x)
            assert places > 1
            spans.append(set(inside))
        mine = {j for row, j in windows if row == k}
        for j in mine:
            assert any(len(s & set(range(j, j + 50))) >= 25 for s in spans)
        need = {x for j in mine for x in range(j, j + 50)}
        want += len(need)
        have += len(need & set().union(*spans)) if spans else 0
    return have / want


def test_passages_in_and_across_lines(spark):
    rng = random.Random(9)
    shared = [R.words(rng, n) for n in (49, 50, 51, 64, 90)]
    docs = []
    for i in range(40):
        w = R.words(rng, rng.randint(20, 120))
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((i, "".join(x + rng.choice(("\n", " ", " ", " ", "  ")) for x in w)))
    docs += [(90, " ".join(shared[3] + ["mid"] + shared[3])), (91, None), (92, ""), (None, docs[0][1])]
    df = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string")
    got = D.repeated_passages(df).collect()
    assert check_passages(docs, got) >= 0.97
    assert {r.removed for r in got if r.doc_id == 90} == {True}
    assert len({(r.doc_id, r.start, r.end, r.class_id, r.class_para) for r in got}) == len(got)
    assert D.repeated_passages(R.empty(spark)).count() == 0 and D.repeats(R.awkward(spark)).count() > 0


def test_all_lengths_of_driver_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = D.repeats(df, min_words=5).collect()
    paras = sorted((tuple(r)[:-1] for r in got if r.kind == "paragraph"), key=str)
    assert paras == brute(docs, 5)
    assert check_passages(docs, [r for r in got if r.kind == "passage"]) >= 0.97


def test_short_paragraphs(spark):
    rng = random.Random(10)
    lines = [x for n in (5, 8, 14, 30, 49, 95, 101, 120) for x in near_copies(rng, 6, n, 1)]
    lines += [" ".join(R.words(rng, n)) for n in (1, 4, 4, 6, 20)] + ["one two three four", "one two three four"]
    docs = [(i, "\n".join(rng.sample(lines, 3))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, D.repeated_paragraphs(df, min_words=5).collect()), key=str) == brute(docs, 5)
