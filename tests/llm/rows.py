"""Rows with the cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, node string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(n)]


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:40], *words(rng, 80)]
    long = words(rng, 30_000)
    texts = [
        (1, " ".join(base)), (2, "\t\n".join(base)), (3, " ".join(near)), (4, " ".join(far)), (4, " ".join(far)), (4, " ".join(far)),
        (5, None), (6, ""), (7, "  \n"), (None, " ".join(base)), (None, None), (8, "zwölf Boxkämpfer jagen"), (9, "zwölf Boxkämpfer jagen"),
        (10, " ".join(long)), (11, " ".join([*long, "end"])), (12, "1234 !!"), (13, "x" * 50_000), (14, "a@b.co " * 3),
        (15, "one two three"), (16, "one  two three "), (17, "\x1c odd\x85space　"),
    ]
    langs, sources = ["en", None, "de"], ["s1", None, "s2", "s3"]
    rows = [
        (i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k % 2 == 0, k, "n")
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
