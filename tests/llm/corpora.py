"""Small corpora with every odd case, shared by the tests."""

import random

#: A table with columns that clash with names used inside the operators.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "_text string, key string, size string, hash string, kept string, shard string, _id string, owner string, class string"
)
CLASHES = ("x",) * 9


def frame(spark, rows):
    """Rows of ``doc_id, text[, lang, source]`` as a documents table with clashing columns."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), *CLASHES) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


ODD = [
    (None, "a b c"), (None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "a\tb  c"),
    (6, "a b c"), (7, "É   日本語 \U0001f600"), (8, None, None, None), (9, "x" * 5000), (10, "w " * 3000), (10, "other text"),
]


def prose(seed, n, words=60, vocabulary=400):
    """``n`` texts of random words; some are copies, near copies, or share a passage."""
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(word) for _ in range(70)]
    texts = []
    for i in range(n):
        text = [rng.choice(word) for _ in range(rng.randrange(1, 2 * words))]
        if i % 5 == 1 and texts:
            text = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(word)
        if i % 7 == 2:
            at = rng.randrange(len(text))
            text = text[:at] + passage[rng.randrange(8) :] + text[at:]
        texts.append(" ".join(text))
    return texts
