"""Exact, substring and near duplicates against brute force."""

import functools
import hashlib
import random
import re
import tracemalloc
import weakref

import numpy as np
import pytest
from corpora import ODD, frame, prose

from codecat.llm import components, exact_dedup, ngram_join, sharing, substring_dedup
from codecat.llm import words as words_module
from codecat.llm.words import inside_text, slices, windows, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    return ODD + [(100 + i, t) for i, t in enumerate(prose(1, 120))]


# -- words -----------------------------------------------------------------


@pytest.mark.parametrize("texts", [[], [""], [None, "a"], ["a b", "", " c\x0bd ", "é日 x", "\x1fq\x85r"], [" "] * 3])
def test_words_of_texts(texts):
    import pyarrow as pa

    found = words_of(pa.array(texts, pa.string()))
    text = bytes(found.data)
    cut = [text[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert [cut[a:b] for a, b in zip(found.first, found.first[1:])] == [words(t) for t in texts]


def test_hashes_tell_words_and_order_apart():
    import pyarrow as pa

    found = words_of(pa.array(["a b c a b d", "ab c A b c"]))
    plain, folded = found.hashes(), found.hashes(lower=True)
    assert plain[0] == plain[3] and plain[8] != plain[0] and folded[8] == folded[0]
    pairs = windows(plain, 2, seed=1)[inside_text(found.first, 2)]
    assert pairs[0] == pairs[3] and pairs[1] == pairs[8] and len(set(pairs.tolist())) == len(pairs) - 2


# -- exact -----------------------------------------------------------------


def test_exact_duplicates(spark, corpus):
    groups = {}
    for doc_id, text in (r[:2] for r in corpus):
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(normal, []).append(doc_id)
    expected = []
    for normal, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(normal.encode()).hexdigest()
        kept = False
        for doc_id in ids:
            mine = doc_id == keep and not kept
            kept |= mine
            expected.append((doc_id, keep, len(ids), mine, digest))
    found = exact_dedup.exact_duplicates(frame(spark, corpus), digest_all=True, prefix=5)
    assert rows_of(found) == sorted(expected, key=repr)
    lazy = exact_dedup.exact_duplicates(frame(spark, corpus))
    lazy = lazy.collect()
    assert all(r["text_sha256"] is not None for r in lazy if r["group_size"] > 1)
    assert any(r["text_sha256"] is None for r in lazy)
    left = exact_dedup.drop_exact_duplicates(frame(spark, corpus))
    assert left.columns == frame(spark, corpus).columns
    assert sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(repr(e[0]) for e in expected if e[3])


def test_few_texts_move_to_many_ids(spark, corpus, monkeypatch):
    """Dropped ids too many to broadcast: only rows that a filter marks are shuffled, and the outcome is the same."""
    def kept():
        return sorted(repr(tuple(r)) for r in exact_dedup.drop_exact_duplicates(docs).collect())

    rows = [(i, f"alone {i}") for i in range(300)] + [(1000 + i, f"twice {i % 20}") for i in range(40)]
    rows += [(None, "twice 1"), (None, "null ids"), (None, "null ids"), (7, "alone 7"), (7, None), (8, "")]
    for docs in (frame(spark, rows), frame(spark, corpus)):
        monkeypatch.setattr(exact_dedup, "fits_broadcast", lambda df: True)
        expected, seen = kept(), []
        monkeypatch.setattr(exact_dedup, "fits_broadcast", lambda df: False)
        with monkeypatch.context() as patch:
            patch.setattr(exact_dedup, "marked", lambda *args, f=exact_dedup.marked: seen.append(f(*args)) or seen[-1])
            assert kept() == expected
        assert len(seen) == 1
        if docs.count() == len(rows):
            assert 20 <= seen[0].where("_likely").count() <= 60


def test_exact_duplicates_of_nothing(spark):
    assert rows_of(exact_dedup.exact_duplicates(frame(spark, []))) == []
    assert rows_of(exact_dedup.drop_exact_duplicates(frame(spark, []))) == []


# -- substrings ------------------------------------------------------------


def brute_substrings(rows):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - 49 if doc_id is not None else 0):
            window = tuple(w[i : i + 50])
            first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - 49 if doc_id is not None else 0):
            if first[tuple(w[i : i + 50])] < doc_id:
                gone |= set(range(i, i + 50))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark, corpus):
    rng = random.Random(3)
    more = [(300 + i, " ".join(["q"] * rng.randrange(45, 120))) for i in range(6)]
    more += [(310, "p " * 60 + prose(2, 1, 200)[0]), (310, prose(2, 1, 200)[0]), (311, prose(2, 1, 200)[0])]
    rows = [r[:2] for r in corpus] + more
    found = rows_of(substring_dedup.remove_repeats(frame(spark, rows)))
    assert found == brute_substrings(rows)
    assert sum(r[2] for r in found) > 500
    assert rows_of(substring_dedup.remove_repeats(frame(spark, []))) == []


def test_every_shift_has_an_anchor():
    """The cover meets the definition: for any two alignments, a shift puts both on it."""
    cover, v = set(substring_dedup.COVER), substring_dedup.PERIOD
    assert all(any((a + s) % v in cover and (b + s) % v in cover for s in range(v)) for a in range(v) for b in range(v))


# -- shared keys -----------------------------------------------------------


def test_shared_and_later_keys(spark, monkeypatch):
    monkeypatch.setattr(sharing, "_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    key = rng.zipf(1.5, 900).clip(max=60).astype(np.uint64)
    owner, place = rng.integers(0, 25, 900), np.arange(900)
    cuts = [0, 250, 600, 900]
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
    owners = {}
    for k, o in zip(key.tolist(), owner.tolist()):
        owners.setdefault(k, set()).add(o)

    def frame_of(combine, **options):
        rows = [r for p in parts for b in combine(key[p], owner[p], place[p], **options) for r in b.to_pylist()]
        schema = sharing.KEYED_SCHEMA if options else sharing.SCHEMA
        return spark.createDataFrame([tuple(r.values()) for r in rows], schema)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = rows_of(sharing.shared(frame_of(sharing.combined_shared)))
        keyed = rows_of(sharing.shared(frame_of(sharing.combined_shared, with_key=True), with_key=True))
        after = rows_of(sharing.later(frame_of(sharing.combined_later)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = list(zip(key.tolist(), owner.tolist(), place.tolist()))
    assert found == sorted(((o, p) for k, o, p in rows if len(owners[k]) > 1), key=repr)
    assert keyed == sorted(((k, o, p) for k, o, p in rows if len(owners[k]) > 1), key=repr)
    assert after == sorted(((o, p) for k, o, p in rows if o > min(owners[k])), key=repr)


# -- near duplicates -------------------------------------------------------


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60)])
def test_near_duplicates(spark, corpus, width, percent):
    rows = [r[:2] for r in corpus]
    base = prose(9, 3, 200)
    rows += [(500 + i, t) for i, t in enumerate(base)]
    for i in range(60):  # a large group of near copies
        w = base[0].split()
        w[(7 * i) % len(w)] = f"edit{i}"
        rows.append((600 + i, " ".join(w).upper() if i % 3 else " ".join(w)))
    sets = [(d, shingles(t, width)) for d, t in rows]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    least = brute_components({d for d, _ in rows if d is not None}, links)
    found = rows_of(ngram_join.near_duplicates(frame(spark, rows), width, percent))
    # Rows that share an id are one document with several sets; those report the component of their own set.
    plain = [(d, len(s), None if d is None else least[d]) for d, s in sets if d != 10]
    assert [r for r in found if r[0] != 10] == sorted(plain, key=repr)
    assert len({r[2] for r in found if r[0] is not None and r[0] >= 600}) < 61
    left = ngram_join.drop_near_duplicates(frame(spark, rows), width, percent)
    assert {r["doc_id"] for r in left.collect()} - {None, 10} == {c for d, c in least.items() if d != 10} - {10}


def test_a_far_copy_does_not_lead_a_hot_group(spark, monkeypatch):
    """A copy with three edits has no prefix token of its own, since another one was made from it; it is far from most others."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**9)}" for _ in range(150)]

    def edited(w, *places):
        return [f"{w[i]}e{rng.randrange(10**9)}" if i in places else w[i] for i in range(len(w))]

    copies = [edited(base, *rng.sample(range(5, 145), 1 + (i % 10 == 0))) for i in range(80)]
    far = edited(base, 30, 70, 110)
    rows = [(i, " ".join(w)) for i, w in enumerate([*copies, far, edited(far, 130)])]
    made, write = [], ngram_join.staged

    def staged(df, label, *more, **named):
        out = write(df, label, *more, **named)
        made.extend([out.count()] if label in ("led", "apart", "rest") else [])
        return out

    monkeypatch.setattr(ngram_join, "staged", staged)
    found = rows_of(ngram_join.near_duplicates(frame(spark, rows), 5, 80))
    sets = [(d, shingles(t, 5)) for d, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets[:a] if 100 * len(x & y) >= 80 * len(x | y)]
    least = brute_components(range(len(rows)), links)
    assert found == sorted(((d, len(s), least[d]) for d, s in sets), key=repr)
    assert sum(made) < 5 * len(rows)


def test_no_near_duplicates(spark):
    assert rows_of(ngram_join.near_duplicates(frame(spark, []))) == []
    assert rows_of(ngram_join.near_duplicates(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2000, 2001)]
    nodes = {n for e in edges for n in e}
    expected = {n: c for n, c in brute_components(nodes, edges).items() if n != c}
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_drop_no_similar_pair(spark):
    rng = random.Random(5)
    base = [str(rng.random()) for _ in range(300)]
    rows = [(i, " ".join(str(rng.random()) if rng.random() < i / 200 else w for w in base)) for i in range(40)]
    rows += [(40, "x " * 70_000 + " ".join(base)), (41, " ".join(base + base[:9]))]
    import pyarrow as pa

    text, token, size = ngram_join.token_sets(words_of(pa.array([t for _, t in rows])), 3)
    sets = [set(token[text == i].tolist()) for i in range(len(rows))]
    classes = ngram_join.set_classes(text, token, size).tolist()
    docs = frame(spark, rows).selectExpr("doc_id _id", "text _text")
    wanted = spark.createDataFrame([(classes[i], i) for i in range(42) if i != 39], "class long, _id long")
    pairs = [(i, j) for i in range(42) for j in range(i)]
    given = spark.createDataFrame([(classes[i], classes[j]) for i, j in pairs], "a long, b long")
    left = ngram_join.not_refuted(given, ngram_join.sketches_of(docs, wanted, 3), 80)
    left = {(r["a"], r["b"]) for r in left.collect()}
    similar = {(classes[i], classes[j]) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    unknown = {(classes[i], classes[j]) for i, j in pairs if 39 in (i, j)}
    assert similar and similar | unknown <= left and len(left) < len(pairs) / 2


def keyed(texts, rows=1):
    """What :func:`ngram_join.set_keys` makes of ``texts``, in batches as Spark hands them on."""
    import pyarrow as pa

    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["_id", "_text"])
    parts = (batch.slice(a, -(-len(texts) // rows)) for a in range(0, len(texts), -(-len(texts) // rows)))
    ranks = np.zeros((ngram_join.ORDERS, 1 << ngram_join.SKETCH_BITS), np.uint16)
    return ngram_join.set_keys(5, 80, ranks)(parts)


def test_memory_of_prefix_tokens_is_bounded_whatever_the_size_of_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 40_000, raising=False)
    monkeypatch.setattr(ngram_join, "slices", functools.partial(slices, most=200_000))
    rng = random.Random(3)
    few = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(400)]

    def peak(texts):
        tracemalloc.start()
        try:
            for _ in keyed(texts):
                pass
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    many = [" ".join(reversed(t.split())) + f" {i}" for i in range(4) for t in few]
    peak(few[:2])  # imports
    assert peak(many) < 1.5 * peak(few)


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_tokens_of_small_blocks(monkeypatch, parts):
    texts = [row[1] for row in ODD] + prose(2, 150)

    def found():
        rows = {}
        for batch in keyed(texts, parts):
            for key, owner, place, known, own_key in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault((own_key if known == sharing.PASSED else key, owner, place), set()).add(known)
        return rows

    whole = found()
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(ngram_join, "slices", functools.partial(slices, most=500))
    small = found()
    assert small.keys() == whole.keys()
    assert small != whole


def test_memory_is_given_back_when_nothing_is_held(monkeypatch):
    class Held:
        pass

    held, seen = [], []

    def read(parts):
        mine = Held()
        held.append(weakref.ref(mine))
        yield from parts

    monkeypatch.setattr(words_module, "give_back", lambda: seen.append(held[0]() is None))
    assert list(words_module.giving_back(read)(iter([1, 2]))) == [1, 2]
    assert seen == [True]
