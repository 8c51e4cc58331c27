"""Token records, periodic runs and the conversation trie against brute force."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from corpora import ODD, frame, prose
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from codecat.llm import periodic_runs, prefix_trie, queries, token_records
from codecat.llm.words import words_of

SF_DIR = "/root/testdata/sf0.001"


# -- token records ---------------------------------------------------------


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    data = b"123456789" + rng.randbytes(3000)
    starts = [0, *(rng.randrange(2000) for _ in range(60))]
    sizes = [9, *(rng.choice([4, 5, 7, 8, 9, 15, 16, 17, rng.randrange(4, 900)]) for _ in range(60))]
    found = token_records.crc32c(np.frombuffer(data, np.uint8), np.array(starts), np.array(sizes))
    assert found[0] == 0xE3069283
    assert found.tolist() == [slow_crc32c(data[a : a + n]) for a, n in zip(starts, sizes)]
    same = token_records.crc32c(np.frombuffer(data, np.uint8), np.array(starts), np.full(61, 8))
    assert same.tolist() == [slow_crc32c(data[a : a + 8]) for a in starts]


TEXTS = [
    "", " \n", "Ab. AB ab, x,, y.. (z) -!", "a<|endoftext|>. b <|ENDOFTEXT|> <|startoftext|>", "H̱i. ẖI H̱I H̱i,", "it's O'Neil's don't. 'S 's.",
    "3.5 1,000. v2. İ. Σας. ΣΑΣ é. É, a b　c.", "日本語。 😀, ||. a|. |.", "é. É, ́x \x00 \x07.", "×. ÷. ÿ. ß, ÀÉ.",
]


@pytest.mark.parametrize("model", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(model):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices(" ".join(TEXTS).split(" "), k=40)) for _ in range(60)]
    texts += pq.read_table(f"{SF_DIR}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    encoder = token_records.Encoder(f"/opt/tokenizers/{model}")
    assert encoder.by_word == model.startswith("word")
    for _ in range(2):  # the second time the words are known
        ids, first = encoder.ids(pa.array([*texts, None], pa.string()))
        for text, a, b in zip([*texts, ""], first, first[1:]):
            assert ids[a:b].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_forgotten_words_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([" ".join(f"w{rng.randrange(500)}a" for _ in range(300)) for _ in range(20)])
    expected = token_records.Encoder(token_records.MODEL).ids(texts)
    for name, value in (("KEPT_WORDS", 60), ("SLOT_BITS", 10), ("WORDS_AT_ONCE", 200)):
        monkeypatch.setattr(token_records, name, value)
    found = token_records.Encoder(token_records.MODEL).ids(texts)
    assert all(np.array_equal(a, b) for a, b in zip(expected, found))


def expected_records(rows):
    encoder = token_records.Encoder(token_records.MODEL)
    return {(i, *encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows}


@pytest.mark.parametrize("file_bytes", [300, 1 << 20])
def test_records_round_trip(spark, tmp_path, file_bytes):
    docs = frame(spark, ODD)
    files = token_records.write_records(docs, str(tmp_path / "records"), file_bytes=file_bytes)
    rows = token_records.id_list(token_records.read_records(files)).collect()
    assert Counter((r["doc_id"], *r["ids"]) for r in rows) == Counter(
        (i, *ids) for i, *ids in (next(iter(expected_records([(r[0], r[1])]))) for r in ODD)
    )
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(len(r["ids"]) for r in ordered[:-1])]).tolist()
    known = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert known == sorted(known)
    assert (files.count() > 1) or file_bytes > 300
    # frames by hand, from the format alone
    for file in files.collect():
        data, at, n = open(file["path"], "rb").read(), 0, 0
        index = np.fromfile(file["path"] + ".idx", "<u8").reshape(-1, 2)
        for offset, _ in index[:-1]:
            assert offset == at
            (size,) = struct.unpack_from("<Q", data, at)
            for start, length in ((at, 8), (at + 12, size)):
                crc = slow_crc32c(data[start : start + length])
                turned = (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
                assert struct.unpack_from("<I", data, start + length)[0] == turned
            at, n = at + size + 16, n + 1
        assert at == len(data) == file["bytes"] and n == file["records"] and index[-1].tolist() == [at, file["ids"]]


def test_shuffled_reads(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i} " * (i % 7)) for i in range(300)])
    files = token_records.write_records(docs, str(tmp_path / "records"), file_bytes=2000)
    plain = {tuple(r) for r in token_records.read_records(files).collect()}
    a, again, other = ([tuple(r) for r in token_records.read_shuffled(files, seed).collect()] for seed in (1, 1, 2))
    assert set(a) == plain and len(a) == 300 and a == again and a != other
    starts = np.array([r[1] for r in a])
    assert np.mean(np.abs(np.argsort(np.argsort(starts)) - np.arange(300))) > 50


@pytest.mark.parametrize("at", [0, 9, 20, 40, -2])
def test_damage_is_found(spark, tmp_path, at):
    files = token_records.write_records(frame(spark, [(i, "some words here") for i in range(5)]), str(tmp_path / "records"))
    path = files.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[at] ^= 4
    open(path, "wb").write(data)
    with pytest.raises(PythonException, match="checksum|payload|ends inside"):
        token_records.read_records(files).collect()
    open(path, "wb").write(data[:-1])
    with pytest.raises(PythonException, match="checksum|payload|ends inside"):
        token_records.read_records(files).collect()


def test_no_records(spark):
    files = token_records.write_records(frame(spark, []))
    assert files.count() == 0 and token_records.read_records(files).count() == 0 and token_records.read_shuffled(files).count() == 0


def test_small_files_share_a_task_and_their_list_is_one_file(spark, tmp_path):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    there = set(root.iterdir())
    files = token_records.write_records(frame(spark, enumerate(prose(3, 40))), str(tmp_path / "records"), file_bytes=500)
    made = set(root.iterdir()) - there
    assert files.count() > 8 and [len(list(p.glob("part-*"))) for p in made] == [1]
    records = token_records.read_records(files)
    assert records.count() == 40 and token_records.reading_tasks(files) == 1
    assert token_records.reading_tasks(files.withColumn("bytes", F.lit(token_records.BLOCK))) == files.count()
    assert token_records.reading_tasks(files.drop("bytes")) == files.count()


def test_token_query(spark):
    rows = {r["doc_id"]: r for r in queries.token_files(spark, SF_DIR).collect()}
    tokenizer, start = token_records.Encoder(token_records.MODEL).tokenizer, 0
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").sort_by("doc_id").to_pylist()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[doc["doc_id"]]) == (doc["doc_id"], start, len(ids), crc)
        start += len(ids)


# -- periodic runs ---------------------------------------------------------


def slow_runs(words):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j > i and j + period - i >= max(24, 3 * period):
                found.setdefault((i, j + period), period)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def periodic_text(rng):
    words, letters = [], rng.choice([1, 2, 3, 5, 50])
    for _ in range(rng.randrange(1, 8)):
        cycle = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 15))]
        words += (cycle * 60)[: rng.randrange(1, 60)] if rng.random() < 0.5 else cycle[: rng.randrange(15)]
    return words


def check_runs(texts):
    words = words_of(pa.array([" \n".join(t) for t in texts]))
    found = periodic_runs.block_runs(words, words.hashes())
    kept = periodic_runs.collapsed(words, found).to_pylist()
    for i, text in enumerate(texts):
        expected = slow_runs(text)
        assert [tuple(r[1:]) for r in found.tolist() if r[0] == i] == expected
        dropped = {j for start, length, period in expected for j in range(start + period, start + length)}
        assert kept[i] == " ".join(w for j, w in enumerate(text) if j not in dropped)


@pytest.mark.parametrize("tree_words", [30, 60_000])
def test_runs(monkeypatch, tree_words):
    monkeypatch.setattr(periodic_runs, "TREE_WORDS", tree_words)
    rng = random.Random(tree_words)
    for _ in range(40):
        check_runs([[], *(periodic_text(rng) for _ in range(rng.randrange(1, 20)))])


def test_runs_of_fibonacci_and_nested_words():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    square = [f"x{i % 7}" for i in range(30)]
    check_runs([list(b), square * 5, ["y"] * 400, [*square, "z"] * 4 + ["z"] * 30, ["y"] * 23, ["y"] * 24])


def test_extensions():
    rng = random.Random(6)
    codes = [rng.randrange(1, 4) for _ in range(300)] + [0]
    tree = periodic_runs.ukkonen(codes)
    common = periodic_runs.Extensions(tree, periodic_runs.Children.of(tree, tree.letter)).common
    pairs = np.array([(a, b) for a in range(0, 300, 7) for b in range(301) if a != b])
    for (a, b), n in zip(pairs.tolist(), common(pairs[:, 0], pairs[:, 1]).tolist()):
        assert codes[a : a + n] == codes[b : b + n] and codes[a + n] != codes[b + n]


def test_runs_of_odd_texts(spark):
    rows = periodic_runs.find_runs(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for doc_id, text in ((r[0], r[1]) for r in ODD):
        words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        expected = [tuple(r) for r in slow_runs([w for w in words if w])]
        assert any(r["doc_id"] == doc_id and [tuple(x) for x in r["runs"]] == expected for r in rows)
    assert next(r for r in rows if r["doc_id"] == 10 and r["n_words"] == 3000)["collapsed"] == "w"
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


# -- conversations ---------------------------------------------------------


def slow_trie(conversations):
    members, children = defaultdict(list), defaultdict(list)
    for conv, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((conv, d == len(turns)))
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].split()) if node else 0
    least = {node: min(c for c, _ in held) for node, held in members.items()}
    return Counter(
        (
            least[node], len(node), least[node[:-1]] if node else None, len(held), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c, end in held if end))).encode()).hexdigest(),
        )
        for node, held in members.items()
    )


def some_conversations(rng, n):
    found = []
    for conv in range(n):
        if found and rng.random() < 0.6:
            turns = list(rng.choice(found)[1])
            if rng.random() < 0.5:
                turns = turns[: rng.randrange(len(turns) + 1)] + [("u", f"x {rng.randrange(3)}")] * rng.randrange(2)
        else:
            turns = [(rng.choice("ua"), " ".join(rng.choices("abc", k=rng.randrange(3)))) for _ in range(rng.randrange(1, 6))]
        found.append((3 * conv - 20, turns))
    return found


TURNS = "conv_id long, turn long, role string, text string, key string, turns string, words long, block string, kind int"


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "k", "t", 1, "b", 2) for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("block_turns", [5, 50_000])
def test_trie(spark, either_join, block_turns):
    found = some_conversations(random.Random(5), 90)
    table = turn_table(spark, [(c, i, r, t) for c, turns in found for i, (r, t) in enumerate(turns)])
    rows = prefix_trie.sequences(table)
    none = spark.createDataFrame([(c, b"", []) for c, turns in found if not turns], "conv_id long, turns binary, words array<int>")
    nodes = prefix_trie.trie(rows.unionByName(none), block_turns)
    assert Counter(map(tuple, nodes.select(prefix_trie.NODE).collect())) == slow_trie(found)


def test_trie_of_copies_over_many_blocks(spark):
    long = [("u", f"turn {i}") for i in range(9)]
    found = [(c, long[:5] if c % 3 == 0 else long) for c in range(400)] + [(500 + c, [*long[: c % 9], ("a", "z")]) for c in range(30)]
    table = turn_table(spark, [(c, i, r, t) for c, turns in found for i, (r, t) in enumerate(turns)])
    nodes = prefix_trie.trie(prefix_trie.sequences(table), 60)
    assert Counter(map(tuple, nodes.select(prefix_trie.NODE).collect())) == slow_trie(found)


def test_trie_of_odd_turns(spark):
    table = turn_table(
        spark,
        [
            (None, 0, "u", "no conversation"), (1, None, None, None), (1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, None, "", ""),
            (3, 5, "u", "a  b\tc"), (3, 5, "u", "a  b\tc"), (4, 1, "x:", "y"), (5, 1, "x", ":y"), (6, 0, "u", "w " * 4000),
        ],
    )
    expected = slow_trie(
        [
            (1, [("", ""), ("u", "hi")]), (2, [("", ""), ("u", "hi")]), (3, [("u", "a  b\tc")] * 2), (4, [("x:", "y")]),
            (5, [("x", ":y")]), (6, [("u", "w " * 4000)]),
        ]
    )
    assert Counter(map(tuple, prefix_trie.prefix_trie(table).select(prefix_trie.NODE).collect())) == expected
    assert prefix_trie.prefix_trie(table.where("false")).count() == 0


def test_heads_of_missing_and_short_bases(spark):
    table = turn_table(spark, [(c, i, "u", f"{c} {i}") for c, n in ((0, 2), (1, 5), (2, 1), (21, 3), (40, 3), (41, 1)) for i in range(n)])
    rows = prefix_trie.sequences(table)
    got = prefix_trie.with_heads(rows, F.col("conv_id") - F.col("conv_id") % 20, F.lit(2)).collect()
    digests = {(c, i): bytes.fromhex(hashlib.md5(f"1:u{c} {i}".encode()).hexdigest()) for c in range(50) for i in range(5)}
    expected = {0: [(0, 0), (0, 1)], 1: [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4)], 2: [(0, 0), (0, 1)], 21: [(21, 2)], 40: [(40, 0), (40, 1), (40, 2)],
                41: [(40, 0), (40, 1)]}
    assert {r["conv_id"]: bytes(r["turns"]) for r in got} == {c: b"".join(digests[k] for k in keys) for c, keys in expected.items()}
    assert all(r["words"] == [2] * len(expected[r["conv_id"]]) for r in got)
