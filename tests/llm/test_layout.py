"""Sharding, mixing, archives and the pipeline."""

import gzip
import hashlib
import io
import os
from collections import Counter

import pytest
from corpora import ODD, frame, prose

import corpus_pipeline
from codecat.llm import mixing, sharding, warc

# -- sharding --------------------------------------------------------------


def test_shards(spark, tmp_path):
    rows = ODD + [(100 + i, t) for i, t in enumerate(prose(2, 150))] + [(700, "same row")] * 20
    path = str(tmp_path / "shards")
    placed = sharding.shuffle_into_shards(frame(spark, rows), shards=7, bucket_bytes=3000, path=path).cache()
    got = placed.select("record.doc_id", "record.text", "size", "shard", "slot", "grown_shard").collect()
    assert Counter((r[0], r[1]) for r in got) == Counter(r[:2] for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
        assert r["grown_shard"] in (r["shard"], 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r["shard"] for r in got if r["doc_id"] == d}) == 1 for d in (4, 10, 700))
    assert {d for d in os.listdir(path) if d.startswith("shard=")} == {f"shard={s}" for s in slots}
    assert set(placed.select("record.*").columns) == set(frame(spark, rows).columns)
    # Order within a shard is shuffled, and the same again.
    again = sharding.shuffle_into_shards(frame(spark, rows), shards=7, bucket_bytes=3000)
    order = {r["record"]["doc_id"]: r["slot"] for r in again.collect() if 100 <= (r["record"]["doc_id"] or 0) < 250}
    assert order == {r["doc_id"]: r["slot"] for r in got if 100 <= (r["doc_id"] or 0) < 250}
    first = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"]) if r["shard"] == 3 and r["doc_id"] and 100 <= r["doc_id"] < 250]
    assert first != sorted(first)


def test_no_rows_to_shard(spark):
    assert sharding.shuffle_into_shards(frame(spark, []), shards=3).count() == 0


# -- mixing ----------------------------------------------------------------


def test_mix(spark):
    texts = prose(8, 300)
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{min(i % 9, 5)}") for i, t in enumerate(texts)]
    rows += [(None, "a b", "en", "s1"), (None, None, "en", "s1"), (400, "", None, "void"), (401, None, None, "void")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    total = sum(len(r[1].split()) for r in rows if r[1])
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]] if r["doc_id"] is not None else "s1"
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, expected = set(sizes), {}
    while True:  # share again until none is above its cap
        rest = 1.5 * total - sum(expected.values())
        even = {s: rest * weights[s] / sum(weights[t] for t in left) for s in left}
        over = {s for s in left if even[s] >= 2 * sizes[s]}
        if not over:
            expected |= even
            break
        expected |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    assert target == pytest.approx(expected)
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest / 2 for s in sizes)
    repeated = mixing.take(frame(spark, rows))
    assert repeated.columns == frame(spark, rows).columns
    by_id = Counter(r["doc_id"] for r in repeated.collect() if r["doc_id"] is not None)
    assert all(by_id[r["doc_id"]] == r["times"] for r in got if r["doc_id"] is not None)


def test_larger_budgets_take_supersets(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(prose(3, 80))]
    sets = [
        {r["doc_id"] for r in mixing.mix(frame(spark, rows), share=share).collect() if r["taken"]} for share in (0.2, 0.5, 0.9)
    ]
    assert sets[0] < sets[1] < sets[2]


def test_documents_without_words_are_not_taken_a_third_time(spark):
    """The target of this source is twice its size, so no budget is left for a threshold."""
    rows = [(i, f"w{i} x y", "en", "a") for i in range(20)] + [(100 + i, None, "en", "a") for i in range(20)] + [(200, "w " * 900, "en", "b")]
    got = mixing.mix(frame(spark, rows), share=1.9).where("doc_id < 200").collect()
    assert {(r["size"] > 0, r["times"]) for r in got} == {(True, 2), (False, 2)}


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.take(frame(spark, [(1, None)])).count() == 0


# -- archives --------------------------------------------------------------

LONG = "<p>" + "x y z " * 300
PAGES = [
    (1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "u\r\nx", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
    (None, "n", "é日" * 900), (None, "n", "é日" * 900), (None, "n", LONG), (8, "u", "q" * 1000), (9, "u", "q" * 999), (10, "u", "q" * 999), (8, "u", "q" * 1000),
]


def pages(spark, rows=PAGES):
    schema = "page_id long, url string, html string, payload string, digest string, kind string, path string"
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], schema)


def test_archives_round_trip(spark):
    files = warc.write_warc(pages(spark))
    got = warc.read_warc(files).collect()
    assert not any(r["gap"] for r in got) and len(got) == len(PAGES)
    by_id = {}
    for r in got:
        by_id.setdefault(r["record_id"], []).append(r)
    for page, _, html in PAGES[:9]:
        data = (html or "").encode()
        for r in by_id[f"<urn:page:{'none' if page is None else page}>"]:
            if page is not None:
                assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    types = {k: sorted((r["record_type"], r["refers_to"]) for r in v) for k, v in by_id.items()}
    assert types["<urn:page:1>"] == types["<urn:page:2>"] == [("revisit", "<urn:page:3>")]
    assert types["<urn:page:3>"] == types["<urn:page:9>"] == types["<urn:page:10>"] == [("response", None)]
    assert types["<urn:page:8>"] == [("response", None)] * 2
    assert types["<urn:page:none>"] == [("response", None)] * 2 + [("revisit", "<urn:page:3>")]
    assert {r["payload"].decode() for r in got if r["record_id"] == "<urn:page:3>"} == {LONG}


def test_long_urls(spark):
    url = "data:text/html," + "a1:b/" * 20_000
    rows = [(1, url, LONG), (2, url + "2", LONG), (3, url + "3", "short"), (4, "http://a/", "short")]
    got = warc.read_warc(warc.write_warc(pages(spark, rows))).collect()
    assert sorted((r["record_id"], r["url"], r["record_type"], r["gap"]) for r in got) == [
        (f"<urn:page:{i}>", u, "revisit" if i == 1 else "response", None) for i, u, _ in rows
    ]


@pytest.mark.parametrize("plain", [False, True])
def test_long_headers_of_damaged_records(monkeypatch, plain):
    monkeypatch.setattr(warc, "HEADER_BYTES", 16)
    parts = members(3, plain)
    assert salvaged(b"".join(parts)) == (ids(0, 1, 2), [])
    cut = b"WARC/1.1\r\nWARC-Target-URI: " + b"u" * 300 + b"\r\n"
    at = len(parts[0])
    assert salvaged(parts[0] + cut + parts[1]) == (ids(0, 1), [(at, at + len(cut))])
    assert salvaged(parts[0] + cut) == (ids(0), [(at, at + len(cut))])


def test_no_pages(spark):
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0


def members(n, plain=False):
    """Members of n records, as bytes each."""
    out = []
    for i in range(n):
        html = f"page {i} ".encode() * 150
        row = {"page_id": i, "url": "u", "payload": html, "length": len(html), "digest": hashlib.sha1(html).hexdigest(), "kind": "response", "refers_to": None}
        data = warc.record_bytes(row)
        out.append(gzip.decompress(data) if plain else data)
    return out


def salvaged(data):
    found = list(warc.Salvage(io.BytesIO(data), len(data)).records())
    ids = [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)]
    return ids, [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]


def ids(*numbers):
    return [f"<urn:page:{i}>" for i in numbers]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_salvage(monkeypatch, plain, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    parts = members(5, plain)
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    whole = b"".join(parts)
    assert salvaged(whole) == (ids(0, 1, 2, 3, 4), [])
    assert salvaged(b"") == ([], [])
    bad = bytearray(whole)  # one record is damaged inside
    bad[at[2] + len(parts[2]) // 2] ^= 0xFF
    assert salvaged(bytes(bad)) == (ids(0, 1, 3, 4), [(at[2], at[3])])
    cut = whole[: at[4] + 30]  # the end is missing
    assert salvaged(cut) == (ids(0, 1, 2, 3), [(at[4], len(cut))])
    missing = whole[: at[1] + 5] + whole[at[3] :]  # the middle is missing
    assert salvaged(missing) == (ids(0, 3, 4), [(at[1], at[1] + 5)])
    junk = b"\x1f\x8b\x08 WARC/1.0 noise" + whole[: at[1]] + b"\x00" * 100 + whole[at[1] :]
    got, gaps = salvaged(junk)
    assert got == ids(0, 1, 2, 3, 4) and gaps[0] == (0, 18) and gaps[1][1] - gaps[1][0] == 100
    assert salvaged(b"nothing here") == ([], [(0, 12)])


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("block, piece", [(64, 50), (1000, 1 << 16), (1 << 20, 1 << 16)])
def test_members_of_several_records(monkeypatch, level, block, piece):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "PIECE", piece)
    monkeypatch.setattr(warc, "STATES", 4)
    parts = members(40, plain=True)
    one = gzip.compress(b"".join(parts), level)
    all_ids, (last,) = ids(*range(40)), members(41)[40:]
    assert salvaged(one) == (all_ids, [])
    assert salvaged(one + last) == (ids(*range(41)), [])
    got, gaps = salvaged(one[:-8] + b"\x00" * 8 + last)  # the check fails late
    assert got == ids(*range(41)) and gaps == [(0, len(one))]
    got, gaps = salvaged(one[: len(one) * 3 // 4])  # cut off
    assert 10 < len(got) < 40 and got == all_ids[: len(got)] and gaps[-1] == (0, len(one) * 3 // 4)
    bad = bytearray(b"".join(parts))  # damaged before it was compressed
    at = sum(map(len, parts[:5]))
    bad[at + len(parts[5]) // 2] ^= 0xFF
    member = gzip.compress(bytes(bad), level)
    got, gaps = salvaged(member + last)
    assert got == ids(*range(5), *range(6, 41)) and len(gaps) == 1 and gaps[0][0] == 0 and gaps[0][1] <= len(member)
    wrong = b"".join(parts[:3]) + parts[3].replace(b"Content-Length: 1", b"Content-Length: 99") + b"".join(parts[4:])
    got, gaps = salvaged(gzip.compress(wrong, level))  # a length beyond the end
    assert got == ids(*range(3), *range(4, 40)) and len(gaps) == 1
    got, gaps = salvaged(gzip.compress(b"junk " + parts[0]))
    assert got == ids(0) and len(gaps) == 1
    assert salvaged(gzip.compress(b"")) == ([], [(0, 20)])


def test_damaged_files_are_read_on_the_cluster(spark, tmp_path):
    parts = members(4)
    parts[1] = parts[1][:-9] + b"\x00" * 9
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc").write_bytes(b"".join(members(2, plain=True)))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.read_warc(warc.archives(spark, str(tmp_path))).collect()
    read = sorted((os.path.basename(r["path"]), r["record_id"]) for r in got if r["gap"] is None)
    assert read == [("a.warc.gz", i) for i in ids(0, 2, 3)] + [("b.warc", i) for i in ids(0, 1)]
    gap = [r for r in got if r["gap"]]
    assert [(r["start"], r["end"]) for r in gap] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]


# -- pipeline --------------------------------------------------------------


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert 200 > sizes[0] >= sizes[1] >= sizes[2]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert all(r["round_trip"] for r in rows.collect())
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.collect()}
    run = corpus_pipeline.run(spark, sf_dir).drop("ids").collect()
    assert sorted(map(repr, run)) == sorted(map(repr, rows.drop("ids").collect()))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables pass through every stage."""
    spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    good = " ".join(prose(9, 1, 90))
    rows = [*ODD, (20, good), (20, good), (21, good + " more"), (None, good)]
    for docs in (frame(spark, rows), frame(spark, [])):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            found = out.collect()
            if name == corpus_pipeline.STAGES[-1][0]:
                assert bool(found) == bool(n) and all(r["round_trip"] for r in found)
            else:
                assert out.columns == docs.columns and bool(found) == bool(n), name


@pytest.mark.parametrize("before, after", [("64m", 4 << 20), ("67108864", 4 << 20), ("1m", 1 << 20)])
def test_stages_bound_batches_of_texts(spark, before, after):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, before)
    try:
        docs = frame(spark, [(i, "word " * 2000) for i in range(1500)]).coalesce(1)
        corpus_pipeline.tokens(spark, docs, "")

        def read(parts):
            for part in parts:
                yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], ["n"])

        sizes = [r.n for r in docs.select("text").mapInArrow(read, "n long").collect()]
    finally:
        spark.conf.unset(key)
    assert len(sizes) > 1 and max(sizes) <= 1.1 * after + 20_000
