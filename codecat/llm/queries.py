"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, ngram_join, periodic_runs, prefix_trie, quality_classifier, quality_rules, secrets, segmentation, sharding, substring_dedup, token_records, warc

from ..sources.scratch import staged
from .words import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", digest)


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    held_out = quality_classifier.held_out(F.col("doc_id")).alias("held_out")
    return quality_classifier.score(docs, chain).select("doc_id", held_out, "score", "predicted")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("record.text"), F.lit("")).cast("binary")
    return placed.select(
        "record.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode(table(spark, sf_dir, "documents"))


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")), with_payload=False)

    def page(name: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")

    return read.where("gap is null").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_records.read_records(token_records.write_records(table(spark, sf_dir, "documents")))
    return records.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def with_cycles(docs: DataFrame) -> DataFrame:
    """The documents that a tenth of all ids makes periodic from some word on."""
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turn = F.floor(hash_ / 10)

    def cycled(words: Column) -> Column:
        start = turn % F.size(words)
        period = 1 + F.floor((F.size(words) - start) / (3 + turn % 8))
        return F.transform(
            words,
            lambda word, i: F.when(i < start, word).otherwise(F.get(words, (start + (i - start) % period).cast("int"))),
        )

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))
    # The outer transform binds the words once, so that the inner one does not find them again for each word.
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(cycled(w), " ")).otherwise(""))[0]
    return docs.select("doc_id", F.when(hash_ % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_cycles(table(spark, sf_dir, "documents")))

    def larger(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = F.aggregate("runs", none, larger)
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "conversations")
    conv = F.col("conv_id")
    return prefix_trie.trie(prefix_trie.with_heads(rows, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("times")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substrings,
        "op2_exact_dedup": exact,
        "op3_quality_classifier": classified,
        "op4_sharding": shards,
        "op5_sentencepiece": segmented,
        "op6_quality_rules": rules,
        "op7_secret_scans": secret_spans,
        "op8_mixing": mixture,
        "op9_ngram_join": similar,
        "op10_warc": web_archive,
        "op11_token_records": token_files,
        "op12_periodic_runs": word_runs,
        "op13_prefix_trie": prefix_nodes,
    }


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM f WHERE least < doc_id), unnest(range(i, i + 50)) AS t(p)),
k AS (
  SELECT w.doc_id, count(c.p) AS n_removed, coalesce(string_agg(ws[q], ' ' ORDER BY q) FILTER (c.p IS NULL), '') AS kept
  FROM w, unnest(range(1, len(ws) + 1)) AS t(q) LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = q GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
r AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, cap / weight AS rise,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
g AS (SELECT source, source_size,
         CASE WHEN rise <= level THEN cap ELSE weight * max(CASE WHEN rise > level THEN level END) OVER () END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS base FROM g),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN upto <= budget OR (upto - same <= budget AND upto - budget < budget - (upto - same))
                                THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * joint >= 90 * (x.n + y.n - joint)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""

#: CRC-32 of the characters of a decimal number.
CRC_MACRO = """xor(list_reduce(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)),
                             lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295), 4294967295)"""

RUNS_SQL = (
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, """
    + CRC_MACRO.format("doc_id")
    + r""" AS h FROM documents),
e AS (SELECT *, len(o) AS n, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
w AS (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
                      THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1]
                                                                   ELSE o[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END)
                      ELSE o END AS ws FROM e),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS s FROM w, unnest(range(len(ws) - 7)) AS t(i)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM s GROUP BY doc_id, q, k),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS HUGEINT) * 1000000000000 // period DESC, start, period) AS place,
         count(*) OVER (PARTITION BY doc_id) AS n FROM r),
l AS (SELECT doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, j FROM r, unnest(range(start + period, start + length)) AS t(j)),
k AS (
  SELECT w.doc_id, string_agg(ws[j + 1], ' ' ORDER BY j) AS kept
  FROM w, unnest(range(len(ws))) AS t(j) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.j = t.j) GROUP BY w.doc_id)
SELECT w.doc_id, coalesce(b.n, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.place = 1 LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""
)


TRIE_SQL = (
    r"""
WITH t AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest, words) AS ds, list(words ORDER BY turn NULLS FIRST, digest, words) AS ws, """
    + CRC_MACRO.format("conv_id")
    + r""" % 4 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT o.conv_id, list_concat(coalesce(b.ds[1:o.h], []), o.ds[o.h + 1:]) AS ds, list_concat(coalesce(b.ws[1:o.h], []), o.ws[o.h + 1:]) AS ws
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
x AS (
  SELECT conv_id, d, len(ds) = d AS ends, array_to_string(ds[1:d], '') AS key, array_to_string(ds[1:d - 1], '') AS above, ws[d] AS words
  FROM r, unnest(range(len(ds) + 1)) AS t(d)),
n AS (
  SELECT d, key, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ended
  FROM x GROUP BY d, key),
c AS (SELECT d - 1 AS d, above AS key, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (d, key)),
s AS (
  SELECT x.d, x.key, sum(CASE WHEN m.children = 0 THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN m.d = 0 THEN 0 ELSE (m.n - 1) * m.words END) AS saved
  FROM m JOIN x ON x.conv_id = m.conv_id AND x.d <= m.d GROUP BY x.d, x.key)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ended, '')) AS ends_sha256
FROM m JOIN s USING (d, key) LEFT JOIN m p ON p.d = m.d - 1 AND p.key = m.above AND m.d > 0
"""
)


def oracles() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_SQL,
        "op2_exact_dedup": EXACT_SQL,
        "op8_mixing": MIXING_SQL,
        "op9_ngram_join": JOIN_SQL,
        "op10_warc": WARC_SQL,
        "op12_periodic_runs": RUNS_SQL,
        "op13_prefix_trie": TRIE_SQL,
    }
