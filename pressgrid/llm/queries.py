"""Registered queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm.forest import near_vectors
from pressgrid.llm.hilbert import nearest_vectors
from pressgrid.llm.language import count_grams, page_languages
from pressgrid.llm.line_dedup import dedup_lines
from pressgrid.llm.ngram_join import ngram_components
from pressgrid.llm.packing import pack_documents
from pressgrid.llm.pieces import decode_pieces, encode_pieces, same_text
from pressgrid.llm.prefix_trie import prefix_nodes
from pressgrid.llm.quality import score_quality, train as train_quality
from pressgrid.llm.secrets import BASE, REACH, WEAK, find_secrets, listed
from pressgrid.llm.sharding import shard_rows
from pressgrid.llm.structure_repair import audit_conversations, repair_conversations
from pressgrid.llm.toxicity import held_out, score_toxicity, train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_ngram_jaccard_join", r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g FROM word),
entry AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM gram),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM entry AS x JOIN entry AS y USING (t) WHERE x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(a, b) AS (SELECT doc_id, doc_id FROM gram UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = gram.doc_id) AS component_id FROM gram
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"), width=4, percent=85)


@query("op9_line_dedup", r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
repeated AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(keeper <> doc_id, FALSE) AS dropped FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        with_ids=False)


def quoted(pattern: str) -> str:
    """A pattern as an SQL string; a run's start needs no look-behind when matching is leftmost."""
    return "'" + re.sub(r"\(\?<![^)]*\)", "", pattern).replace("'", "''") + "'"


def _secret_sql() -> str:
    rules = BASE + WEAK
    found = "\n  UNION ALL ".join(rf"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(m) AS hit, generate_subscripts(m, 1) AS i, m, g FROM (
    SELECT doc_id, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS g FROM doc)""" for rank, (kind, p, _, _) in enumerate(rules))
    enough = " ".join(f"WHEN '{kind}' THEN length(" + (f"regexp_extract(hit, {quoted(p)}, {g})" if g else "hit") + f") >= {n}" for kind, p, g, n in rules)
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({found}),
placed AS (
  SELECT doc_id, rank, kind, hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM hits WHERE CASE kind {enough} END
    AND (kind <> 'key' OR (regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')))),
part AS (
  SELECT *, s + length(hit) AS e, CASE WHEN kind IN ('access', 'user') THEN 'identifier' WHEN kind = 'address' THEN 'endpoint' ELSE 'secret' END AS role FROM placed),
kept AS (
  SELECT * FROM part AS p WHERE rank < 3
    OR (kind IN ('user', 'address') AND EXISTS (SELECT 1 FROM part AS q WHERE q.doc_id = p.doc_id AND q.role = 'secret' AND q.s <= p.e + {REACH} AND q.e >= p.s - {REACH})
        AND (kind = 'user' OR EXISTS (SELECT 1 FROM part AS q WHERE q.doc_id = p.doc_id AND q.role = 'identifier' AND q.s <= p.e + {REACH} AND q.e >= p.s - {REACH})))
    OR (kind = 'key' AND EXISTS (SELECT 1 FROM part AS q WHERE q.doc_id = p.doc_id AND q.role = 'identifier' AND q.s <= p.e + {REACH} AND q.e >= p.s - {REACH}))),
listed AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || e AS span FROM kept)
SELECT doc.doc_id, count(span) FILTER (kind = 'assign') AS n_assign, count(span) FILTER (kind = 'access') AS n_access,
  count(span) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM doc LEFT JOIN listed ON listed.doc_id = doc.doc_id GROUP BY doc.doc_id
"""


@query("op2_secret_scan", _secret_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    counts = [(F.size("base") - F.size(F.array_remove(F.col("base")["kind"], k))).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels").filter(~held_out()))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", F.col("rejected").cast("int").alias("predicted"))


@query("op5_embedding_near_dedup", r"""
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM valid AS x JOIN valid AS y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = root.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM root
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op10_hilbert_neighbours")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(table(spark, folder, "embeddings"))


SHARD_BYTES = 1 << 20


@query("op1_extendible_sharding", f"""
WITH doc AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS row_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits FROM documents),
deep AS (SELECT *, unnest(range(0, 61)) AS depth FROM doc),
fits AS (
  SELECT depth, bits >> (60 - depth) AS prefix FROM deep GROUP BY ALL HAVING sum(row_bytes) <= {SHARD_BYTES} OR count(*) = 1),
shallow AS (
  SELECT deep.doc_id, row_bytes, bits, min(deep.depth) AS depth FROM deep JOIN fits ON fits.depth = deep.depth AND prefix = bits >> (60 - deep.depth)
  GROUP BY deep.doc_id, row_bytes, bits)
SELECT doc_id, lpad(CASE WHEN depth = 0 THEN '' ELSE bin(bits >> (60 - depth)) END, CAST(depth AS INT), '0') AS shard,
  CAST(depth AS INT) AS depth, CAST(row_bytes AS BIGINT) AS row_bytes FROM shallow
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"), SHARD_BYTES).select("doc_id", "shard", "depth", "row_bytes")


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(table(spark, folder, "documents").select("doc_id", "text"), model), model)
    return decoded.select("doc_id", "n_ids", "ids_crc32", same_text().alias("round_trip"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    names, shares = count_grams(table(spark, folder, "documents"))
    return page_languages(table(spark, folder, "pages"), names, shares)


@query("op13_quality_classifier")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train_quality(docs, table(spark, folder, "labels").filter(~held_out()))
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("accepted").cast("int").alias("predicted"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, bit by bit."""
    bits = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return (f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), "
            f"lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: {bits}))")


@query("op11_prefix_trie", rf"""
WITH turn AS (SELECT conv_id, turn, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY turn NULLS FIRST, sha256(length(said.r) || ':' || said.r || said.x)) AS seq FROM turn GROUP BY conv_id),
sized AS (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.seq, [])[1:c.h], c.seq[c.h + 1:]) AS seq FROM sized AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefix AS (SELECT conv_id, seq[1:d] AS p, d, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefix GROUP BY p, d),
child AS (SELECT q, count(*) AS n_children FROM (SELECT p[1:d - 1] AS q FROM node WHERE d > 0) GROUP BY q),
valued AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS saved
  FROM node LEFT JOIN child ON q = p),
total AS (
  SELECT q, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT p[1:a] AS q, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued)) GROUP BY q)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM valued AS v JOIN total ON q = v.p LEFT JOIN node AS up ON v.d > 0 AND up.p = v.p[1:v.d - 1]
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_nodes(table(spark, folder, "conversations"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with the faults that op12 is to find, by a hash of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    act = F.col("_act")
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_act")).filter(act != 0)
        .select("conv_id", "turn", F.when(act == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(act == 1, "").when(act == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.when(act == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy"))


def turns_sha256(turns: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its newline-joined `role:text`; reads each partition in the order it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 1:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((batch.column("conv_id").type, pa.string()))], ["conv_id", "sha"])
        if state:
            yield pa.record_batch([pa.array([v]) for v in (now, state.hexdigest())], ["conv_id", "sha"])

    return turns.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, sha string")


@query("op12_structure_repair", rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS act FROM conversations),
row_ AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
    CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM row_),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
fault AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM fault GROUP BY conv_id),
-- what may be put in: from what was put out last (0 nothing, 1 system, 2 user, 3 assistant) to what is last then
put(a, b, edits, price, more) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']),
  (3, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])),
search(conv_id, i, st, cost, audit, built) AS (
  SELECT conv_id, CAST(0 AS BIGINT), b, price, edits, more FROM counted JOIN put ON a = 0
  UNION ALL
  SELECT conv_id, i, st, cost, audit, built FROM (
    SELECT s.conv_id, f.i, p.b AS st, s.cost + e.price + p.price AS cost, s.audit || e.edit || p.edits AS audit, list_concat(s.built, list_concat(e.more, p.more)) AS built
    FROM search AS s JOIN fault AS f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1,
    LATERAL (
      SELECT s.st AS b, 'D' AS edit, 3 AS price, [] AS more
      UNION ALL SELECT CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'K', CAST(f.fault = 'truncated' AS INT), [f.role || ':' || f.text]
        WHERE f.fault NOT IN ('blank', 'duplicate') AND ((left(f.role, 1) = 's' AND s.st = 0) OR (left(f.role, 1) = 'u' AND s.st <> 2) OR (left(f.role, 1) = 'a' AND s.st = 2))
      UNION ALL SELECT CASE WHEN s.st = 2 THEN 3 ELSE 2 END, 'R', 2 + CAST(f.fault = 'truncated' AS INT), [CASE WHEN s.st = 2 THEN 'assistant:' ELSE 'user:' END || f.text]
        WHERE f.fault NOT IN ('blank', 'duplicate')) AS e
    JOIN put AS p ON p.a = e.b)
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
done AS (
  SELECT s.* FROM search AS s JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n WHERE st IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(built, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done AS d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns = damaged(conversations)
    audits = audit_conversations(turns)
    hashes = turns_sha256(repair_conversations(turns, audits))
    all_ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = audits.join(hashes.withColumnRenamed("conv_id", "h_id"), F.col("conv_id").eqNullSafe(F.col("h_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
