"""The numbered queries and the SQL they must agree with."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import functions as F

from checks.registry import query, table
from glyphray.llm import bpe, chat, exact_dedup, fingerprint, langid, lexical, lm, mixing, ngram_join, sharding, urls, warc, whitening

WORDS = r"[^\x20\x09-\x0D]+"

# --- 1 chat formatting -------------------------------------------------------------------------

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\0'), '</turn>', '\1') AS body,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      WHEN 'tool' THEN 'Tool' ELSE '?' || replace(replace(replace(replace(
        role, '\', '\\'), '###', '\0'), '</turn>', '\1'), ': ', '\2') END AS label
  FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    CAST(sum(length('### ' || label || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, formatted_chars, valid
FROM g JOIN (
  SELECT conv_id, regexp_full_match(string_agg(
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END,
    '' ORDER BY turn NULLS FIRST, role, text), 's?ua(ua|t+a)*') AS valid FROM e GROUP BY conv_id) USING (conv_id)
"""


@query("op1_chat_formatting", _CHAT_SQL)
def op1(spark, sf):
    tricky = r"\### Assistant: </turn> ok"
    given = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    blocks = chat.format_turns(given.unionByName(planted))
    valid = chat.validity(blocks).select(F.col("conv_id").alias("valid_id"), "valid")
    return chat.digests(chat.read_back(blocks)).join(valid, F.col("conv_id").eqNullSafe(F.col("valid_id"))).drop("valid_id")


# --- 3 sharding --------------------------------------------------------------------------------

SHARDS = 16


@query("op3_sharding")
def op3(spark, sf):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    now = sharding.assign(docs, F.col("doc_id"), [1.0] * SHARDS)
    grown = sharding.assign(now, F.col("doc_id"), [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.numbered(grown.withColumn("law", F.lit("key")), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


# --- 4 mixing ----------------------------------------------------------------------------------

_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
r AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size) AS mark FROM sized),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS stop FROM s),
k AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM l WINDOW w AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM k),
timed AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, e, row_number() OVER () AS at,
    CAST(e * g.source_size + sum(size) OVER (PARTITION BY r.source, e
      ORDER BY CAST('0x' || substr(mark, 1, 6) AS INTEGER) % 4096, mark, doc_id, size) AS DOUBLE) / g.target AS v
  FROM r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source, range(3) t(e)),
live AS (SELECT * FROM timed WHERE target > 0 AND size > 0 AND v - size / target < 1),
cut AS (
  SELECT max(v) AS cut FROM (
    SELECT v, sum(size) OVER (ORDER BY v) AS upto FROM live)
  WHERE upto <= (SELECT sum(source_size) FROM goals))
SELECT doc_id, size, source_size, target,
  CAST(size * count(*) FILTER (target > 0 AND size > 0 AND v - size / target < 1 AND v <= cut) AS BIGINT) AS taken
FROM timed, cut GROUP BY doc_id, size, source_size, target
"""


@query("op4_mixing", _MIX_SQL)
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


# --- 7 exact dedup -----------------------------------------------------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY doc_id, text_sha256) = 1
  AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", _DEDUP_SQL)
def op7(spark, sf):
    return exact_dedup.membership(table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


# --- 10 fingerprints ---------------------------------------------------------------------------


@query("op10_fingerprints")
def op10(spark, sf):
    return fingerprint.compare_with_edits(table(spark, sf, "documents"))


# --- 8 byte-level BPE --------------------------------------------------------------------------

RANKS = "byte_bpe_50k.tiktoken"


@query("op8_byte_bpe")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


# --- 2 language identification -----------------------------------------------------------------


def remainder(divisor):
    """CRC-32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % divisor


@query("op2_language_id")
def op2(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs.filter(remainder(4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans"
    )


# --- 9 LM scoring ------------------------------------------------------------------------------

PIECES = "piece_bpe_32k.model"


@query("op9_lm_scoring")
def op9(spark, sf):
    scored = lm.score(table(spark, sf, "documents"), remainder(7) != 2, public_tokenizers.path(PIECES))
    return scored.select(
        "doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


# --- 5 n-gram Jaccard join ---------------------------------------------------------------------


@query("op5_ngram_jaccard_join")
def op5(spark, sf):
    return ngram_join.component_ids(table(spark, sf, "documents"))


# --- 6 WARC ------------------------------------------------------------------------------------

_WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000
  GROUP BY payload_digest HAVING count(*) > 1 AND max(page_id) IS NOT NULL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op6_warc", _WARC_SQL)
def op6(spark, sf):
    return warc.archive_and_read(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# --- 12 URL filter -----------------------------------------------------------------------------

URL_RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
]


def _url_sql() -> str:
    low = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    edge = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    count = lambda terms: " + ".join(
        f"CAST(regexp_matches(whole, '(?s)(?:^|{edge}){t}(?:{edge}|$)') AS BIGINT)" for t in terms)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r.host + r.path))
    choose = lambda of: " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in longest)
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, {low("url")} AS whole, {low("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, {count(urls.STRICT)} AS strict_terms, {count(urls.SOFT)} AS soft_terms FROM p)
SELECT page_id, host, path, CASE {choose(lambda r: r.host + r.path)} END AS rule,
  CASE {choose(lambda r: r.verdict)} WHEN strict_terms > 0 OR soft_terms >= {urls.SEVERAL} THEN 'block' ELSE 'allow' END AS verdict,
  soft_terms
FROM c
"""


@query("op12_url_filter", _url_sql())
def op12(spark, sf):
    return urls.judge(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "soft_terms")


# --- 11 embedding whitening --------------------------------------------------------------------


@query("op11_whitening")
def op11(spark, sf):
    return whitening.components(table(spark, sf, "embeddings"))


# --- 13 ranked lexical search ------------------------------------------------------------------

_SEARCH_SQL = rf"""
WITH words AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, doc_id, row_number() OVER () AS r FROM documents),
asked AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, item_id, row_number() OVER () AS i FROM benchmark),
q AS (SELECT i, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT i, unnest(terms) AS term FROM asked) GROUP BY i, term),
v AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM words) GROUP BY r, term),
t AS (
  SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM words),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM v, t GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * CAST(len(terms) AS BIGINT) * n_docs) // total AS m FROM words, t WHERE len(terms) > 0),
s AS (
  SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN v USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r),
o AS (
  SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o JOIN asked USING (i) WHERE rank <= 10
"""


@query("op13_lexical_search", _SEARCH_SQL)
def op13(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
