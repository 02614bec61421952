"""One registered query per operator, over the driver's whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversations, decontam, exact_dedup, html, jaccard, line_dedup, ngram_lm, packing, quality, secrets,
               token_counts, whitening)
from .shared import cut


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most ``rows`` texts in one Arrow batch of this session: both sides of a
    worker's pipe hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public vocabulary file, by the package that holds them (a parameter of
    the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op3_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of odd crc32 are the snapshot, the others the incoming batch."""
    old = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    return exact_dedup.exact_dedup(_table(spark, sf, "documents"), old)


def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    return html.extract_text(pages, keep=("url",)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_lm.lm_scores(_table(spark, sf, "documents"))


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    got = bpe.encode_documents(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_table(spark, sf, "documents"), k=4, num=85, den=100)


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf, "documents"), extend=True).select("doc_id", "text", "lines_removed")


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations.damage(_table(spark, sf, "conversations"))
    return conversations.repair_conversations(rows, present=F.col("present"))


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    got = packing.pack_documents(_table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))
    return cut(got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"), components=16)


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_secret_scans": op3_secret_scans,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_bpe": op7_bpe,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_packing": op12_packing,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


# Equal texts are identical after each run of white space became one space.
_OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t"""

# Windows of ten item words (all words of a shorter item) against the documents'
# windows of as many words; a hit word is inside any occurrence.
_OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'),
                  '[^ ]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'),
                  '[^ ]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN q USING (doc_id)"""


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

# Distinct shingles, pairs that share one, exact Jaccard, and all that links reach.
_OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT a, a FROM both_ways UNION SELECT u, b FROM reach JOIN both_ways ON a = v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS least FROM reach GROUP BY u) c ON c.u = d.doc_id"""

# Lines with words; the shortest runs of 50 words from each line and up to each line;
# what covers a later occurrence of such a run goes, with blank lines in between.
_OP9_SQL = r"""
WITH l AS MATERIALIZED (SELECT doc_id, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') AS real FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, len(w) AS n, array_to_string(w, ' ') AS k FROM (
  SELECT doc_id, i, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM l WHERE real)),
t AS MATERIALIZED (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY r) AS BIGINT) AS upto FROM r),
keys AS MATERIALIZED (SELECT doc_id, list(k ORDER BY r) AS ks FROM t GROUP BY doc_id),
runs AS (SELECT a.doc_id, a.r AS a, b.r AS e FROM (SELECT *, upto - n + 50 AS need FROM t) a
    ASOF JOIN t b ON a.doc_id = b.doc_id AND a.need <= b.upto
  UNION SELECT a.doc_id, b.r, a.r FROM (SELECT *, upto - 50 AS most FROM t) a
    ASOF JOIN (SELECT *, upto - n AS below FROM t) b ON a.doc_id = b.doc_id AND a.most >= b.below),
named AS MATERIALIZED (SELECT doc_id, a, e, array_to_string(ks[a:e], chr(10)) AS k FROM runs JOIN keys USING (doc_id)),
firsts AS (SELECT k, min((doc_id, a)) AS f FROM named GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, a, e, f[1] AS fd, f[2] AS fa FROM named JOIN firsts USING (k)),
spans AS (SELECT DISTINCT doc_id, CASE WHEN doc_id = fd THEN greatest(a, fa + e - a + 1) ELSE a END AS lo, e AS hi
  FROM later WHERE NOT (doc_id = fd AND a = fa)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS r FROM spans WHERE lo <= hi),
placed AS (SELECT l.*, sum(CASE WHEN real THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l),
kept AS (SELECT p.doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE g.r IS NULL OR NOT real AND h.r IS NULL) AS s,
    count(*) FILTER (WHERE real AND g.r IS NOT NULL) AS n
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.r = p.r LEFT JOIN gone h ON h.doc_id = p.doc_id AND h.r = p.r + 1
  GROUP BY p.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(s, '') END AS text, coalesce(n, 0) AS lines_removed
FROM documents LEFT JOIN kept USING (doc_id)"""


# Forward dynamic programming over the rows, an independent form of the parse: v0
# to v3 hold the least cost (six digits) and audit of each format state.
def _add(v: str, cost, letter: str) -> str:
    return f"lpad(CAST(CAST({v}[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || {v}[7:] || '{letter}'"


def _user(v: str) -> str:
    return f"CASE r.k WHEN '-' THEN '900000' WHEN 'u' THEN {_add(v, 'r.e', 'K')} ELSE {_add(v, '2 + r.e', 'R')} END"


_OP11_STEP = f"""list_transform([{{
  'v0': {_add('a.v0', 3, 'D')},
  'v1': least({_add('a.v1', 3, 'D')}, CASE WHEN r.k = 's' THEN {_add('a.v0', 'r.e', 'K')} ELSE '900000' END),
  'v2': least({_add('a.v2', 3, 'D')}, {_user('a.v0')}, {_user('a.v1')}, {_user('a.v3')}),
  'v3': least({_add('a.v3', 3, 'D')}, CASE r.k WHEN '-' THEN '900000' WHEN 'a' THEN {_add('a.v2', 'r.e', 'K')}
              ELSE {_add('a.v2', '2 + r.e', 'R')} END)}}], lambda w: {{'v0': w.v0, 'v1': w.v1,
  'v2': least(w.v2, {_add('w.v0', 2, 'I')}, {_add('w.v1', 2, 'I')}, {_add('w.v3', 2, 'I')}),
  'v3': least(w.v3, {_add('w.v2', 2, 'I')}, {_add('w.v0', 4, 'II')}, {_add('w.v1', 4, 'II')}),
  'k': '', 'e': 0}})[1]"""

_OP11_SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
               lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
src AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS x,
          list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                         lambda s: CAST(ascii(s) AS BIGINT)) AS b FROM conversations),
dealt AS (SELECT src.*, xor(list_reduce([4294967295] || b, lambda h, y: xor(h >> 8, tab[(xor(h, y) & 255) + 1])), 4294967295) % 20 AS m
          FROM src, crc),
damaged AS (SELECT c, t, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
              CASE m WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x,
              unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS n FROM dealt WHERE m <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, sha256(role || chr(0) || x), n) AS i FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY c, role, x ORDER BY i) > 1 THEN 'd'
    WHEN regexp_extract(x, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
    lag(role) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
marked AS (SELECT *, CASE WHEN f IN ('b', 'd') THEN '-' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS k,
    CASE WHEN f = 't' THEN 1 ELSE 0 END AS e FROM faults),
found AS (SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank,
    count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list({{'v0': '', 'v1': '', 'v2': '', 'v3': '', 'k': k, 'e': e}} ORDER BY i), lambda a, r: {_OP11_STEP},
                {{'v0': '000000', 'v1': '900000', 'v2': '000002I', 'v3': '000004II', 'k': '', 'e': 0}}) AS v
    FROM marked GROUP BY c),
solved AS (SELECT * EXCLUDE (v), least(v.v0, v.v3) AS v FROM found),
edits AS (SELECT c, string_split(v[7:], '') AS l, unnest(range(1, length(v) - 5)) AS j FROM solved),
numbered AS (SELECT c, j, l[j] AS edit, len(list_filter(l[:j], lambda y: y <> 'I')) AS i,
    len(list_filter(l[:j], lambda y: y <> 'D')) AS o FROM edits),
joined AS (SELECT numbered.*, role, x, bool_or(o = 1 AND edit = 'K' AND role[1] = 's') OVER (PARTITION BY numbered.c) AS sys
    FROM numbered LEFT JOIN marked ON numbered.c IS NOT DISTINCT FROM marked.c AND numbered.i = marked.i),
texts AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o % 2 = 1) <> sys THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE x END, chr(10) ORDER BY j) AS s FROM joined WHERE edit <> 'D' GROUP BY c)
SELECT o.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1:6], '0') AS BIGINT) AS cost,
  coalesce(v[7:], '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) o LEFT JOIN solved ON o.c IS NOT DISTINCT FROM solved.c
LEFT JOIN texts ON o.c IS NOT DISTINCT FROM texts.c"""


def oracle_sql():
    return {"op4_exact_dedup": _OP4_SQL, "op8_ngram_jaccard_join": _OP8_SQL, "op9_line_dedup": _OP9_SQL,
            "op10_benchmark_decontamination": _OP10_SQL, "op11_conversation_repair": _OP11_SQL}
