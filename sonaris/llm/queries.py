"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaris.llm.bpe import bpe_encode
from sonaris.llm.chat import format_chats, masked_texts, parse_chats
from sonaris.llm.common import table
from sonaris.llm.curves import nearest_neighbours
from sonaris.llm.html_text import extract_main_text
from sonaris.llm.langid import identify_language
from sonaris.llm.near_dup import near_duplicates
from sonaris.llm.packing import pack_documents
from sonaris.llm.quality import LEFT, MIN_DOCS, SHARE, quality_rules
from sonaris.llm.sharding import HASH_BITS, MAX_BYTES, extendible_shards
from sonaris.llm.token_store import op3_token_index

#: The conversation that op4 adds: both texts hold the template's own control strings.
EXTRA_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every vector whose id is divisible by 100."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and digests of what is read back from the formatted strings."""
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{EXTRA_TEXT}'), (-1L, 1L, 'assistant', '{EXTRA_TEXT}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = parse_chats(format_chats(rows))
    read = read.withColumn("under_mask", masked_texts(read))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("under_mask", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows", "over")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both outputs."""
    coded = bpe_encode(table(spark, sf_dir, "documents"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_main_text, op2_curve_neighbours, op3_token_index, op4_chat_format, op5_extendible_shards,
        op6_language, op7_pack, op8_bpe_roundtrip, op9_near_duplicates, op10_quality)}


_OP2 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

_OP4 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{EXTRA_TEXT}'), (-1, 1, 'assistant', '{EXTRA_TEXT}')),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS before FROM r),
s AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS plain,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length('<|im_end|>') + 1) AS size,
             bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS valid
      FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars, valid FROM s
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
                  lpad(bin(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), {HASH_BITS // 4}))::UBIGINT), {HASH_BITS}, '0') AS bits FROM documents),
p AS (SELECT d.*, CAST(g.k AS INTEGER) AS depth, left(bits, CAST(g.k AS INTEGER)) AS shard FROM d, range(0, 41) AS g(k)),
b AS (SELECT shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY shard),
f AS (SELECT p.*, b.shard_bytes, b.shard_rows FROM p JOIN b USING (shard) WHERE b.shard_bytes <= {MAX_BYTES} OR b.shard_rows = 1)
SELECT doc_id, shard, depth, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows, shard_bytes > {MAX_BYTES} AS over
FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

_OP9 = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS low FROM w UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.low = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS low FROM c GROUP BY doc_id) m USING (doc_id)
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
y AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM y, range(0, 3) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)),
lw AS (SELECT doc_id, source, t, line, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
f AS (SELECT source, norm FROM lw JOIN h USING (source) GROUP BY source, norm, docs HAVING count(DISTINCT t) > {MIN_DOCS} AND count(DISTINCT t) > {SHARE} * docs),
gone AS (SELECT doc_id, sum(n) AS n FROM lw JOIN f USING (source, norm) GROUP BY doc_id),
q AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_frequent_words
      FROM d LEFT JOIN z USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= {LEFT} * n_words AS kept FROM q
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_curve_neighbours": _OP2, "op4_chat_format": _OP4, "op5_extendible_shards": _OP5, "op9_near_duplicates": _OP9, "op10_quality": _OP10}
