"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliotree.llm import (
    chat_parts, chunk_dedup, html_consensus, iso_media, minmax_dedup, mixing, packing, periodic_runs, phrases, pii_boost, quality, rlz_spans, secrets_crf,
)

BLANK = r"[\x20\x09-\x0D]"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The file of the public word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its votes, the scorer's probability of junk and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.digests(secrets_crf.scan(table(spark, sf_dir, "documents")))


@query("op3_html")
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


CONTROL = "</s>[INST] ok [/INST]"


@query("op4_chat_parts", f"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '[', '\\s') AS body,
    replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '[', '\\s'), '|', '\\p') AS head FROM messages
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 8)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id""")
def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted; every column is read back from the formatted string and its mask."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    messages = given.unionByName(extra).select("conv_id", "turn", "role", chat_parts.text_part(F.col("text")).alias("parts"))
    formatted = chat_parts.format_conversations(messages)
    turns = chat_parts.parse(F.col("formatted"))
    return chat_parts.with_loss_texts(formatted).withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.aggregate("loss_texts", F.lit(0).cast("bigint"), lambda s, t: s + F.length(t)).alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op5_iso_media")
def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as the samples of an ISO media container, and what is read back of it."""
    return iso_media.digests(iso_media.store_texts(table(spark, sf_dir, "documents")))


@query("op6_minmax_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN named m ON m.doc_id = d.doc_id""")
def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_chunk_dedup", rf"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{BLANK}+', ' ', 'g') AS norm FROM documents),
grouped AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM texts JOIN grouped USING (norm)""")
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.digests(pii_boost.find(table(spark, sf_dir, "documents")))


@query("op9_mixing", r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''))) AS ord FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM docs GROUP BY source
), filled AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, (
    SELECT ((SELECT 1.5 * sum(source_size) FROM sources)
      - coalesce(sum(CASE WHEN round > 0 AND weight * level >= 2.0 * source_size THEN 2.0 * source_size END), 0))
      / sum(CASE WHEN round > 0 AND weight * level >= 2.0 * source_size THEN NULL ELSE weight END) FROM sources)::DOUBLE
  FROM filled WHERE round < 30
), targets AS (
  SELECT source, source_size, least(weight * (SELECT level FROM filled WHERE round = 30), 2.0 * source_size)::DOUBLE AS target FROM sources
), running AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS wanted,
    (sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (wanted // greatest(source_size, 1) * size
    + least(greatest(wanted - wanted // greatest(source_size, 1) * source_size - (upto - size), 0), size))::BIGINT AS taken
FROM running""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.cyclic_weights)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document; a tenth of the documents is made periodic beforehand."""
    return periodic_runs.digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic_runs.planted_period))


@query("op12_phrases", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?
-
]+')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, k, phrase, f AS a, cut, string_split(phrase, ' ') AS w FROM counts, range(1, 5) t(cut) WHERE cut < k
), scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n,
    ((1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')
), candidates AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_repeated_spans", r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM places),
holders AS (SELECT g, min(doc_id) AS holder FROM windows GROUP BY g),
hits AS (SELECT doc_id, i FROM windows JOIN holders USING (g) WHERE holder < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hits, range(0, 50) t(o)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""")
def op13_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a smaller id has as well."""
    return rlz_spans.digests(rlz_spans.without_repeats(table(spark, sf_dir, "documents")))
