"""The operators of this package bound to the tables: one query each, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import ann, decontaminate, dialogues, ngrams, packing, quality, secrets, simhash, substrings, tokenfiles, urlgraph, warc, whitening
from fleetloom.session import scratch_path

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the share of the item and its changed slots."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), any_case=True, null_ids=True)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no repeated window of 35 words covers, counted and digested."""
    digest = lambda kept: F.sha2(F.encode(kept, "UTF-8"), 256)  # noqa: E731
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), of_kept=digest).withColumnRenamed("kept", "kept_sha256")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a ranking learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    ranking = quality.learn(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, ranking)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document: three words, 64 bits, radius 3."""
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=3)
    return classes.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rule, else by its host's trust and distrust."""
    return urlgraph.judge(_table(spark, sf_dir, "pages"))


def op7_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, those of the fixed patterns counted and digested apart."""
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")  # noqa: E731
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.encode(secrets.stated("base"), "UTF-8"), 256).alias("base_sha256"),
        secrets.stated("spans").alias("spans"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = scratch_path(spark, "tokens")
    tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return tokenfiles.read_token_files(spark, path)


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; digest and length of a response are those of the payload that was read."""
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path)
    response = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op11_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of word n-grams, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = ngrams.chunks(docs, F.crc32(docs["doc_id"].cast("string")) % 7 == 2)
    return ngrams.score(found, ngrams.learn(found))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cheapest repair of every conversation takes after rows of all were damaged by a fixed rule."""
    given = _table(spark, sf_dir, "conversations")
    return dialogues.audit(dialogues.damage(given), of=given)


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the eight components of largest variance; a deviation beyond 64 bits is null."""
    found = whitening.components_of(_table(spark, sf_dir, "embeddings"), components=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_template_leaks,
        op2_best_fit_packing,
        op3_repeated_passages,
        op4_pairwise_quality,
        op5_simhash_near_duplicates,
        op6_host_trust,
        op7_multi_index_neighbours,
        op8_secret_scan,
        op9_token_files,
        op10_warc_archives,
        op11_ngram_scores,
        op12_conversation_repair,
        op13_refined_whitening,
    )
}

def _repair_sql() -> str:
    """Damage by crc32, faults, then the four states of the grammar row by row, each with its least cost and edits."""
    crc = """xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b:
      xor(a >> 8, list_reduce([xor(a, b) & 255] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295)"""
    way = lambda state, price, edits: f"{{'c': {state}.c + {price}, 'e': {state}.e || '{edits}'}}"  # noqa: E731
    never = "{'c': 1000000000, 'e': ''}"
    #: insertions after which each state may take a turn of the user or of the assistant
    before = {"u": [("s0", 0), ("ss", 0), ("sa", 0), ("su", 1), ("s0", 2), ("ss", 2), ("sa", 2)], "a": [("su", 0), ("s0", 1), ("ss", 1), ("sa", 1), ("su", 2)]}

    def least(state: str, initial: str) -> str:
        ways = [way(state, 2, "D")]
        for source, n in before.get(initial, []):
            ways.append(f"CASE WHEN gone THEN {never} ELSE {way(source, f'{5 * n + 1} + extra', 'I' * n + 'R')} END")
        for source, n in before.get(initial, [("s0", 0)]):
            ways.append(f"CASE WHEN gone OR init <> '{initial}' THEN {never} ELSE {way(source, f'{5 * n} + extra', 'I' * n + 'K')} END")
        return f"list_min([{', '.join(ways)}])"

    return rf"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, left(role, 1) AS init,
  regexp_replace(text, '[ 	-]+$', '') AS bare FROM damaged),
marked AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM numbered),
r AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
  CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 5 END AS extra, n > 1 AND lag(init) OVER (PARTITION BY conv_id ORDER BY n) || init NOT IN ('su', 'ua', 'au') AS odd FROM marked),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'e': ''}} AS s0, CAST({never} AS STRUCT(c BIGINT, e VARCHAR)) AS ss, CAST({never} AS STRUCT(c BIGINT, e VARCHAR)) AS su,
    CAST({never} AS STRUCT(c BIGINT, e VARCHAR)) AS sa FROM conversations
  UNION ALL SELECT v.conv_id, r.n, {way('s0', 2, 'D')}, {least('ss', 's')}, {least('su', 'u')}, {least('sa', 'a')}
  FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.n = v.n + 1),
ends AS (SELECT conv_id, list_min([s0, sa, {way('su', 5, 'I')}, {way('ss', 10, 'II')}]) AS s FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
letters AS (SELECT conv_id, unnest(range(1, length(s.e) + 1)) AS p, s.e AS e FROM ends),
placed AS (SELECT conv_id, p, e[p] AS edit, length(replace(e[1:p], 'I', '')) AS n, length(replace(e[1:p], 'D', '')) AS place FROM letters),
said AS (SELECT l.*, r.role, r.text, max(l.place = 1 AND l.edit = 'K' AND r.init = 's') OVER (PARTITION BY l.conv_id) AS system
  FROM placed l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.n = l.n AND l.edit <> 'I' WHERE l.edit <> 'D'),
turns AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place % 2 = 1) <> system THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM said GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
  count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM r GROUP BY 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  s.c AS cost, s.e AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""


# Scores, fingerprints under a seeded hash, token ids, packings and learned models are beyond SQL; those queries are tested against brute force.
SQL: dict[str, str] = {
    "op3_repeated_passages": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT h FROM starts GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM starts SEMI JOIN again USING (h)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op10_warc_archives": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN m USING (d)
""",
    "op12_conversation_repair": _repair_sql(),
}
