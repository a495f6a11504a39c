"""The numbered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import (
    _shared,
    bpe,
    chat_format,
    decontaminate,
    license_scan,
    line_dedup,
    near_dedup,
    pii,
    quality_rules,
    repeated_windows,
    resampling,
    token_counts,
    token_shards,
    vector_codes,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    return bpe.digest_documents(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and boosted-tree verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.assess(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after repeated chunks of lines were cut, as a digest, with the lines that went."""
    cut = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "removed_lines",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.BASE_KINDS]
    counts = [(F.size(kinds) - left).cast("long").alias(f"n_{k}") for k, left in zip(pii.BASE_KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back."""
    hard = "\\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    messages = given.unionByName(extra).withColumn("parts", chat_format.text_part())
    return chat_format.read_back(chat_format.format_turns(messages))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: a heading, a cut in the middle, a closing word.

    The edits follow from the document alone: ``# doc_id`` and a blank line go before the text, the fifth of the text
    that begins at its third is replaced by ``...``, and `` End.`` goes behind the text as it then stands.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text").cast("long")
    heading = F.concat(F.lit("# "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    heading = F.coalesce(heading, F.lit(""))
    cut_from, cut_to = F.floor(n / 3).cast("long"), (F.floor(n / 3) + F.floor(n / 5)).cast("long")
    grown = F.length(heading).cast("long")
    final = n + grown - (cut_to - cut_from) + 3
    edits = [(F.lit(0).cast("long"), F.lit(0).cast("long"), heading), (grown + cut_from, grown + cut_to, F.lit("...")), (final, final, F.lit(" End."))]
    changes = F.array(*(F.struct(a.alias("start"), b.alias("end"), r.alias("replacement")) for a, b, r in edits))
    return token_counts.count_edited(docs.withColumn("edits", changes), RANKS, PATTERN)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of benchmark items, with substitutions."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token sequences written to shards in permuted order, into a lasting folder; where each document's ids went."""
    docs = table(spark, sf_dir, "documents")
    return token_shards.materialise(docs, _shared.new_path(spark, "shards", lasting=True), RANKS, PATTERN, end_id=50256, key=2024)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors alone and by label, and the codebooks as a digest."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return vector_codes.with_label_errors(coded).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.array_join(digits, "").alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark texts, its score and its place in the draw."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the words that windows of smaller documents hold."""
    found = repeated_windows.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_key")).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_shards": op9_token_shards,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_target_resampling": op12_target_resampling,
    "op13_repeated_windows": op13_repeated_windows,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HARD = "\\### Assistant: </turn> ok"



def _lloyd(n: int) -> str:
    """CTEs of one round: the nearest entry of each distinct part, and the entries after it."""
    return f"""a{n} AS ({_nearest(f"c{n}")}),
    m{n} AS (SELECT pos, e, d, CAST(floor(sum(w * CAST(part[d] AS HUGEINT)) / sum(w)) AS BIGINT) AS x FROM a{n}, unnest(range(1, len(part) + 1)) t(d) GROUP BY ALL),
    l{n} AS (SELECT pos, e, list(x ORDER BY d) AS part FROM m{n} GROUP BY ALL),
    c{n + 1} AS (SELECT c.pos, c.e, coalesce(l.part, c.part) AS part FROM c{n} c LEFT JOIN l{n} l USING (pos, e))"""


def _nearest(books: str) -> str:
    far = "list_sum(list_transform(list_zip(u.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""SELECT pos, part, w, e, far FROM (SELECT u.pos, u.part, u.w, c.e, {far} AS far FROM u JOIN {books} c USING (pos)) QUALIFY row_number() OVER (PARTITION BY pos, part ORDER BY far, e) = 1"""


_WORDS = f"""coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"""

#: The queries that SQL can express; the others are held against plain versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}'),
    e AS (SELECT *, length(text) + length(replace(text, '<', '<<')) + length(replace(text, '\\', '\\\\')) - 2 * length(text) AS body FROM m)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(role) + body + 16) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens, CAST(0 AS BIGINT) AS n_attachments FROM e GROUP BY conv_id""",
    "op8_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0), s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT vec_id, label, pos, v[pos * (len(v) // 16) + 1:(pos + 1) * (len(v) // 16)] AS part FROM k, range(16) t(pos)),
    u AS (SELECT pos, part, count(*) AS w FROM p GROUP BY ALL),
    f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
    c0 AS (SELECT pos, e, part FROM p JOIN f USING (vec_id)), {_lloyd(0)}, {_lloyd(1)}, z AS ({_nearest("c2")}),
    o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error FROM p JOIN z USING (pos, part) GROUP BY ALL),
    b AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) AS s FROM c2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM o, b""",
    "op13_repeated_windows": """WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    s AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS g FROM d, unnest(range(1, len(w) - 48)) t(k)),
    f AS (SELECT doc_id, k FROM s QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
    gone AS (SELECT DISTINCT doc_id, k + j AS p FROM f, range(50) t(j)), p AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) t(p)),
    l AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)""",
    "op12_target_resampling": f"""WITH c0 AS (SELECT n, n AS c, 0 AS k FROM range(256) t(n)), {", ".join(f"c{k + 1} AS (SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM c{k})" for k in range(8))},
    tab AS (SELECT list(c ORDER BY n) AS t FROM c8),
    w AS (SELECT side, id, {_WORDS} AS w FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
    f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM w),
    g AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL), x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
    b AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
    s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM g JOIN b USING (f) GROUP BY ALL), z AS (SELECT sum(s) AS zs, sum(t) AS zt FROM s),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(zs + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(zt + 10000 AS DOUBLE)))) AS BIGINT) AS v FROM s, z),
    d AS (SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * v) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM g JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY ALL),
    e AS (SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words, CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d ON id = doc_id WHERE side = 0),
    k AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY n_words >= 20) * 25 // 100 AS top FROM k)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND p <= top THEN p END AS rank FROM r""",
}
