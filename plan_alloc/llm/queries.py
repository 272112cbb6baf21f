"""Registered queries of the operators: each on its whole table, with production parameters.

DuckDB SQL is given where it can express a result; for the others its text
functions and hashes can't, and tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plan_alloc.llm import ann, decontaminate, embedding_dedup, html_extract, line_dedup, packing, periodic_runs, simhash, spelling, suffix_dedup, token_counts, toxicity, url_filter
from plan_alloc.llm.common import lower_ascii, read

#: Host, path and verdict of the rules.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(read(spark, sf_dir, "documents"), words=3, max_bits=3)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), RULES)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.dedup(read(spark, sf_dir, "documents"), length=100)
    return cleaned.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run")).where(F.length("run") >= 7)
    # The letters that the contract takes out, by the checksum of id and word.
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, F.concat(F.left("run", at), F.right("run", F.length("run") - at - 1))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= 7).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return spelling.group(words, ratio=10)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # The repetitions that the contract plants, by the checksum of the id.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("w")
    planted = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumn("a", F.when(n > 0, g % n))
    planted = planted.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.col("w")[(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")]))
    texts = planted.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.collapse(texts, least=6, times=4)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_decontaminate, op3_simhash, op4_url_filter, op5_ann, op6_toxicity, op7_line_dedup, op8_html_extract, op9_suffix_dedup, op10_token_counts, op11_spelling, op12_embedding_dedup, op13_periodic_runs, pipeline)
}

#: Cosines of all pairs, and components by the smallest id reachable along the links.
ORACLE: dict[str, str] = {
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reach AS (
    SELECT a AS vec_id, b AS other FROM links
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.other, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.other, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN least c ON c.vec_id = e.vec_id""",
}
