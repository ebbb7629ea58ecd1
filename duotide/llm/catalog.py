"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duotide.llm import automaton, hnsw, lattice, lines, packing, quality, rules, secrets, simhash, spelling, template, text, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.table(spark, sf_dir, "documents")
    labels = text.table(spark, sf_dir, "labels").where(text.remainder("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (text.remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(text.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = f"""
WITH {rules.measures_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(text.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.table(spark, sf_dir, "documents").select("doc_id", "text", (text.remainder("doc_id", 7) == 2).alias("held_out"))
    return lattice.score(docs, "held_out", tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(text.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template.main_text(text.table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.near_duplicates(text.table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton.round_trip(text.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(text.table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ids whose crc32 modulo 5 is 0 are held out."""
    docs = text.table(spark, sf_dir, "documents")
    labels = text.table(spark, sf_dir, "labels").where(text.remainder("doc_id", 5) != 0)
    found = quality.posteriors(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (text.remainder("doc_id", 5) == 0).alias("held_out"), "evidence", "host_prior", "path_prior", "score", (F.col("score") >= 0.5).alias("kept"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(text.table(spark, sf_dir, "documents"))


def op12_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null; it stays exact in the operator's decimal."""
    found = whitening.whiten(text.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_shared_lines(text.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = (
    op1_nearest_toxic,
    op2_quality_rules,
    op3_simhash,
    op4_lattice_lm,
    op5_curve_packing,
    op6_template_text,
    op7_vector_links,
    op8_bpe_automaton,
    op9_secret_scan,
    op10_site_quality,
    op11_spelling_variants,
    op12_whitened_vectors,
    op13_line_dedup,
    pipeline,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op13_line_dedup": lines.lines_sql()}
