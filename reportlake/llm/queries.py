"""The queries of the corpus operators, by the name they are registered under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import decontaminate, language, lines, minhash, neighbours, packing, pii, quality, suffixes, urls
from reportlake.llm.common import table

ORACLES: dict[str, str] = {}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def added(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: ~s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_added_{kind}")

    total = F.size("spans").cast("long").alias("n_all")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *map(added, (*pii.KINDS, "secret")), total)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_near_duplicates"] = minhash.near_duplicates_sql("documents")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontamination"] = decontaminate.find_sql("documents", "benchmark")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, lambda k: fold(k, 4) != 2)
    return language.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = f"select doc_id, n_lines, n_removed, sha256(text) as kept_sha256 from ({lines.clean_sql('documents')})"


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 5) != 0)
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_pii, op2_near_duplicates, op3_packing, op4_neighbours, op5_urls, op6_suffixes, op7_decontamination, op8_language, op9_line_dedup, op10_quality)}
