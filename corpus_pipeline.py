"""The corpus pipeline: quality rules, language ID, near-duplicate groups, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  run()
writes each stage's result to the shared folder and reads it again as the next stage's documents.

Nulls: a null text has no words, so the quality stage takes it away; given to a later stage, it is no language (goes), no copy
(stays), holds no secret, and is packed as its end id alone.  A null doc_id, lang or source is a value like any other; documents without an
id are never copies.  Repeated rows: one stays.  Ties: of equal texts the smallest id stays.  An empty table gives an empty result at
every stage.  Further columns of documents are kept up to the packing, whatever their names; those of the stages' own counts
are not taken over.  Texts of any length go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, packing, quality_rules, secret_scan
from tessera.llm.common import free, materialize, tokenizer_path
from tessera.llm.queries import BYTES, RANKS, table

#: A text is turned away by the language stage if it has no letter or no language reaches this share.
LEAST_SCORE = 0.3
#: Near copies share this percentage of their shingles, of so many words.
SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, keep_text=True).filter("kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: texts of no language.  lang takes the predicted language where it was null."""
    said = language_id.predict(docs, language_id.fit(docs), keep_text=True)
    kept = said.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one text stays, once: that of the smallest id, and of an id's own texts the one with
    the smallest SHA-256; of rows that repeat both and differ elsewhere the one whose other columns have the smallest SHA-256 as JSON.  Texts are judged one
    by one: an id's other texts stay.  Documents without an id all stay.
    Near copies link at a Jaccard similarity of 0.8 over five words (op7 alone: 0.85 over four)."""
    known = docs.filter("doc_id IS NOT NULL")
    if not known.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        groups = jaccard_join.similar_groups(known, SHINGLE_WORDS, PERCENT)
        gone = groups.filter("doc_id <> component_id").select("doc_id")
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    # an id may have several texts: each is a node of its own
    marked = known.withColumn("__mark", F.coalesce(F.sha2("text", 256), F.lit("")))
    texts = materialize(marked.select("doc_id", "text", "__mark").dropDuplicates(["doc_id", "__mark"]).withColumn("__node", F.monotonically_increasing_id()), "texts")
    groups = jaccard_join.similar_groups(texts.select(F.col("__node").alias("doc_id"), "text"), SHINGLE_WORDS, PERCENT).select(F.col("doc_id").alias("__node"), "component_id")
    stays = texts.select("__node", "doc_id", "__mark").join(groups, "__node").groupBy("component_id").agg(F.min(F.struct("doc_id", "__mark")).alias("m")).select("m.*")
    kept = marked.join(stays.hint("shuffle_hash"), ["doc_id", "__mark"], "left_semi")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    one = kept.groupBy("doc_id", "__mark").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.sha2(others, 256)).alias("__row"))
    return one.select("__row.*").unionByName(docs.filter("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced; n_chars follows the text."""
    id_, hash_, text_hash, masks = (free(x, docs.columns) for x in ("__id", "__hash", "__text_hash", "__masks"))
    found = secret_scan.find_secrets(docs).filter(F.size("masks") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("masks").alias(masks)).dropDuplicates([id_, hash_])
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    joined = keyed.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)), "left")
    clean = joined.withColumn("text", F.when(F.col(masks).isNull(), F.col("text")).otherwise(secret_scan.redact(F.col("text"), F.col(masks))))
    return clean.withColumn("n_chars", F.when(F.col(masks).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(BYTES), tokenizer_path(RANKS))


STAGES = [("quality_rules", quality), ("language_id", language), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("packing", pack)]

#: Learned models and a tokenizer are part of the stages: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
