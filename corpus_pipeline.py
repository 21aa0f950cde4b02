"""The corpus pipeline: quality rules, language, near-duplicates, benchmark passages, and the mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents; the last returns the mix in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import langid, ledger, minhash, mixing, winnow
from emberline.llm.common import cut, stored, table

#: Least score of a predicted language for a document to stay.
LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the current policy; those that it rejects go.

    Null and empty texts are too short and go; long ones are measured whole; there are no ties; repeated rows are judged
    each; of an empty table nothing stays. Terms of abuse are learned from the table labels, none where it is absent.
    """
    rows = docs.select("text", F.struct("*").alias("__doc"))  # whatever docs' columns are called, they come back as they were
    terms = ledger.learned_terms(docs, sf_dir)
    return ledger.measure(rows, terms=terms).filter(~ledger.fails("v2")).select("__doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with confidence; its prediction replaces lang. Learns from lang, all rows.

    Texts that are null or without letters have no language and go; long ones are read whole; of equal shares the
    language that sorts first is taken; repeated rows are predicted each; without any lang, or rows, nothing stays.
    """
    model = langid.train(docs)
    names = docs.columns
    safe = {c: f"c{i}_{c}" for i, c in enumerate(names)}  # no name of docs meets one of the prediction
    others = [safe[c] for c in names if c != "doc_id"]
    rows = langid.predict(docs.toDF(*safe.values()), model, key=safe["doc_id"], text=safe["text"], keep=tuple(others))
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)
    return rows.filter(sure).withColumn(safe["lang"], F.col("lang_pred")).select(*(F.col(safe[c]).alias(c) for c in names))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the least doc_id, and one row of each document.

    Of rows that share a doc_id the one with the least hash over all columns stays, so reruns agree. Rows without doc_id
    all stay: they are linked with nothing. Null and empty texts are like nothing; long ones are compared whole; of an
    empty table nothing stays. Texts of repeated ids meet in partial aggregates only, never as a group.
    """
    named = docs.filter("doc_id is not null")
    gone = stored(minhash.near_duplicates(named).filter(~F.col("kept")).select("doc_id").distinct())
    again = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    once = named.join(gone.unionByName(again).distinct(), "doc_id", "left_anti").select(*docs.columns)
    # few rows from here on: those of repeated ids
    rows = named.join(again, "doc_id", "left_semi").join(gone, "doc_id", "left_anti")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = rows.select(F.col("doc_id").alias("__id"), F.xxhash64(F.to_json(whole)).alias("__hash"), whole.alias("__doc"))
    least = stored(marked.groupBy("__id").agg(F.min("__hash").alias("__hash")))
    first = marked.join(least, ["__id", "__hash"], "left_semi").groupBy("__id").agg(F.first("__doc").alias("__doc")).select("__doc.*")
    return once.unionByName(first).unionByName(docs.filter("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Each row is judged by its own text, whether its doc_id is null or repeated. Null and empty texts hold nothing and
    stay; long ones are read whole; without a benchmark item all stay; of an empty table nothing does.
    """
    found = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("__key"), F.col("row").alias("__hit")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(1))  # the row of decontaminate
    rows = docs.select(F.col("doc_id").alias("__id"), own.alias("__row"), F.struct("*").alias("__doc"))
    return rows.join(hit, (rows["__row"] == hit["__hit"]) & rows["__id"].eqNullSafe(hit["__key"]), "left_anti").select("__doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row per copy of a document that training reads, in order of position.

    Null and empty texts have no words and are not read; null source is a source of its own; long texts count whole; of
    equal positions the lesser doc_id comes first; repeated rows are read each; of an empty table the mix is empty.
    """
    return mixing.training_order(mixing.assign(docs))


STAGES = [("quality rules", quality), ("language", language), ("near-duplicates", dedup), ("benchmark passages", decontaminate), ("mix", mix)]

#: SQL expresses neither the language mixture nor MinHash; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
