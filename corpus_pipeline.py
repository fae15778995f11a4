"""From raw documents to token ids: quality, near duplicates, benchmark leaks, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.llm import quality
from veilstat.llm.decontaminate import Decontaminator
from veilstat.llm.jaccard import JaccardJoin
from veilstat.llm.queries import table, vocabulary
from veilstat.llm.sample import remainder
from veilstat.llm.secrets import redact
from veilstat.llm.store import Scratch, free_name
from veilstat.llm.tokenize import round_trip


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more."""
    model = quality.train(spark, docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    name = free_name(docs, "__score")
    return quality.score(spark, docs, model, name).where(F.col(name) >= 0.3).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates. Rows with a null doc_id stay.

    Of rows that are equal in doc_id and text one stays. Where one doc_id has several texts each is a document of its own; in a group they
    come after the documents whose doc_id is theirs alone, in the order of a hash.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        rows = JaccardJoin(spark).run(docs)
        gone = rows.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    key, several = free_name(docs, "__key"), free_name(docs, "__several")
    named = docs.join(twice.withColumn(several, F.lit(True)), "doc_id", "left")
    own = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    named = named.withColumn(key, F.when(F.col(several), own).otherwise(F.col("doc_id").cast("long")))
    rows = JaccardJoin(spark).run(named.select(F.col(key).alias("doc_id"), "text"))
    gone = rows.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    left = named.join(gone.hint("merge"), key, "left_anti")
    alone = left.where(F.col(several).isNull())
    return alone.unionByName(left.where(several).dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return Decontaminator(spark).clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and their lengths set anew."""
    out = redact(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and digests of the ids and of the text decoded from them."""
    return round_trip(docs, vocabulary(), ids_too=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding", token_ids),
]

#: The classifier is trained here, so SQL can't express run(); the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
