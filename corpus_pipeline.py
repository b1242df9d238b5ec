"""Cleaning a corpus of documents: toxic ones go, near copies go, benchmark leaks go, secrets are blanked, and
what is left is encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the columns
of their input, which may have any names. A decision is taken for a row, by a key of its id and text: rows of one id
with different texts, and rows without an id, are judged each by their own text. NULL texts count as empty, repeated
rows share their decision, an empty table gives an empty one. Models are trained on the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voidscope.llm import decontam, nearcopies, secrets, spm, toxicity
from voidscope.llm.common import table
from voidscope.llm.registry import PIECE_MODEL, toxicity_model
from voidscope.session import stage


#: Rows of whole texts in one Arrow batch; a task holds a batch in the JVM and again in Python.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most ``BATCH_ROWS`` rows from here on in this session."""
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _row_key() -> Column:
    """Key of a row, by its id (NULL or not) and text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the row key as id, for operators that return ids."""
    return docs.select(_row_key().alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key stands in ``rejected(doc_id)``; keys are staged so that their size is known."""
    key = _own(docs, "_key")
    gone = stage(rejected.select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return docs.withColumn(key, _row_key()).join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    _small_batches(spark)
    model = toxicity_model(_texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return _without(docs, toxicity.score(_named(docs), model).filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (80 % of the 5-word shingles; candidates by SimHash) the document with the smallest id stays (without an
    id only where the group has none); of repeated rows, one."""
    _small_batches(spark)
    found = stage(nearcopies.classes(_texts(docs)), "near-copies")
    name = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "key1", "key2").alias("row")
    counted = stage(found.groupBy(name).agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "near-rows")
    row = _own(docs, "_row")
    marked = docs.withColumn(row, F.xxhash64(
        F.col("doc_id").isNull(), F.col("doc_id").cast("long"), *nearcopies.text_keys()))
    gone = stage(counted.filter(~F.col("stays")).select(F.col("row").alias(row)), "rejected")
    left = marked.join(gone, row, "left_anti")
    repeated = stage(counted.filter("stays and n > 1").select(F.col("row").alias(row)), "repeated")
    once = left.join(repeated, row, "left_semi").dropDuplicates([row])
    kept = left.join(repeated, row, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    _small_batches(spark)
    return _without(docs, decontam.contaminated(_named(docs), table(spark, sf_dir, "benchmark")))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; ``n_chars`` follows where the text changed."""
    _small_batches(spark)
    own = _own(docs, "_spans")
    found = docs.withColumn(own, secrets.spans_of(F.col("text"), secrets.learn(_texts(docs))))
    base, added = F.col(own)["base"], F.col(own)["added"]
    text = secrets.redact(F.col("text"), base, added)
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out["text"] = text
    if "n_chars" in out:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.size(base) + F.size(added) > 0, length).otherwise(F.col("n_chars"))
    return found.select([c.alias(name) for name, c in out.items()])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, restored`` of every document."""
    _small_batches(spark)
    return spm.round_trip(_texts(docs), PIECE_MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", blank_secrets),
    ("sentencepiece", encode),
]

#: The classifier, the walks and the segmentation have no SQL text; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
