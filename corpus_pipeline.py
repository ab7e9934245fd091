"""A training corpus out of raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last
return the columns of ``docs``; the last returns the documents of the mix with their number of copies.
Rows that agree in ``doc_id`` and text are one document to the second and the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stopwise.llm.common import row_key, staged, table
from stopwise.llm.decontamination import uncontaminated
from stopwise.llm.mixing import mix
from stopwise.llm.near_duplicates import near_duplicates
from stopwise.llm.secret_scan import redacted, scan_secrets
from stopwise.llm.toxicity import learn, score_toxicity

REJECT = 0.5  # toxicity at which a document goes


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below ``REJECT``; null and empty texts score 0 and stay."""
    network = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, network, "_toxicity_score")
    return scored.filter(F.col("_toxicity_score") < REJECT).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (5-word shingles, Jaccard 0.8): the smallest ``doc_id``.

    Texts without a word are in no group and all stay.
    """
    found = staged(near_duplicates(docs), "near-duplicates")
    gone = found.filter("NOT kept AND n_shingles > 0").select(F.col("mark").alias("_mark")).distinct()
    marked = docs.withColumn("_mark", row_key())
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = marked.filter(~blank).join(gone, "_mark", "left_anti").dropDuplicates(["_mark"])
    return left.unionByName(marked.filter(blank)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no ten consecutive words of a benchmark item occur."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets are replaced by a mark, and ``n_chars`` follows the text."""
    found = scan_secrets(docs, column="_secret_spans")
    has = F.size("_secret_spans") > 0
    clean = found.withColumn("text", redacted(F.col("text"), F.col("_secret_spans")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(has, length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: the columns of ``docs``, and ``copies``, ``size``, ``taken``, ``target``.

    A document that the mix leaves out has no row.
    """
    keyed = docs.withColumn("_mark", row_key())
    mixed = mix(keyed.withColumn("doc_id", F.col("_mark")), key="string").filter("taken > 0")
    taken = mixed.groupBy("doc_id").agg(
        F.sum(F.expr("taken DIV size")).cast("int").alias("_copies"),
        F.first("size").alias("_size"),
        F.sum("taken").alias("_taken"),
        F.first("target").alias("_target"),
    )
    rows = keyed.dropDuplicates(["_mark"]).join(taken.withColumnRenamed("doc_id", "_mark"), "_mark")
    own = [c for c in docs.columns if c not in ("copies", "size", "taken", "target")]
    return rows.select(
        *own,
        F.col("_copies").alias("copies"),
        F.col("_size").alias("size"),
        F.col("_taken").alias("taken"),
        F.col("_target").alias("target"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

ORACLE_SQL = None  # learned scores, tests of randomness and subset sums are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
