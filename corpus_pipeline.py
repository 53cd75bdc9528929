"""Corpus pipeline: language ID, exact de-duplication, near-duplicates, repeated passages, packing.

Stages that look at documents by number know a row by its place in the stage's input files, so NULL and repeated doc_ids and
equal rows are kept apart.
"""
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from floetrack.llm import centroid, exact, jaccard, packing, pfp
from floetrack.llm.common import crc_mod, written


PASSAGE_WORDS, PASSAGE_BYTES = 50, 240  # a repeated passage: so many words at least, in a string of so many bytes


def numbered(docs):
    """Rows with ``__row``: number of the file and position in it, the same however the files are split or read again."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:  # not read from files: written once, numbers and all
        return written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    names = sorted(r[0] for r in rows.select("__file").distinct().collect())  # the list of files, as Spark's driver holds it anyway
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), "__number long, __file string")
    return rows.join(F.broadcast(files), "__file").withColumn("__row", F.shiftleft("__number", 40) + F.col("__at")).drop("__file", "__at", "__number")


def language(spark, docs, sf_dir):
    """Rejects texts without a letter and texts far from every language's centroids; the rest stays as it is."""
    model = centroid.fit(docs, crc_mod("doc_id", 3) != 1)
    return centroid.predict(docs, model, carry=True).where("not distant").select("row.*")


def exact_copies(spark, docs, sf_dir):
    """One row of each group of equal texts stays."""
    kept = written(exact.dedup(docs).where("kept").groupBy("doc_id", "locator").agg(F.count("*").alias("times")), "kept")
    same = docs.withColumn("__locator", F.xxhash64(F.coalesce("text", F.lit(""))))
    k = kept.withColumnsRenamed({"doc_id": "__id", "locator": "__at"})
    out = same.join(k, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__locator") == F.col("__at")), "left_semi")
    if not kept.where("times > 1").isEmpty():  # whole rows repeated: one of them
        out = out.dropDuplicates(["doc_id", "__locator"])
    return out.select(docs.columns)


def near_copies(spark, docs, sf_dir):
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays: the smallest doc_id."""
    rows = numbered(docs)
    found = written(jaccard.near_duplicates(rows, key="__row", k=5, percent=80), "near").select("__row", "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__row")).alias("best")
    kept = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(best).select(F.col("best.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def repeated_passages(spark, docs, sf_dir):
    """Cuts passages of 50 words or more that repeat, within or across documents; shorter repeats and all other bytes stay.

    A passage is a run of bytes covered by 240-byte strings that occur twice; a character cut in half is dropped; n_chars
    follows the text. NULL texts stay NULL.
    """
    rows = numbered(docs)
    cut = pfp.cut_repeats(rows, key="__row", length=PASSAGE_BYTES, every=20, keep_text=True, least_words=PASSAGE_WORDS).select("__row", "n_removed", "kept")
    out = rows.withColumn("__null", F.col("text").isNull()).drop("text").join(cut, "__row").withColumn("text", F.when(~F.col("__null"), F.col("kept")))
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(docs.columns)


def packed(spark, docs, sf_dir):
    """Packs the remaining texts into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages), ("packing", packed)]
ORACLE_SQL = None  # a fitted classifier and a tokenizer are not SQL; tests hold every stage against brute force


def run(spark, sf_dir):
    """Apply every stage to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
