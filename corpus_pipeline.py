"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage but the last returns the columns of ``documents``. Each row is decided by itself: rows that share an id but not a
text are different documents, and rows without an id are treated like any other. Null texts count as empty, an empty table
stays empty, and other columns pass through whatever their names. Of rows that repeat an id and a text the near-duplicate
stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import jaccard, langid, mixing, pieces, pii
from tesserae.llm.common import saved, small_batches, table

#: A document goes if its language is undecided, or less likely than by chance and this share of what is left above chance.
LEAST_SHARE = 0.2


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("own")[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; it learns from the labelled ones that are not held out. Rows stay where they are."""
    small_batches(spark)
    net = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    chance = 1 / max(1, len(net.names))
    least = chance + LEAST_SHARE * (1 - chance)
    rows = docs.select(F.struct(*docs.columns).alias("own"), langid.language(net, F.col("text")).alias("told"))
    return _own(rows.filter((F.col("told.lang_pred") != langid.UNDECIDED) & (F.col("told.score") >= least)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (links by five-word shingles, similarity of 0.8 or more): that with the smallest id.

    Without an id counts as the greatest; of one id the smaller hash of the text. Of rows that repeat both, the one whose
    other columns come first by a hash stays.
    """
    told = jaccard.jaccard_components(docs, 5, 80, 100).filter("first")
    told = told.select(F.coalesce("doc_id", F.lit(-1)).alias("id_key"), F.col("doc_id").isNull().alias("lost"), "text_key")
    told = saved(told.groupBy("id_key", "lost", "text_key").agg(F.count("*").alias("rows")), "near-first")
    id_ = F.col("doc_id").cast("long")
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    keyed = docs.select(
        F.struct(*docs.columns).alias("own"), F.coalesce(id_, F.lit(-1)).alias("id_key"), id_.isNull().alias("lost"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"), order.alias("order"),
    )
    key = ["id_key", "lost", "text_key"]
    single = keyed.join(told.filter("rows = 1").hint("shuffle_hash"), key, "left_semi").select("own")
    again = told.filter("rows > 1")
    if again.isEmpty():
        return _own(single, docs)
    repeated = keyed.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("own", "order").alias("own"))
    return _own(single.unionByName(repeated.select("own")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by the names of its kinds."""
    found = pii.find_personal_data(docs)
    spans = found.select("doc_id", "text_key", pii.all_spans(F.col("base"), F.col("added")).alias("spans")).filter(F.size("spans") > 0)
    spans = saved(spans.dropDuplicates(["doc_id", "text_key"]), "pii-found")
    held = docs.select(F.struct(*docs.columns).alias("own"))  # names of columns stay apart from ours
    text = F.coalesce(F.col("own.text").cast("string"), F.lit(""))
    same = F.col("own.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key"))
    redacted = F.when(F.col("spans").isNotNull(), pii.redact(F.col("own.text"), F.col("spans"))).otherwise(F.col("own.text"))
    new = {"text": redacted}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNotNull(), F.length(redacted).cast("long")).otherwise(F.col("own.n_chars"))
    return held.join(spans, same, "left").select(*(new.get(c, F.col("own")[c]).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the default mixture draws in at most one epoch."""
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids, decoded_sha256`` of every whole text: its ids, and a digest of the text decoded from them."""
    small_batches(spark)
    return pieces.round_trip(docs).select("doc_id", "n_ids", "ids", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the network nor the bootstrapped patterns; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
