"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.llm._session import table, work_path, written
from glyphgrid.llm.huffman_tokens import tokenised
from glyphgrid.llm.minhash_dedup import MinHashSettings, minhash_dedup
from glyphgrid.llm.mixing import mixed_documents
from glyphgrid.llm.packing import pack_tokens, places
from glyphgrid.llm.suffix_dedup import suffix_dedup
from glyphgrid.llm.toxicity import fit_toxicity, tag_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is one half or more go."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return tag_toxicity(docs.select(*COLUMNS), model).where("toxic_score < 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, linked at a similarity of 0.8 or more, stays, that of the smallest id, or
    one without an id where none has any. Rows are told apart by a number, not by their id: texts of one id that are
    not alike both stay, copies without an id become one. Texts without words all stay."""
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = minhash_dedup(rows, "_row", settings=MinHashSettings(percent=80)).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")
    kept = rows.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out, to whole letters; no document goes."""
    cut = suffix_dedup(docs, carry=("lang", "source"), text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), F.col("c_lang").alias("lang"), F.col("c_source").alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, for a budget of the corpus's own size."""
    return mixed_documents(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the token ids of each document, or of a piece of one, stand in the training sequences, read back from there."""
    import public_tokenizers

    tokens = tokenised(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return places(written(pack_tokens(tokens.where("token is null").select("doc_id", "n_tokens", "width", "ids")), "bins"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: The score of a trained field can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
