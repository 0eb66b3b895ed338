"""The corpus pipeline: quality, line dedup, near-dup removal, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All
but the last return the columns of ``docs``; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopweave.llm import decontaminate, linededup, minhash, packing, quality
from shopweave.llm.common import materialize, new_path, read_table
from shopweave.llm.queries import quality_model, tokenizer_path
from shopweave.sources.storage import mark, release, remove

#: Ids that may be broadcast to drop them; beyond that they are joined.
BROADCAST_IDS = 1_000_000


def _set_apart(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator's own columns have."""
    return docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns})


def _put_back(frame: DataFrame, docs: DataFrame) -> DataFrame:
    return frame.select(*[frame[f"_doc_{c}"].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; without labels of both classes all stay.

    A null text is scored as an empty one, and a text of any length by all its passages. Every row is
    judged by its text alone: equal rows, and rows of one id or none, have one fate for each text.
    """
    model = quality_model(spark, docs, sf_dir)
    if model is None:
        return docs
    return _put_back(quality.score(_set_apart(docs), model, text_col="_doc_text").where("score >= 0.7"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` follows the text.

    No document goes: one whose lines all go keeps an empty text, as a null text becomes an empty one.
    Each row is a document, so equal rows and rows of one id count as often as they occur.
    """
    out = _put_back(linededup.drop_common_lines(_set_apart(docs), id_col="_doc_doc_id", text_col="_doc_text"), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the least id, null ids last; of equal ids, any one.

    Rows are told apart by a number of their own, so equal rows are copies, and rows of one id
    with different texts are not. Null and empty texts, and texts without a word, all stay.
    """
    rows = materialize(_set_apart(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    linked = materialize(minhash.link(rows, id_col="_row", text_col="_doc_text", k=5, percent=80).select("_row", "component_id", "kept"), "linked")
    groups = linked.where("NOT kept").select("component_id").distinct()
    ids = rows.select("_row", F.col("_doc_doc_id").alias("id"))
    members = linked.join(groups, "component_id", "left_semi").join(ids, "_row")
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row"))["_row"].alias("_row"))
    gone = materialize(members.select("_row").join(stays.select("_row"), "_row", "left_anti"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return _put_back(rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all words of a shorter one, go.

    Each row is judged by its text alone; null and empty texts stay, as do all without a benchmark.
    """
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its sequence of at most 2048 tokens and its place there.

    A null or empty text is one piece, the end id. Equal rows, and rows of one id, are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again.

    What a stage has stored on its way goes once its rows are written, and those rows once the next stage's are;
    so nothing else may store tables of the library in this process meanwhile.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        own = mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since=own)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
