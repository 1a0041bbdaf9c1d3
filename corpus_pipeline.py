"""The training-corpus pipeline: quality, exact copies, near copies, benchmark passages, segmentations.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but the last
return the columns of documents.

All stages take nulls in any column (a null text counts as empty, a null id as no id), texts of any length, repeated rows, empty
tables (no rows come out) and further columns of any name, which they keep as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm.common import crc_mod, shared_folder, stored, table
from veilgrid.llm.decontaminate import decontaminate
from veilgrid.llm.exact_dedup import drop_exact_duplicates
from veilgrid.llm.near_dedup import drop_similar
from veilgrid.llm.piece_sampling import sample_segmentations
from veilgrid.llm.quality_pairs import fit, keep_good
from veilgrid.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the pairwise ranking, fitted on the labels, scores at its threshold or above.

    Repeated rows are scored alike; without usable labels all stay.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (A-Z lower-cased; null is empty) the one with the largest doc_id, of rows that repeat both one; a null id only where no other is."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group that links of similarity 0.8 or more (5-word shingles) connect the one with the smallest doc_id.

    Texts without words are copies of each other; of rows that repeat the id one stays; a null id only where no other is.
    """
    return drop_similar(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item; with an empty benchmark all, repeated rows as they come."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Up to two different sampled segmentations of each document: doc_id, sample and what sample_segmentations() tells of it.

    A text with just one segmentation, as an empty one, gives one row; repeated rows repeat theirs.
    """
    return sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("segmentations", pieces)]

#: SQL can't fit the ranking or sample the segmentations; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}", folder)
    return docs
