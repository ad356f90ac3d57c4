"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written and read
again before the next one.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gridmorph.llm.common import Tables, bound_batches, read_table, stored
from gridmorph.llm.host_rules import with_verdicts
from gridmorph.llm.piece_transducer import encoded
from gridmorph.llm.queries import PIECES, tokenizer_path
from gridmorph.llm.simhash import deduplicated
from gridmorph.llm.source_mixing import mixed
from gridmorph.llm.suffix_dedup import without_repeats


#: Intermediate tables of the stage last run, by session and input.
_MADE: dict[tuple[int, str], Tables] = {}


def _stage(f):
    """The stage before has been written when a later one begins, so what that made on the way can go; nothing else does."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        before = _MADE.pop((id(spark), sf_dir), None)
        if before and f.__name__ != STAGES[0][1].__name__:
            before.release(keep=docs)
        with Tables(spark) as made:
            _MADE[id(spark), sf_dir] = made
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's verdict reject."""
    return with_verdicts(docs, keep_rows=True).where("kept").select("row.*")


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return deduplicated(docs, words=5, least=0.8)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier."""
    return without_repeats(docs, 100)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for."""
    return mixed(docs, (1, 2, 3), 1.0, 3.0)


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, with the round trip's figures."""
    return encoded(docs, tokenizer_path(PIECES), with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_copies), ("suffix_array_dedup", repeats), ("source_mixing", mixing), ("sentencepiece", encoding)]

#: Fingerprints, repeated bytes and shortest paths have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with Tables(spark) as written:
            docs = stored(out)
        if before:
            before.release()
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
