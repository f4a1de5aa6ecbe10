"""Corpus pipeline: the stages a training corpus passes, in order.

    toxicity       documents scored 0.5 or more go
    line dedup     lines of earlier documents go, texts are rewritten
    n-gram join    of each group of near duplicates the smallest id stays
    suffix dedup   bytes of strings that start in an earlier document go
    packing        what is left, tokenised and placed in windows of 4096 ids

Every stage reads what the one before wrote and works on all of it.  All but
the last return the columns of ``documents``; n_chars is kept true.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from tierwatch.llm import jaccard, linededup, packing, suffixdedup, toxicity as tox  # noqa: E402
from tierwatch.llm.common import read_table, shared_path  # noqa: E402
from tierwatch.llm.queries import WORD_BPE  # noqa: E402


#: The columns beside id and text travel in one struct, under names of ours, so
#: that none of them meets a column that an operator adds.
REST = "_rest"


def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, text and the struct of the others, the others' names)."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = [F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)]).alias(REST)] if rest else []
    return docs.select("doc_id", "text", *held), rest


def _unpacked(out: DataFrame, rest: list[str], like: DataFrame, rewritten: bool = False) -> DataFrame:
    """The columns of ``like``; of rewritten texts n_chars is counted anew."""
    held = {c: F.col(REST)[f"c{i}"] for i, c in enumerate(rest)} | {c: F.col(c) for c in ("doc_id", "text")}
    if rewritten and "n_chars" in held:
        held["n_chars"] = F.length("text").cast(like.schema["n_chars"].dataType)
    return out.select(*[held[c].alias(c) for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tox.fit(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    held, rest = _carried(docs)
    return _unpacked(tox.score(held, model, *held.columns[1:]).where("score < 0.5"), rest, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, rest = _carried(docs)
    return _unpacked(linededup.drop_repeated_lines(held), rest, docs, rewritten=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a group: that of the smallest id, of its texts the one with the
    smallest hash.  Texts of one id in different groups are decided each by
    its own group; rows without id link to nothing and stay."""
    held, rest = _carried(docs)
    named = held.withColumn("_name", F.coalesce(F.sha2("text", 256), F.lit("")))
    linked = jaccard.link_components(named, jaccard.WORDS, jaccard.PERCENT, "_name").where("doc_id = component_id")
    alone = F.when(F.col("n_shingles") == 0, F.col("_name"))         # without shingles: a group by itself
    stays = linked.groupBy("doc_id", "root", alone.alias("_alone")).agg(F.min("_name").alias("_name"))
    kept = named.join(stays.select("doc_id", "_name"), ["doc_id", "_name"], "left_semi").dropDuplicates(["doc_id", "_name"])
    return _unpacked(kept.select(*held.columns).unionByName(held.where("doc_id is null")), rest, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held, rest = _carried(docs)
    cut = suffixdedup.remove_repeats(held, *held.columns[2:], as_text=True)
    return _unpacked(cut.withColumnRenamed("kept", "text"), rest, docs, rewritten=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), WORD_BPE)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
