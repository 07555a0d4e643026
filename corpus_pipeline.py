"""A training corpus in stages: each takes (spark, docs, sf_dir) and is written before the next reads it.

Quality rules and toxicity drop rows, the n-gram join keeps one document of each group, mixing repeats
or leaves out documents to meet its sources' targets, and SentencePiece turns what is left into ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import mixing, ngram_join, quality_rules, sentencepiece_codec, toxicity
from loomgraph.llm.common import scope, stored, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("toxicity", toxicity.stage),
    ("ngram_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: Learned rules and scores are not SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; tables in between are removed but for the one that it reads."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark):
        for name, stage in STAGES[:-2]:
            with scope(spark):
                docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        name, stage = STAGES[-2]
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
