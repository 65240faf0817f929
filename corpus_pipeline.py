"""The corpus pipeline: language ID, quality rules, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result
as Parquet into the shared folder and reads it back as the next stage's input.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from gridweave.llm import langid, quality_rules, simhash, sos_packing
from gridweave.llm.common import materialize

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def language_id(spark, docs, sf_dir):
    """Documents whose language is known (operator 5); the others go."""
    return langid.keep_known(docs)


def quality(spark, docs, sf_dir):
    """Documents that the base rules and their host's verdict keep (operator 3)."""
    return quality_rules.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash group (operator 4)."""
    return simhash.keep_first(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all remaining documents in windows of 2048 ids (operator 9)."""
    return sos_packing.pack(docs).drop("ids")


STAGES = [("language_id", language_id), ("quality_rules", quality), ("simhash_near_dedup", near_dedup),
          ("packing", packing)]


def run(spark, sf_dir):
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
