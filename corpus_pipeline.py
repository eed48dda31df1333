"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark
leaks, packing. Each stage takes (spark, docs, sf_dir) and works on all that
the stage before it kept."""

from __future__ import annotations

from tessera.llm import common, decontamination, packing, passages, quality, simhash
from tessera.llm.queries import vocabulary

#: SQL can't express the stages; tests hold near-duplicates against brute force.
ORACLE_SQL = None


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier (8) keeps."""
    return quality.keep(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates (7)."""
    return simhash.deduplicate(docs)


def substring_dedup_stage(spark, docs, sf_dir):
    """Texts without passages that an earlier document holds (6)."""
    return passages.cut(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark item (5)."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Sequences of at most 4096 tokens (3)."""
    return packing.best_fit_pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark, sf_dir):
    """Applies the stages to documents; each result is written and read again."""
    scratch = common.Scratch(spark)
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
