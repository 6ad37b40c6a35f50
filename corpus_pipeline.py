"""The corpus pipeline: STAGES applied to the documents table in turn.

Stages decide about rows, not ids: a row is named by its id and a hash of
all its columns, so rows without an id and ids that occur twice are judged
apart.  A stage drops rows by an anti-join with the names of what goes;
all stages but the last return the columns of their input.

Defined results: null and empty texts are rejected by the quality rules;
of equal texts and of a group of near copies one row stays (repeated rows
included); an empty table gives an empty result; columns beyond those of
``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeflow.llm.common import table, write_table
from storeflow.llm.exact_dedup import exact_dedup
from storeflow.llm.ngram_join import ngram_jaccard_join
from storeflow.llm.packing import pack_documents
from storeflow.llm.pii import pseudonymise
from storeflow.llm.quality import quality_rules
from storeflow.llm.queries import tokenizer

def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row name: its id, then 128 bits of all columns; and
    that column's name, which no other column has."""
    name = "__name"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("id"), F.unhex(F.md5(every)).alias("row"))), name


def _without(named: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Rows whose name is not among ``gone`` (one column).

    What goes grows with the corpus, so it is never broadcast: the join is
    the same at every size."""
    keys = write_table(gone.toDF(name).distinct(), "pipeline-gone")
    return named.join(keys.hint("merge"), name, "left_anti")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    return _without(named, name, quality_rules(named, id_col=name).where(~F.col("kept")).select("doc_id")).drop(name)


def exact_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    verdict = exact_dedup(named, id_col=name, keep="largest", merge_join=True)
    kept = _without(named, name, verdict.where(~F.col("kept")).select("doc_id"))
    # Rows that repeat in full share their name and verdict: one of them stays.
    repeated = write_table(
        named.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.drop(name)
    once = kept.join(repeated, name, "left_semi").dropDuplicates([name])
    return kept.join(repeated, name, "left_anti").unionByName(once).drop(name)


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, name = _named(docs)
    groups = ngram_jaccard_join(named, k=5, percent=80, id_col=name)
    return _without(named, name, groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")).drop(name)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymise(docs, found_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: every piece with its ids and its place."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=0, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# The quality rules' estimates, the near copies' components over large
# tables, the permutation and the packing cannot be put in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
