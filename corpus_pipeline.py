"""Five stages from raw documents to a mix plan; each works on all that the one before it kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrane.functions.scratch import drop, materialize, materialize_at
from terrane.llm import decontaminate, linededup, mixing, nearcopies, qualityrules
from terrane.sources.tables import table


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text, and all else as one column, so that no name of it meets one that an operator uses."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.col("text").isNull().alias("__null")).alias("__rest"))


def _unpacked(df: DataFrame, columns: list[str], fresh: dict[str, Column] | None = None) -> DataFrame:
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("text")} | (fresh or {})
    return df.select(*[fresh[c].alias(c) if c in fresh else F.col(f"__rest.{c}").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null, empty and blank texts are rejected; rows that repeat a document and rows without id are judged by their text; an
    empty table gives no rows; without labels only the base rules hold. Very long texts are judged whole. All columns come back,
    whatever their names; the first rule that holds decides.
    """
    rules = qualityrules.train(docs, table(spark, sf_dir, "labels"))
    kept = qualityrules.apply_rules(_packed(docs), rules, keep=["text", "__rest"])
    return _unpacked(kept.where("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep. A null text that loses nothing stays null.

    The largest id that holds a line keeps it; rows that repeat that id all do. Rows without id lose nothing; very long texts are read whole, by
    lines; an empty table gives no rows. All columns come back, whatever their names.
    """
    out = linededup.dedup_lines(_packed(docs), keep=["__rest"])
    out = out.select("doc_id", F.when(~F.col("__rest.__null"), F.col("kept_text")).alias("text"), "__rest")
    fresh = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _unpacked(out, docs.columns, fresh)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows that repeat it, or its id, go; rows without id stay.

    Very long texts are compared whole, by all of their shingles. Texts without words are one group; of rows with one id the one whose text hashes smallest stays; an empty table gives no rows.
    """
    found = nearcopies.near_copies(docs, shingle=5, similarity=0.8)
    stay = materialize(found.where("doc_id = component_id").select("doc_id").distinct(), "stay")
    kept = docs.where(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    once = kept.withColumn("__nth", first).where("__nth = 1").select(*docs.columns)
    return once.union(docs.where(F.col("doc_id").isNull()).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; very long ones are read whole. Of documents with one id, all go if one holds an item; rows without id stay, as they
    cannot be told apart. Empty tables change nothing. All columns come back, whatever their names.
    """
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(hits.select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix plan, in the order of training.

    A null text has no words and is not taken; a null source is a source, the last; rows without id and repeated rows
    are documents of their own; of a very long text its number of words counts; an empty table gives no rows. Other columns than id, text and source are not read.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: SimHash's hash and its components are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input, which is then deleted."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, later = materialize_at(stage(spark, docs, sf_dir), name)
        if path:
            drop(spark, path)
        path = later
    return STAGES[-1][1](spark, docs, sf_dir)
