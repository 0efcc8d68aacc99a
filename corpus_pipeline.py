"""A corpus from raw documents to a mix: five stages, each a table in and a table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calorway.llm.common import drop_folders, recorded, write_table
from calorway.llm.decontaminate import phrase_matches
from calorway.llm.mixing import mix_routes
from calorway.llm.queries import routes_of, table, toxic_labels
from calorway.llm.repeats import keyed_texts
from calorway.llm.simhash import first_of_near
from calorway.llm.substring_dedup import remove_repeats
from calorway.llm.toxicity import learn_grammar, score_texts

#: SQL has neither the fitted grammar nor fingerprint components
ORACLE_SQL = None


#: folders that earlier stages have written on their way, no longer read once a stage's docs are a table of their own
_LEFT: list[str] = []


def _stage(fn):
    """A stage that first clears what the stages before it have left, and keeps note of its own."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, _LEFT, docs)
        _LEFT.clear()
        with recorded() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    run_stage.__doc__ = fn.__doc__
    return run_stage


def _carrying(docs: DataFrame) -> DataFrame:
    """Documents as route texts, the other columns as one column, so that a text travels once; `no_text` marks a null text."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias("_no_text"))
    return docs.select(F.col("doc_id").alias("route_id"), "text", others.alias("doc"))


def _restored(rows: DataFrame, docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The columns of documents, from the carried ones and the text beside them."""
    own = F.when(~F.col(f"{doc}._no_text"), F.col(text))
    return rows.select(*[own.alias(c) if c == "text" else F.col(f"{doc}.{c}").alias(c) for c in docs.columns])


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar does not call toxic.

    Null and empty texts have no clause and get the base score; repeated rows are judged alike; an empty table stays empty.
    """
    grammar = learn_grammar(routes_of(docs), toxic_labels(spark, sf_dir))
    return _restored(score_texts(_carrying(docs), grammar).filter("predicted = 0"), docs, "doc", "text")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, of repeated rows one; texts without words are copies of each other."""
    texts = keyed_texts(_carrying(docs), ("doc",)).select("order", "key", "text", "carried.doc")
    first = first_of_near(texts).select(F.col("order").alias("_order"), F.col("key").alias("_key"))
    kept = texts.join(first, (F.col("order") == F.col("_order")) & (F.col("key") == F.col("_key")))
    one = F.row_number().over(W.partitionBy("order", "key").orderBy(F.lit(0)))
    return _restored(kept.withColumn("_n", one).filter("_n = 1"), docs, "doc", "text")


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; one that loses all its words goes.

    A document that loses nothing keeps its text as it stands, null included; n_chars follows the text.
    """
    cut = remove_repeats(_carrying(docs), carry=("doc",)).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.col("text"))
    kept = _restored(cut.select("carried.doc", text.alias("text"), "n_removed").withColumn("doc", F.col("doc").withField("_n", F.col("n_removed"))), docs.withColumn("_n", F.lit(0)), "doc", "text")
    if "n_chars" not in docs.columns:
        return kept.select(*docs.columns)
    length = F.when(F.col("_n") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase of the benchmark; those without words stay, and so do repeated rows."""
    matched = phrase_matches(_carrying(docs), table(spark, sf_dir, "benchmark"), carry=("doc",)).filter("n_hit = 0")
    return _restored(matched.select("carried.doc", "text"), docs, "doc", "text")


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: (doc_id, source, size, source_size, target, copies, taken) of the documents taken.

    Null and empty texts have size 0 and a source may be null; repeated rows count each.
    """
    mixed = mix_routes(routes_of(docs, F.col("source").alias("label")))
    return mixed.filter("copies > 0").select(F.col("route_id").alias("doc_id"), F.col("label").alias("source"), "size", "source_size", "target", "copies", "taken")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name)
    return docs
