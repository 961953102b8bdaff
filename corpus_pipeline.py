"""From raw documents to a clean, tokenized corpus.

The stages run over ``documents`` one after another; each result is written as Parquet in the shared folder and read
again, so a lost executor costs a part of one stage. All but the last return the columns of documents:

1. toxicity: documents that the classifier (trained from the labels of the given folder) scores 0.5 or more go.
2. line dedup: lines of three or more documents stay in one of them; ``n_chars`` follows the text.
3. N-gram Jaccard join: of rows linked by five-word shingles at 0.8 or more one stays, that of the smallest doc_id;
   rows without an id come last, and of rows that repeat with one id the first written stays.
4. benchmark decontamination: documents that hold a leak of a test item go.
5. BPE: ids of every text left, their number and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from tablewise.llm.common import documents, stage
from tablewise.llm.queries import word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    n_chars = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "__row"
    while row in (c.lower() for c in docs.columns):  # a name of its own among the columns
        row += "_"
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard_join.link(rows, width=5, percent=80, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("first"))
    extra = groups.join(first.select(f"first.{row}"), row, "left_anti").select(row)
    return rows.join(extra, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, documents(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_and_decode(docs, word_tokenizer())
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # the trained classifier and the alignment have no SQL form; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for i, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
