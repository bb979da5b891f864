"""A corpus pipeline of five stages: each takes the documents that its predecessor kept and writes what it keeps.

language ID -> one document of each near-duplicate group -> benchmark decontamination -> source mix -> token files.
All stages but the last return the columns of ``documents``. A document that the mix takes several times is several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm import decontaminate, langid, mixing, ngram_join, token_files
from petrel.llm.common import pick_with_row, prepare, scratch
from petrel.llm.queries import tokenizer_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified: those with a letter, unless the decoding is ambiguous and far from every codeword.

    Null and empty texts go; repeated rows are judged each by itself; other columns pass unchanged, whatever their names.
    """
    prepare(spark)
    return langid.identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents: the one with the smallest id.

    Rows that share an id are one document, of which the row whose text has the smallest hash stays; a row without id stands for its text, so
    that equal ones are one document too. Empty texts are linked with nothing. Texts are shuffled only for candidates and for rows that share an id.
    """
    prepare(spark)
    keyed = pick_with_row(docs, doc_id="long", text="string").select("row", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("key"))
    copies = ngram_join.join(keyed.select(F.col("key").alias("doc_id"), "text"), count=False).where("doc_id <> component_id")
    copies = copies.select(F.col("doc_id").alias("copy")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("several"))
    left = keyed.join(copies, F.col("key") == F.col("copy"), "left_anti")
    once = left.join(shared, F.col("key") == F.col("several"), "left_anti").select("row")
    first = left.join(shared, F.col("key") == F.col("several"), "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("text")).alias("row"))
    return once.unionByName(first.select("row")).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a hit span over the length limit or hit words over the coverage limit of the operator.

    A document over a limit goes as a whole: what would be left of it is a text with holes. Null texts have no words and stay; rows that share
    an id are judged each by itself; other columns pass unchanged; without benchmark items every document stays.
    """
    prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Texts without words take no part in the
    budget and follow the hash of their id like others; rows that share an id are taken together; a null source is a source."""
    prepare(spark)
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns the digest of every document in them; a null text has the end id only."""
    prepare(spark)
    folder = scratch(spark, "corpus-tokens")
    return token_files.read(spark, folder, token_files.write(docs, folder, tokenizer_path()))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("source mix", mixed),
    ("token files", tokens),
]

#: The stages train models and build automata, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written as Parquet to the shared folder and reread."""
    docs = _documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
