"""A corpus pipeline of five stages, from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. The first four return the columns of documents.

In every stage all columns are kept whatever their names, an empty table gives an empty one, null ids stay null, and texts are read in whole however long they are. What else becomes of odd rows is said at each stage.
"""

from pyspark.sql import functions as F

from gridloom.llm import decontaminate, mixing, sharding, simhash_dedup, toxicity
from gridloom.llm.common import materialize, table


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity classifier scores 0.5 or more go. Null, empty and blank texts score as a text without n-grams and stay where the model takes that for clean; repeated rows share their score."""
    score = toxicity.text_scorer(docs, table(spark, sf_dir, "labels"), may_learn=lambda c: toxicity.fold(c, 5) != 0)
    return docs.where(score(F.col("text")) < 0.5)


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of documents linked by a Jaccard similarity of 0.8 over five words the row of the least id stays; of repeated rows one. Texts without words (null, empty, blank) are one group. Of a group
    of null ids only, one row stays."""
    return simhash_dedup.drop_near_copies(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Documents that hold ten words in a row of a test item, or the whole of a shorter one, go. Null and empty texts hold nothing and stay, and so do repeated rows of a clean text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Sources at their target weights: documents repeat or are cut as the mix shows them, three times at most. Rows without words are not shown; repeated rows are rows of their own; a null source is the last one."""
    mixed = mixing.mix_documents(docs)
    if "n_chars" in mixed.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def shard(spark, docs, sf_dir):
    """Every row of the mix to one of 24 shards of like size. Repeated rows stay rows and mostly share a shard; a null text is an empty one; one very long text may outweigh the others of its shard."""
    return sharding.shard_documents(docs, leaves=24).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: A learned classifier and pseudorandom draws have no SQL form; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
