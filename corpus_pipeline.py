"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import read
from lociframe.llm.packing import pack
from lociframe.llm.quality import keep_good
from lociframe.llm.simhash import STAGE, one_of_each
from lociframe.llm.suffix import remove_repeats
from lociframe.llm.toxicity import without_toxic
from lociframe.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not call toxic.

    Null and empty texts have no features and stay unless the bias alone is toxic; texts of any length are read
    whole; repeated rows are judged alike and each stays or goes; an empty table stays empty, and without toxic
    labels all rows stay. Other columns, whatever their names, are kept as they are.
    """
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest.

    Null and empty texts have no words and go; texts of any length are measured whole; repeated rows are judged
    alike; an empty table stays empty, and without labels only the base rules reject. Other columns are kept.
    """
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are 0.8 or more alike, by links.

    The row of the smallest doc_id stays, null ids last; of rows that agree in id and text one stays. Null,
    empty and wordless texts are one group; a text of fewer than five words is one shingle; texts of any length
    are compared whole. An empty table stays empty. Other columns are kept.
    """
    return one_of_each(docs, **STAGE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of 200 bytes or more; n_chars follows the text.

    The first copy stays, by doc_id and place; rows that agree in id and text are one text and keep the same. Null
    texts stay null and texts under 200 bytes as they are; a character that a cut splits goes whole. No row is
    dropped; an empty table stays empty. Other columns are kept.
    """
    out = remove_repeats(docs, keep_first=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the texts, packed into sequences.

    Null and empty texts are the end id alone; texts of any length are cut freely; repeated rows are packed each;
    an empty table gives no piece. Other columns are not read.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: Learned models and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
