"""From raw documents to files of token ids: five stages, each over all that the one before kept.

    quality          the classifier's rejects go
    near_duplicates  one document of each group of near copies stays (five words, similarity 0.8)
    contamination    documents that hold a passage of a test item go
    mixture          documents are repeated so that sources reach their target weights
    tokens           ids are written as coded files, read back and summed up
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, scratch
from plumbline.llm import contamination, jaccard, mixing, quality, tokens
from plumbline.llm.common import stored

SHINGLE_WORDS, SIMILARITY = 5, 0.8
SCORE = "pipeline__score"
#: SQL cannot express the classifier, the similarity groups and the tokenizer; tests/llm checks by brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold; null and empty texts are scored as empty, whatever other columns are called."""
    score = SCORE
    while score in docs.columns:
        score += "_"
    model = quality.train(quality.labelled_rows(docs, _table(spark, sf_dir, "labels")))
    return quality.apply(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as jaccard.representatives says; documents without words all stay."""
    return jaccard.representatives(docs, SHINGLE_WORDS, SIMILARITY)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit word; null texts have none, and without items all stay."""
    return contamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, with the caller's columns, also those called copy or place."""
    given = {c: f"given__{c}" if c in ("copy", "place") else c for c in docs.columns}
    out = mixing.mixed(docs.select(*[quoted(c).alias(n) for c, n in given.items()]))
    return out.select(*[quoted(n).alias(c) for c, n in given.items()])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document; an empty table writes empty files."""
    import public_tokenizers

    path = scratch(spark, "corpus-tokens")
    tokens.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.summary(tokens.read(spark, path, with_ids=False))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("contamination", uncontaminated),
    ("mixture", mixture),
    ("tokens", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
