"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``docs``.

In every stage rows with a null ``doc_id`` and rows that repeat one are rows like others, further
columns go along whatever their names, long texts are taken whole, and an empty table gives an empty one.
"""

import public_tokenizers
from pyspark.sql import functions as F

from quizlens.llm import dedup, langid, packing, quality, secrets
from quizlens.llm.common import residue, table
from quizlens.session import work_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LEAST_SCORE = 0.5

#: Fitted models, held-out checks and ties are not SQL; tests/llm compares the stages with plain loops.
ORACLE_SQL = None


def known_language(spark, docs, sf_dir):
    """Drops null, empty and other texts without a letter, and texts of no clear language.

    Without any labelled row to learn from, letters are enough. Of equally likely languages the first by
    name counts; such a text has a low score.
    """
    learned = docs.where(F.coalesce(residue(F.col("doc_id"), 4) != 2, F.lit(False)))
    model = langid.train(learned, docs, PIECES)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.keep(docs, model, LEAST_SCORE)


def good_quality(spark, docs, sf_dir):
    """Drops texts that fail a quality rule: null, empty and short ones, and those past a threshold. A text
    that lies exactly on a threshold stays."""
    return quality.keep(docs)


def one_of_each(spark, docs, sf_dir):
    """Keeps one document of each group of near duplicates: that of the smallest id.

    Of equal rows one stays. Different texts under one id are told apart. Texts without words, and rows
    with a null id, all stay.
    """
    return dedup.keep_one(docs)


def no_secrets(spark, docs, sf_dir):
    """Replaces every span of a secret; keeps all rows. Null and empty texts have none; overlapping spans are
    replaced as one."""
    return secrets.redact(docs, secrets.learn(docs))


def packed(spark, docs, sf_dir):
    """Pieces of sequences. A null or empty text is its end id alone; a text longer than a sequence is cut;
    equal rows are packed each."""
    return packing.pack_texts(docs, WORDS)


STAGES = [
    ("language id", known_language),
    ("quality rules", good_quality),
    ("near duplicates", one_of_each),
    ("secret scan", no_secrets),
    ("packing", packed),
]


def run(spark, sf_dir):
    """Apply the stages to ``documents``; what lies between them is written below ``spark.checkpoint.dir``."""
    folder = work_folder(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
