"""The registered query of each operator, and its SQL for DuckDB where SQL can express it."""

import public_tokenizers
from pyspark.sql import functions as F

from quizlens.llm import (
    dedup, fingerprints, langid, merkle, mixing, packing, phrases, pieces, quality, secrets, sharding, toxicity, urls,
)
from quizlens.llm.common import LOWER, UPPER, residue, table
from quizlens.llm.sql import ORACLE_SQL, SHARD_BYTES  # noqa: F401

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    held_out = residue(F.col("doc_id"), 4) == 2
    learned = documents.where(~held_out)
    model = langid.train(learned, documents, PIECES)
    return langid.predict(documents, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op2_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_near_dedup(spark, sf_dir):
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op5_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = residue(F.col("doc_id"), 5) == 0
    model = toxicity.train(documents, labels.where(~held_out))
    return toxicity.score(documents, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op6_pieces(spark, sf_dir):
    return pieces.digests(pieces.round_trip(table(spark, sf_dir, "documents"), PIECES))


def op7_packing(spark, sf_dir):
    return packing.pack_texts(table(spark, sf_dir, "documents"), WORDS)


def op8_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_fingerprints(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    done = fingerprints.fingerprints(documents, fingerprints.lexicon(documents))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op10_secret_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(documents, secrets.learn(documents)))


def op11_mixing(spark, sf_dir):
    drawn = mixing.draw(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


def op12_merkle_manifest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tampered = residue(F.col("doc_id"), 3) == 0
    presented = {"text": F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    proven = merkle.prove(documents, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", presented)
    return proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), "folded_root", "verified"
    )


def op13_phrases(spark, sf_dir):
    found = phrases.ranked(phrases.collocations(table(spark, sf_dir, "documents")), 2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    f.__name__: f for f in (
        op1_language_id, op2_sharding, op3_near_dedup, op4_url_filters, op5_toxicity, op6_pieces, op7_packing,
        op8_quality_rules, op9_fingerprints, op10_secret_scan, op11_mixing, op12_merkle_manifest, op13_phrases,
    )
}
