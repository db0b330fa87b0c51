"""The ``opN_<name>`` queries: production parameters, whole tables, thin digests of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import session

from . import alignment, binary_output, exact_dedup, language, licenses, line_dedup, mixing, packing, quality, simhash, toxicity, url_filter, vector_codes

table = session.table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark, sf_dir):
    found = exact_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_line_dedup(spark, sf_dir):
    return line_dedup.runs(table(spark, sf_dir, "documents")).select("doc_id", "first_line", "last_line", "source_doc_id", "source_line")


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_licenses(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op7_binary_output(spark, sf_dir):
    return binary_output.write_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality(spark, sf_dir):
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark, sf_dir):
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(found.rows)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def queries():
    return {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_line_dedup, op4_url_filter, op5_packing, op6_licenses, op7_binary_output, op8_quality, op9_simhash, op10_toxicity, op11_alignment, op12_language, op13_vector_codes)}
