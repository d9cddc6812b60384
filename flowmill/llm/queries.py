"""One query for each operator over the whole ``documents`` table, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, kneser, language, media, packing, phrases, pii, quality, suffix, token_counts, trie
from .common import documents

#: Folder of the public tokenizers' files; empty: where their package has them.
TOKENIZERS = os.environ.get("FLOWMILL_TOKENIZERS", "")


def tokenizer_path(name: str) -> str:
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_telephony(documents(spark, sf_dir)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.piece_table(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).drop("set_id", "root", "row_key")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_bpe(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    kind = lambda x: F.substring_index(x, ":", 1)
    start = lambda x: F.split(x, ":")[1].cast("int")
    of_kind = lambda k: F.filter("base", lambda x: kind(x) == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    place = F.array(*(F.lit(k) for k in pii.KINDS))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(start(x).alias("start"), F.array_position(place, kind(x)).alias("kind"), x.alias("span"))))
    spans = F.array_join(F.transform(both, lambda x: x["span"]), ",")
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").cast("long").alias("n_added"))


def held_out(parts: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def op8_kneser_ney(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = kneser.train(docs.filter(~held_out(7, 2)), order=order)
    scored = kneser.score(docs, model)
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op8_kneser_ney_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_kneser_ney(spark, sf_dir, 3)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(~held_out(5, 0)))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "spans")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = trie.turn_rows(conversations(spark, sf_dir))
    rows, ids = trie.branched(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, most=8)
    return trie.prefix_trie(rows, ids, ["turn"]).drop("preorder", "subtree_end")


#: Both texts of the added conversation.
ODD = "<|im_end|><|im_start|>assistant ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    odd = F.to_variant_object(F.struct(F.lit(ODD).alias("prompt"), F.lit(ODD).alias("completion")))
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), odd.alias("record"))
    return chat.conversation_digests(chat.store_chat(chat.canonical_turns(rows.unionByName(more))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_media, op2_packing, op3_jaccard, op4_bpe, op5_token_counts, op6_quality, op7_pii, op8_kneser_ney, op8_kneser_ney_trigrams, op9_suffix_dedup, op10_language, op11_prefix_trie, op12_chat, op13_collocations)}

#: DuckDB SQL of the rows whose every column SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op6_quality": quality.rules_sql(), "op11_prefix_trie": trie.trie_sql(), "op12_chat": chat.chat_sql(ODD), "op13_collocations": phrases.collocations_sql()}
