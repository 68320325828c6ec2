"""Registered queries of the subpackage."""

from __future__ import annotations

from bedside.llm import (alignment, bpe, common, conversations, decontaminate, graph, lines, ngrams, packing, pages, pii, quality, shards,
                         substrings, twins)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op2_byte_level_bpe")
def op2(spark, sf_dir):
    return bpe.digests(common.documents(spark, sf_dir), *vocabulary())


@query("op3_benchmark_decontamination", twins.DECONTAMINATION)
def op3(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    return decontaminate.digests(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op6_stratified_shards")
def op6(spark, sf_dir):
    return shards.assignment(common.documents(spark, sf_dir, "doc_id", "text", "source"))


@query("op1_pii_semi_markov")
def op1(spark, sf_dir):
    return pii.digests(common.documents(spark, sf_dir))


@query("op8_quality_boosted_trees")
def op8(spark, sf_dir):
    return quality.digests(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op4_substring_dedup", twins.SUBSTRINGS)
def op4(spark, sf_dir):
    return substrings.digests(common.documents(spark, sf_dir))


@query("op10_ngram_jaccard_join", twins.NGRAM_JOIN)
def op10(spark, sf_dir):
    return ngrams.join(common.documents(spark, sf_dir))


@query("op5_line_alignment_dedup")
def op5(spark, sf_dir):
    return lines.result(common.documents(spark, sf_dir))


@query("op7_pruned_graph_neighbours")
def op7(spark, sf_dir):
    common.prepare(spark)
    return graph.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op9_site_style_tree")
def op9(spark, sf_dir):
    common.prepare(spark)
    return pages.result(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op13_shortest_pack_first")
def op13(spark, sf_dir):
    import public_tokenizers
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_conversation_repair", twins.CONVERSATIONS)
def op12(spark, sf_dir):
    common.prepare(spark)
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.digests(conversations.segments(rows, times="times"))


@query("op11_cross_tokenizer_alignment")
def op11(spark, sf_dir):
    import public_tokenizers
    return alignment.align(common.documents(spark, sf_dir), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
