"""Queries of this package. Each reads whole tables and returns the full result of its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.llm import oracles
from platewise.plans.registry import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, folder):
            from platewise.session import configure

            return fn(Tables(configure(spark), folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op1_minimax_shards")
def op1(t: Tables):
    """Documents in 40 shards of near equal bytes, equal texts together."""
    from platewise.llm.sharding import shard_documents

    return shard_documents(t.documents, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_personal_data")
def op3(t: Tables):
    """Personal data in every document."""
    from platewise.llm.pii import find_personal_data

    return find_personal_data(t.documents)


@query("op5_line_quality", oracles.QUALITY)
def op5(t: Tables):
    """Line-first quality verdict of every document."""
    from platewise.llm.quality import judge_quality

    return judge_quality(t.documents, keep_text=False)


@query("op6_sentence_pieces")
def op6(t: Tables):
    """Piece ids of every document, and whether they decode to it."""
    from platewise.llm.pieces import encode_pieces, load_vocabulary

    return encode_pieces(t.documents, load_vocabulary(tokenizer("piece_bpe_32k.model")))


@query("op7_token_counts")
def op7(t: Tables):
    """Tokens of every document; over_limit beyond 2048."""
    from platewise.llm.token_counts import count_tokens

    return count_tokens(t.documents, tokenizer("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op8_url_rules", oracles.urls(RULES))
def op8(t: Tables):
    """Verdict on the url of every page."""
    from platewise.llm.url_filter import filter_urls

    return filter_urls(t.pages, RULES)


@query("op9_repeated_passages", oracles.PASSAGES)
def op9(t: Tables):
    """Every document without the words of repeated 35-word windows."""
    from platewise.llm.substring_dedup import remove_repeats

    return remove_repeats(t.documents, 35)


@query("op10_near_duplicates", oracles.NEAR)
def op10(t: Tables):
    """Component of near copies of every document, at a similarity of 0.85."""
    from platewise.llm.near_dedup import near_components

    return near_components(t.documents, percent=85)


@query("op4_benchmark_leaks")
def op4(t: Tables):
    """Every document and benchmark item that it leaks."""
    from platewise.llm.decontaminate import find_leaks

    return find_leaks(t.documents, t.benchmark, stride=1, short=True)


@query("op2_near_lines")
def op2(t: Tables):
    """Class, number of links and verdict of every line, at two edits."""
    from platewise.llm.line_dedup import dedup_lines

    return dedup_lines(t.documents, tau=2).drop("rid")


@query("op11_hard_negatives", oracles.NEGATIVES)
def op11(t: Tables):
    """Hard negatives of every hundredth vector, every seventh with a shifted label."""
    from platewise.llm.hard_negatives import mine_negatives

    return mine_negatives(t.embeddings, lambda i: i % 100 == 0, relabel=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))


@query("op13_conversation_trie", oracles.TRIE)
def op13(t: Tables):
    """Every node of the trie of rebuilt conversations."""
    from platewise.llm.conversation_trie import conversation_trie

    return conversation_trie(t.conversations).drop("enter_at", "exit_at")


@query("op12_toxicity")
def op12(t: Tables):
    """Toxicity of every document; learned from rows outside the held-out quarter."""
    from platewise.llm.toxicity import fit_toxicity, score_toxicity

    def quarter(i):
        return F.crc32(i.cast("string")) % 4

    model = fit_toxicity(t.documents, t.labels, lambda i: quarter(i) != 2)
    out = score_toxicity(t.documents, model, 0.3)
    return out.select("doc_id", F.coalesce(quarter(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "offending")
