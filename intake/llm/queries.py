"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intake.llm import bpe, graph, manifest, maxent, mixing, pages, quality, shards, simhash, spotsigs, toxicity, variants, warc
from intake.llm.common import id_hash, shared_dir, table
from intake.llm.oracles import manifest_sql, variants_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of the ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.code(docs, tokenizer_path(), decoded_to="decoded", keep=("doc_id",))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document; its contract links fingerprints within two bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, bits=True).select("doc_id", "fingerprint", "component_id")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the rules learned from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.decide(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = id_hash(F.col("doc_id")) % 3 == 1
    index = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, index, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model score of every text, learned from nine tenths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_hash(F.col("doc_id")) % 10 == 0
    scored = maxent.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as often as drawn for its source, in a global random order."""
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op4_mixing"] = mixing.mix_sql()


@query
def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot signatures of every text and its edited text, and their likeness."""
    marked = spotsigs.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.as_text("spots").alias("fingerprint"), spotsigs.as_text("edited_spots").alias("edited_fingerprint"), "near_edited", "near_next",
        spotsigs.length_class("spots").alias("length_class"),
    )


@query
def spot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all pairs: the class of near-duplicate texts of every document."""
    return spotsigs.classes(table(spark, sf_dir, "documents"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = pages.main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record with its metadata and conversion records."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


@query
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fixed-stride shards in training order; a row per sequence with its place."""
    import public_tokenizers

    folder = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.materialise(docs, folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents: leaf, subroot, root and proof of each, and whether its possibly tampered row still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    found = manifest.manifest(docs, tamper=manifest.tampered_rows(F.col("doc_id")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLES["op11_manifest"] = manifest_sql()


@query
def op12_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by beam searches of the graphs of all shards."""
    vectors = graph.vectors_of(table(spark, sf_dir, "embeddings"))
    return graph.search(graph.index(vectors), vectors.where("vec_id % 20 = 0"))


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with the number of words one edit away, their form and its root."""
    return variants.groups(table(spark, sf_dir, "documents"))


ORACLES["op13_variants"] = variants_sql()
