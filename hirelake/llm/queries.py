"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import attribution, chat, encoding, fim, minhash, packing, quality, repair, secrets, urls, vafile, warc, whitening
from hirelake.llm.batches import table
from hirelake.llm.shipping import ship
from hirelake.llm.tokens import vocabulary_path
from hirelake.session import staged

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
URL_RULES = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"),
             urls.Rule("com/fr/", "allow"), urls.Rule("com/de/", "block")]


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    records = warc.read(spark, archives, with_payload=False).where("problem IS NULL")
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_of("refers_to").alias("refers_to"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = urls.trained(urls.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return urls.judged(pages, URL_RULES, model)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoded(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY),
                            digests_only=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, by the majority rule."""
    return attribution.attributed(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY), sections_column=None)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY), with_ids=False)
    return packing.packed(pieces)


def op7_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = repair.write(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY))
    return repair.read(manifest, with_ids=False)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op9_vafile_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"), digests_only=True)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = chat.formatted(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.read_back(staged(examples, "chat-examples"))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package on the workers' path."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: shipped(query) for name, query in {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe_tree": op4_bpe_tree,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_repair_files": op7_repair_files,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_vafile_top_k": op9_vafile_top_k,
    "op10_secret_scan": op10_secret_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_chat_examples": op13_chat_examples,
}.items()}

# SQL twins of the operators that SQL can express.
CHECKS: dict[str, str] = {
    "op1_warc_salvage": warc.SQL,
    "op8_near_duplicates": minhash.SQL,
    "op9_vafile_top_k": vafile.SQL,
    "op11_fill_in_middle": fim.SQL,
    "op13_chat_examples": chat.SQL,
}
