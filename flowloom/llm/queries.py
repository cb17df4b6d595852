"""The registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import bpe, chats, decontaminate, langid, licences, ngrams, oracle, pages, postings, repair, simhash, suffixes, toxicity, tries
from flowloom.llm.common import in_fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~in_fold("doc_id", 4, 2)))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", in_fold("doc_id", 4, 2))


VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(vocabulary_path())
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, back=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op2_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ngrams.scores(docs, trained=~in_fold("doc_id", 7, 2), weighed=in_fold("doc_id", 7, 3))
    return found.withColumn("held_out", in_fold("doc_id", 7, 2))


@query
def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages")
    return pages.extract(found, pages.fit(found))


@query
def op5_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~in_fold("doc_id", 5, 0)))
    return toxicity.scores(docs, model).withColumn("held_out", in_fold("doc_id", 5, 0))


@query
def op4_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark), licences.ONE_OF)


ORACLES["op4_license_digest"] = licences.oracle()


MARKED = "</s>[INST] ok [/INST]"


@query
def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    made = chats.conversations(chats.as_tree(said.unionByName(more)), unique=True)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.read_back(made).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


ORACLES["op11_reply_trees"] = oracle.chats(chats.BEGIN, chats.END, chats.CONTROL)


@query
def op12_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(said), said)


ORACLES["op12_grammar_repair"] = oracle.REPAIR


@query
def op13_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_time_forward"] = oracle.TRIE
