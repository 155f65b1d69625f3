"""The operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlane.llm import bloom_dedup, chat, collocations, decontamination, language, line_dedup, near_vectors, orchard, packing, pair_bpe, simhash, token_files, url_cascade
from outlane.session import checkpoint_dir

#: Files of public tokenizers; every worker has them at the same place.
WORD_BPE = vocabulary("word_bpe_49k.json")
BYTE_BPE = vocabulary("byte_bpe_50k.json")

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_vectors", near_vectors.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op2_line_dedup", line_dedup.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return (line_dedup.site_line_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "lines_before", "lines_dropped", F.char_length(text).cast("bigint").alias("kept_chars"),
                    F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256")))


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, WORD_BPE, "word", end_id=1)
    return token_files.read_token_files(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    return (language.identified(docs.select("doc_id", "text", held_out.alias("held_out")), model)
            .select("doc_id", "held_out", F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score")))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.simhash_groups(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


@query("op6_pair_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pair_bpe.coded(table(spark, sf_dir, "documents"), WORD_BPE)
            .select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")))


@query("op7_url_cascade", url_cascade.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_cascade.parse_rules(url_cascade.RULES)
    return url_cascade.filtered(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


@query("op8_chat")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    back = chat.read_back(chat.formatted(given.unionByName(planted)))
    turns = F.array_join(F.flatten(F.zip_with("roles", "texts", lambda r, t: F.array(r, t))), "\n")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", F.size("roles").cast("bigint").alias("n_turns"), sha(F.when(F.size("roles") > 0, F.concat(turns, F.lit("\n"))).otherwise(F.lit(""))).alias("turns_sha256"),
                       F.char_length("loss_text").cast("bigint").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), "formatted_chars")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE, "byte", end_id=0, window=1024)
            .select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
                    "doc_tokens", "sequence_id", F.col("offset").cast("bigint").alias("offset")))


@query("op10_bloom_dedup", bloom_dedup.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (bloom_dedup.exact_groups(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")))


@query("op11_decontamination", decontamination.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontamination.marked(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return got.select("doc_id", "marks.n_words", "marks.n_hit", F.size("marks.items").cast("bigint").alias("n_items"),
                      F.sha2(F.encode(F.array_join("marks.items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("marks.n_hit") > 0).alias("contaminated"))


@query("op12_orchard", orchard.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (orchard.clustered(table(spark, sf_dir, "embeddings"))
            .select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                    F.sha2(F.encode(F.array_join(F.col("centroid").cast("array<string>"), ","), "UTF-8"), 256).alias("centroid_sha256")))


@query("op13_collocations", collocations.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
