"""Queries of the llm problems, each over its whole tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, table
from . import p1_secrets, p2_near, p4_copies, p6_parse, p7_pack, p8_leaks, p9_cut

#: The setting that names the vocabulary file for token counts (ranks of a byte-level BPE); "none" counts words and signs.
VOCABULARY = "loomwork.vocabulary"
#: Where it is unset: a file of the installed package that holds vocabularies of public tokenizers.
PACKAGE, FILE = "public_tokenizers", "byte_bpe_50k.tiktoken"


def vocabulary(spark: SparkSession) -> str | None:
    """The file by which tokens are counted; raises rather than count otherwise than was told."""
    told = spark.conf.get(VOCABULARY, None)
    if told:
        return None if told == "none" else told
    try:
        return importlib.import_module(PACKAGE).path(FILE)
    except ImportError:
        raise LookupError(f"set {VOCABULARY} to a vocabulary file, or to none") from None


def _p1_all(spark: SparkSession, d: str) -> DataFrame:
    return p1_secrets.credentials(table(spark, d, "code_file"), "file_id", "raw_code", "code_file").union(
        p1_secrets.credentials(table(spark, d, "extracted_sql"), "sql_id", "sql", "extracted_sql")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_all(spark, d).select("src_table", "row_id", "line_no").distinct()


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Both fields with the credentials masked and the code otherwise as it was."""
    code = p1_secrets.masked(table(spark, d, "code_file"), "raw_code")
    sql = p1_secrets.masked(table(spark, d, "extracted_sql"), "sql")
    return code.select(F.lit("code_file").alias("src_table"), F.col("file_id").alias("row_id"), "masked").union(
        sql.select(F.lit("extracted_sql"), "sql_id", "masked")
    )


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Texts per table, those that keep their lines when masked, and those that masking again leaves alone."""
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    src = table(spark, d, "code_file").select(F.lit("code_file").alias("src_table"), F.col("raw_code").alias("t")).union(table(spark, d, "extracted_sql").select(F.lit("extracted_sql"), "sql"))
    once = p1_secrets.masked(src.filter("t is not null"), "t")
    twice = p1_secrets.masked(once, "masked", "again")
    return twice.groupBy("src_table").agg(F.count("*").alias("texts"), F.count_if(lines("t") == lines("masked")).alias("same_lines"), F.count_if(F.col("masked") == F.col("again")).alias("masked_again"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2_near.similar_pairs(table(spark, d, "extracted_sql"), "sql_id", "sql")
    return pairs.select(F.col("id_a").alias("sql_id_a"), F.col("id_b").alias("sql_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of statements that are alike, with their source files."""
    src = table(spark, d, "extracted_sql")
    of = p2_near.groups(src, "sql_id", "sql").withColumnRenamed("id", "sql_id")
    return of.join(src.select("sql_id", "source_file"), "sql_id").select("sql_id", "source_file", "rep", "group_id", "links", "copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_copies.copies(table(spark, d, "extracted_sql"), "sql_id", "sql")


def p4_statements(spark: SparkSession, d: str) -> DataFrame:
    return p4_copies.statements(table(spark, d, "extracted_sql"), "sql_id", "sql")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Copies of all distinct statements: as many as there are statements."""
    return p4_statements(spark, d).agg(F.sum("copies").alias("copies"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return p6_parse.parse_files(table(spark, d, "code_file"), table(spark, d, "migration_result"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_parse.parse_files(table(spark, d, "code_file")).filter("not valid").select("file_id")


def p6_failures(spark: SparkSession, d: str) -> DataFrame:
    """Where and why each invalid file fails, and whether a migration told errors."""
    return _p6(spark, d).filter("not valid")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return p6_parse.rates(_p6(spark, d))


def p6_json(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on every JSON file."""
    return p6_parse.parse_files(table(spark, d, "code_file").filter("lower(file_path) like '%.json'")).select("file_id", "valid")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = p7_pack.token_counts(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark))
    return p7_pack.containers(sizes, table(spark, d, "container_spec")).withColumnRenamed("doc", "doc_id")


def p7_fills(spark: SparkSession, d: str) -> DataFrame:
    return p7_pack.fills(p7_containers(spark, d))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per type: documents, containers over the capacity, documents that fit and were split all the same, pieces in two containers."""
    packed = stage(p7_containers(spark, d), "packed")
    over = packed.groupBy("container_type", "container", "capacity").agg(F.sum("size").alias("used")).groupBy("container_type").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("container_type", "doc_id", "capacity").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.count_distinct("piece").alias("different"))
    per = docs.groupBy("container_type").agg(
        F.count("*").alias("documents"), F.count_if((F.col("size") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("split_in_vain"), F.count_if(F.col("pieces") > F.col("different")).alias("repeated")
    )
    return per.join(over, "container_type").select("container_type", "documents", "overfull", "split_in_vain", "repeated")


def _p8(spark: SparkSession, d: str, gap: int) -> DataFrame:
    index = p8_leaks.PositionalIndex.build(table(spark, d, "documents"), "doc_id", "text")
    return p8_leaks.matches(index, table(spark, d, "eval_item"), "item_id", "passage", gap)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d, 2).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold half an item word for word, with the length of the stretch."""
    return _p8(spark, d, 1).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words", "of")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_cut.judged(table(spark, d, "documents"), "doc_id", "text", "source").filter("cut").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return p9_cut.rates(p9_cut.judged(table(spark, d, "documents"), "doc_id", "text", "source"))


QUERIES = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p1_kept": p1_kept,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p4_found": p4_found,
    "p4_statements": p4_statements,
    "p4_totals": p4_totals,
    "p6_found": p6_found,
    "p6_failures": p6_failures,
    "p6_rates": p6_rates,
    "p6_json": p6_json,
    "p7_containers": p7_containers,
    "p7_fills": p7_fills,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_phrases": p8_phrases,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}
