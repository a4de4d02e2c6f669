"""The queries op1 to op10 and the pipeline, as __spark_entry__.py registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import chat_quotes, decontam_template, edit_embed, license_align, line_fuzzy, pack_pow2, quality_cnn, secret_scan, simhash_trie, toxic_ftrl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_chat_quotes(spark, sf_dir):
    return chat_quotes.format_chat(table(spark, sf_dir, "conversations"))


#: Of four messages one quotes the one before it, one that before that, one both, a level apart.
QUOTED = """select conv_id, turn, role, case
  when turn % 4 = 1 and before is not null then concat('> ', replace(before, chr(10), concat(chr(10), '> ')), chr(10), text)
  when turn % 4 = 2 and earlier is not null then concat('> ', replace(earlier, chr(10), concat(chr(10), '> ')), chr(10), text)
  when turn % 4 = 3 and earlier is not null then concat('>> ', replace(earlier, chr(10), concat(chr(10), '>> ')), chr(10), '> ', replace(before, chr(10), concat(chr(10), '> ')), chr(10), text)
  else text end as text
from (select *, lag(text) over (partition by conv_id order by turn) as before, lag(text, 2) over (partition by conv_id order by turn) as earlier from conversations)"""


def chat_with_quotes(spark, sf_dir):
    """op2's operator on conversations that hold quotes, made from the table."""
    return chat_quotes.format_chat(spark.sql(QUOTED.replace("from conversations", "from {conversations}"), conversations=table(spark, sf_dir, "conversations")))


def op3_simhash_trie(spark, sf_dir):
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_align(spark, sf_dir):
    return license_align.scan(table(spark, sf_dir, "documents"))


def op5_pack_pow2(spark, sf_dir):
    return pack_pow2.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_line_fuzzy(spark, sf_dir):
    return line_fuzzy.report(table(spark, sf_dir, "documents"))


def op7_quality_cnn(spark, sf_dir):
    return quality_cnn.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_edit_embed(spark, sf_dir):
    return edit_embed.report(table(spark, sf_dir, "documents"))


def op9_toxic_ftrl(spark, sf_dir):
    return toxic_ftrl.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontam_template(spark, sf_dir):
    return decontam_template.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_quotes, op3_simhash_trie, op4_license_align, op5_pack_pow2, op6_line_fuzzy, op7_quality_cnn, op8_edit_embed, op9_toxic_ftrl, op10_decontam_template, pipeline, chat_with_quotes)}
ORACLE_SQL: dict[str, str] = {"op2_chat_quotes": chat_quotes.ORACLE, "chat_with_quotes": chat_quotes.ORACLE.replace("from conversations", f"from ({QUOTED}) quoted", 1)}
