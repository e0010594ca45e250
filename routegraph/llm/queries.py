"""The registered queries of the corpus operators and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routegraph.llm.common import benchmark, documents
from routegraph.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from routegraph.llm.decontaminate import OP6_SQL, op6_decontaminate
from routegraph.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from routegraph.llm.kn_scoring import op7_lm_scoring
from routegraph.llm.langid import op5_language_id
from routegraph.llm.licenses import op4_license_scan
from routegraph.llm.mixing import OP3_SQL, op3_mixing
from routegraph.llm.ngram_join import op2_ngram_join
from routegraph.llm.secret_scan import op10_secret_scan
from routegraph.llm.sharding import op1_sharding
from routegraph.llm.spelling import OP12_SQL, op12_spelling
from routegraph.llm.suffix_dedup import op9_suffix_dedup
from routegraph.llm.warc import OP13_SQL, op13_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_sharding": lambda spark, sf: op1_sharding(documents(spark, sf)),
    "op2_ngram_join": lambda spark, sf: op2_ngram_join(documents(spark, sf)),
    "op3_mixing": lambda spark, sf: op3_mixing(documents(spark, sf)),
    "op4_license_scan": lambda spark, sf: op4_license_scan(documents(spark, sf)),
    "op5_language_id": lambda spark, sf: op5_language_id(documents(spark, sf)),
    "op6_decontaminate": lambda spark, sf: op6_decontaminate(documents(spark, sf), benchmark(spark, sf)),
    "op7_lm_scoring": lambda spark, sf: op7_lm_scoring(documents(spark, sf)),
    "op8_exact_dedup": lambda spark, sf: op8_exact_dedup(documents(spark, sf)),
    "op9_suffix_dedup": lambda spark, sf: op9_suffix_dedup(documents(spark, sf)),
    "op10_secret_scan": lambda spark, sf: op10_secret_scan(documents(spark, sf)),
    "op11_conversation_repair": lambda spark, sf: op11_conversation_repair(spark.read.parquet(f"{sf}/conversations.parquet")),
    "op12_spelling": lambda spark, sf: op12_spelling(documents(spark, sf)),
    "op13_warc": lambda spark, sf: op13_warc(spark.read.parquet(f"{sf}/pages.parquet")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_warc": OP13_SQL,
}
