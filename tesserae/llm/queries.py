"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, chat, jaccard, langid, media, mixing, neighbours, pieces, pii, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": media.op1_media_columns,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_language_id": langid.op3_language_id,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_warc": archives.op7_warc,
    "op8_personal_data": pii.op8_personal_data,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_source_mixing": mixing.op10_source_mixing,
}
SQL: dict[str, str] = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op5_suffix_dedup": substrings.OP5_SQL,
    "op7_warc": archives.OP7_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op10_source_mixing": mixing.OP10_SQL,
}
