"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.chat import OP3_SQL, op3_chat
from quernstone.llm.decontaminate import op8_decontamination
from quernstone.llm.embeddings import OP7_SQL, op7_embeddings
from quernstone.llm.html import op10_html
from quernstone.llm.language import op5_language
from quernstone.llm.licenses import OP6_SQL, op6_licenses
from quernstone.llm.minhash import op2_minhash
from quernstone.llm.mixing import OP9_SQL, op9_mixing
from quernstone.llm.quality import op4_quality
from quernstone.llm.secrets import op1_secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_minhash": op2_minhash,
        "op3_chat": op3_chat,
        "op4_quality": op4_quality,
        "op5_language": op5_language,
        "op6_licenses": op6_licenses,
        "op7_embeddings": op7_embeddings,
        "op8_decontamination": op8_decontamination,
        "op9_mixing": op9_mixing,
        "op10_html": op10_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op6_licenses": OP6_SQL, "op7_embeddings": OP7_SQL, "op9_mixing": OP9_SQL}
