"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .conversations import op11_conversations
from .decontaminate import OP9_SQL, op9_decontaminate
from .embeddings import OP3_SQL, op3_embeddings
from .language import op5_language
from .merkle import OP12_SQL, op12_merkle
from .pieces import op13_pieces
from .pii import op10_pii
from .sharding import op8_shards
from .simhash import op6_simhash
from .token_file import op2_token_file
from .toxicity import op1_toxicity
from .wrappers import op7_main_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_file": op2_token_file,
    "op3_embeddings": op3_embeddings,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_main_text": op7_main_text,
    "op8_shards": op8_shards,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_conversations": op11_conversations,
    "op12_merkle": op12_merkle,
    "op13_pieces": op13_pieces,
}

SQL: dict[str, str] = {"op3_embeddings": OP3_SQL, "op9_decontaminate": OP9_SQL, "op12_merkle": OP12_SQL}
