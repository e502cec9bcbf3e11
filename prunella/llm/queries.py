"""The contract's queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prunella.llm.chat import OP6_SQL, op6_chat_format
from prunella.llm.collocations import OP11_SQL, op11_collocations
from prunella.llm.decontaminate import OP10_SQL, op10_decontaminate
from prunella.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from prunella.llm.language import op4_language_id
from prunella.llm.line_dedup import op1_line_dedup
from prunella.llm.mixing import OP8_SQL, op8_mixing
from prunella.llm.pii import op7_pii
from prunella.llm.quality import op5_quality_rules
from prunella.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from prunella.llm.tokens import op9_token_output
from prunella.llm.toxicity import op3_toxicity
from prunella.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_token_output": op9_token_output,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_vector_codes": op13_vector_codes,
}
SQL: dict[str, str] = {
    "op2_jaccard_join": OP2_SQL,
    "op6_chat_format": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
