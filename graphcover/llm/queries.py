"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from graphcover.llm.chat import OP10_SQL, op10_chat
from graphcover.llm.decontam import OP9_SQL, op9_decontamination
from graphcover.llm.licenses import op2_licenses
from graphcover.llm.linededup import op6_linededup
from graphcover.llm.mixing import OP4_SQL, op4_mixing
from graphcover.llm.perplexity import op5_perplexity
from graphcover.llm.quality import OP1_SQL, op1_quality
from graphcover.llm.simhash import op3_simhash
from graphcover.llm.toxicity import op7_toxicity
from graphcover.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_perplexity": op5_perplexity,
    "op6_linededup": op6_linededup,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
}
ORACLE_SQL = {
    "op1_quality": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op8_warc": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_chat": OP10_SQL,
}
