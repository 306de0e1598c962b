"""The training-data queries and their DuckDB SQL."""

from __future__ import annotations

from quillgrove.llm import chat, linededup, mixing
from quillgrove.llm.ann import op7_neighbours
from quillgrove.llm.chat import op10_chat
from quillgrove.llm.fertility import op6_fertility
from quillgrove.llm.licenses import op3_licences
from quillgrove.llm.linededup import op4_line_dedup
from quillgrove.llm.mixing import op9_mixing
from quillgrove.llm.packing import op2_packing
from quillgrove.llm.secrets import op5_secrets
from quillgrove.llm.simhash import op8_simhash
from quillgrove.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_licences, op4_line_dedup, op5_secrets, op6_fertility, op7_neighbours, op8_simhash, op9_mixing, op10_chat)}
ORACLES = {"op4_line_dedup": linededup.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat": chat.ORACLE}
