"""Registered queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from civlens.llm.bpe import op13_bpe
from civlens.llm.conversations import op11_conversations
from civlens.llm.fingerprints import op2_fingerprints
from civlens.llm.html_text import op7_html
from civlens.llm.jaccard_join import op3_jaccard_join
from civlens.llm.lexical_search import op12_lexical_search
from civlens.llm.mixing import OP4_SQL, op4_mixing
from civlens.llm.packing import op6_packing
from civlens.llm.pii import op8_pii
from civlens.llm.repetition import op9_repetition
from civlens.llm.simple8b import op5_simple8b
from civlens.llm.toxicity import op1_toxicity
from civlens.llm.warc import op10_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_simple8b": op5_simple8b,
    "op6_packing": op6_packing,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_repetition": op9_repetition,
    "op10_warc": op10_warc,
    "op11_conversations": op11_conversations,
    "op12_lexical_search": op12_lexical_search,
    "op13_bpe": op13_bpe,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op4_mixing": OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
