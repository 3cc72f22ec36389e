"""Queries of the training-data operators and their SQL twins, by name."""

from __future__ import annotations

from strataflow.llm.decontaminate import OP6_SQL, op6_decontaminate
from strataflow.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from strataflow.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from strataflow.llm.html_text import op9_html_text
from strataflow.llm.lexical_search import OP12_SQL, op12_lexical_search
from strataflow.llm.near_dup import op8_near_dup
from strataflow.llm.pii import op1_pii
from strataflow.llm.source_mix import OP3_SQL, op3_source_mix
from strataflow.llm.token_counts import op10_token_counts
from strataflow.llm.tool_calls import op2_tool_calls
from strataflow.llm.toxicity import op4_toxicity
from strataflow.llm.url_rules import OP11_SQL, op11_url_rules
from strataflow.llm.warc import op7_warc_derivatives

QUERIES = {
    "op1_pii": op1_pii,
    "op2_tool_calls": op2_tool_calls,
    "op3_source_mix": op3_source_mix,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_near_dup": op8_near_dup,
    "op9_html_text": op9_html_text,
    "op10_token_counts": op10_token_counts,
    "op11_url_rules": op11_url_rules,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Where a query is missing here, SQL cannot express it; tests/llm holds it against brute force.
ORACLE_SQL = {
    "op3_source_mix": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op11_url_rules": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
