"""Queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from wardflow.llm.chat import OP9_SQL, op9_chat_formatting
from wardflow.llm.clusters import OP13_SQL, op13_clusters
from wardflow.llm.decontaminate import op10_decontamination
from wardflow.llm.language import op6_language_id
from wardflow.llm.lines import OP1_SQL, op1_line_dedup
from wardflow.llm.mixing import op7_mixing
from wardflow.llm.near import op4_near_dedup
from wardflow.llm.quality import op3_quality_rules
from wardflow.llm.topk import OP11_SQL, op11_top_k
from wardflow.llm.toxicity import op8_toxicity
from wardflow.llm.urls import op2_url_filter
from wardflow.llm.warc import op5_warc
from wardflow.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_quality_rules, op4_near_dedup, op5_warc,
                                   op6_language_id, op7_mixing, op8_toxicity, op9_chat_formatting,
                                   op10_decontamination, op11_top_k, op12_whitening, op13_clusters)}
ORACLE = {"op1_line_dedup": OP1_SQL.strip(), "op9_chat_formatting": OP9_SQL.strip(), "op11_top_k": OP11_SQL.strip(),
          "op13_clusters": OP13_SQL.strip()}
