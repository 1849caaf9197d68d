"""Queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from ridgeline.llm.decontaminate import op5_decontaminate
from ridgeline.llm.divergence import OP13_SQL, op13_source_divergence
from ridgeline.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from ridgeline.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from ridgeline.llm.language_id import op7_language_id
from ridgeline.llm.line_dedup import OP11_SQL, op11_line_dedup
from ridgeline.llm.mixing import OP9_SQL, op9_mixing
from ridgeline.llm.near_dedup import op6_near_dedup
from ridgeline.llm.substring_dedup import op10_substring_dedup
from ridgeline.llm.token_output import op1_token_output
from ridgeline.llm.unigram_count import op3_token_counts
from ridgeline.llm.url_filter import op8_url_filter
from ridgeline.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op2_warc": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op9_mixing": OP9_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
