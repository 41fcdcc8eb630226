"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from framewright.llm.op10_substring_dedup import op10_substring_dedup
from framewright.llm.op1_warc import SQL as SQL_1
from framewright.llm.op1_warc import op1_warc
from framewright.llm.op2_line_chunks import SQL as SQL_2
from framewright.llm.op2_line_chunks import op2_line_chunks
from framewright.llm.op3_html_text import op3_html_text
from framewright.llm.op4_toxicity import op4_toxicity
from framewright.llm.op5_byte_bpe import op5_byte_bpe
from framewright.llm.op6_decontaminate import op6_decontaminate
from framewright.llm.op7_language_id import op7_language_id
from framewright.llm.op8_jaccard_join import SQL as SQL_8
from framewright.llm.op8_jaccard_join import op8_jaccard_join
from framewright.llm.op9_exact_dedup import SQL as SQL_9
from framewright.llm.op9_exact_dedup import op9_exact_dedup

QUERIES = {
    "op1_warc": op1_warc,
    "op2_line_chunks": op2_line_chunks,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

SQL = {
    "op1_warc": SQL_1,
    "op2_line_chunks": SQL_2,
    "op8_jaccard_join": SQL_8,
    "op9_exact_dedup": SQL_9,
}
