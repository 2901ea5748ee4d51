"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lodestone.llm.code_search import OP8_SQL, op8_code_search
from lodestone.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from lodestone.llm.importance import OP13_SQL, op13_importance
from lodestone.llm.language_id import op2_language_id
from lodestone.llm.mixing import op3_source_mix
from lodestone.llm.piece_codec import op4_sentencepiece
from lodestone.llm.repeated_spans import op10_repeated_spans
from lodestone.llm.secret_scan import op6_secret_scan
from lodestone.llm.simhash import op7_simhash
from lodestone.llm.spelling import OP11_SQL, op11_spelling
from lodestone.llm.token_counts import op12_token_counts
from lodestone.llm.url_filter import OP9_SQL, op9_url_filter
from lodestone.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_source_mix": op3_source_mix,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash": op7_simhash,
    "op8_code_search": op8_code_search,
    "op9_url_filter": op9_url_filter,
    "op10_repeated_spans": op10_repeated_spans,
    "op11_spelling": op11_spelling,
    "op12_token_counts": op12_token_counts,
    "op13_importance": op13_importance,
}

SQL = {"op1_exact_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op8_code_search": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_spelling": OP11_SQL, "op13_importance": OP13_SQL}
