"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from veldt.llm.bpe import op7_byte_bpe
from veldt.llm.decontaminate import op5_decontaminate
from veldt.llm.fingerprint import op6_fingerprint
from veldt.llm.html_text import op3_html_text
from veldt.llm.kneser_ney import op13_kneser_ney
from veldt.llm.line_dedup import op10_line_dedup
from veldt.llm.pii import op9_pii
from veldt.llm.prefix_trie import op12_prefix_trie
from veldt.llm.quality import op2_quality
from veldt.llm.ranked_search import op11_ranked_search
from veldt.llm.simhash import op1_simhash
from veldt.llm.substring_dedup import op4_substring_dedup
from veldt.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = {q.__name__: q for q in (op1_simhash, op2_quality, op3_html_text, op4_substring_dedup, op5_decontaminate, op6_fingerprint, op7_byte_bpe, op8_url_filter, op9_pii, op10_line_dedup, op11_ranked_search, op12_prefix_trie, op13_kneser_ney)}
ORACLES = {"op8_url_filter": OP8_SQL}
