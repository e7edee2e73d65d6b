"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lakelens.llm.divergence import OP11_SQL, op11_divergence
from lakelens.llm.language_model import op4_language_model
from lakelens.llm.langid import op8_langid
from lakelens.llm.licences import OP12_SQL, op12_licences
from lakelens.llm.lines import op7_lines
from lakelens.llm.media import op2_media
from lakelens.llm.mixing import OP1_SQL, op1_mix
from lakelens.llm.nearcopies import op3_near_copies
from lakelens.llm.packing import op10_pack
from lakelens.llm.repeats import op9_repeats
from lakelens.llm.secrets import op6_secrets
from lakelens.llm.trie import OP13_SQL, op13_prefix_trie
from lakelens.llm.vectors import op5_near_vectors

QUERIES = {"op1_mix": op1_mix, "op2_media": op2_media, "op3_near_copies": op3_near_copies, "op4_language_model": op4_language_model, "op5_near_vectors": op5_near_vectors, "op6_secrets": op6_secrets, "op7_lines": op7_lines, "op8_langid": op8_langid, "op9_repeats": op9_repeats, "op10_pack": op10_pack, "op11_divergence": op11_divergence, "op12_licences": op12_licences, "op13_prefix_trie": op13_prefix_trie}
SQL = {"op1_mix": OP1_SQL, "op11_divergence": OP11_SQL, "op12_licences": OP12_SQL, "op13_prefix_trie": OP13_SQL}
