"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from curatrix.llm.byte_bpe import op8_byte_bpe
from curatrix.llm.inner_products import OP6_SQL, op6_top_inner_products
from curatrix.llm.language_mixture import op5_language_mixture
from curatrix.llm.license_scan import op7_license_scan
from curatrix.llm.mixing import OP10_SQL, op10_source_mix
from curatrix.llm.mpeg_audio import op3_mpeg_audio
from curatrix.llm.pu_quality import op2_pu_quality
from curatrix.llm.simhash import op1_simhash
from curatrix.llm.skip_chain_pii import op4_skip_chain_pii
from curatrix.llm.substring_dedup import OP9_SQL, op9_substring_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pu_quality": op2_pu_quality,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_skip_chain_pii": op4_skip_chain_pii,
    "op5_language_mixture": op5_language_mixture,
    "op6_top_inner_products": op6_top_inner_products,
    "op7_license_scan": op7_license_scan,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mix": op10_source_mix,
}

ORACLE_SQL = {
    "op6_top_inner_products": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_source_mix": OP10_SQL,
}
