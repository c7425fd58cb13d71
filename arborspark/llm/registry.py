"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from arborspark.llm.decontaminate import op6_decontamination
from arborspark.llm.divergence import SQL as DIVERGENCE_SQL
from arborspark.llm.divergence import op11_source_divergence
from arborspark.llm.exact_dedup import op9_exact_dedup
from arborspark.llm.language import op3_language
from arborspark.llm.licenses import op8_license_scan
from arborspark.llm.near_dedup import op10_near_dedup
from arborspark.llm.packing import op5_packing
from arborspark.llm.quality import op2_quality
from arborspark.llm.sharding import op12_sharding
from arborspark.llm.substrings import op7_substring_dedup
from arborspark.llm.suffixes import op4_suffix_dedup
from arborspark.llm.token_counts import op1_token_counts
from arborspark.llm.token_links import op13_token_links

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_sharding": op12_sharding,
    "op13_token_links": op13_token_links,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents
        ), r AS (
            SELECT doc_id, sha256(body) AS text_sha256,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY length(raw) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op11_source_divergence": DIVERGENCE_SQL,
}
