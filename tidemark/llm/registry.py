"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .conversations import op12_conversation_repair
from .decontamination import op3_decontamination
from .licenses import op4_license_scan
from .packing import op10_best_fit_packing
from .pii import op6_pii
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .simhash import op1_simhash_near_dedup
from .spelling import op13_spelling_variants
from .token_counts import op7_token_counts
from .token_records import op2_token_records
from .vector_packing import op11_vector_packing
from .warc import op9_warc

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_records": op2_token_records,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_packing": op11_vector_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept IS NULL OR page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d
"""

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": OP8_SQL,
    "op9_warc": OP9_SQL,
}
