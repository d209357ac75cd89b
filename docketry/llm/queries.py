"""One query for each corpus operator over its whole table, with check SQL."""

from docketry.llm import (
    q_bpe, q_conversations, q_decontaminate, q_license, q_lm, q_near, q_pii, q_quality,
    q_runs, q_sharding, q_substring, q_topk, q_urls,
)

QUERIES = {
    "op1_url_filter": (q_urls.query, q_urls.SQL),
    "op2_sharding": (q_sharding.query, q_sharding.SQL),
    "op3_lm_score": (q_lm.query, q_lm.SQL),
    "op4_pii": (q_pii.query, q_pii.SQL),
    "op5_substring_dedup": (q_substring.query, q_substring.SQL),
    "op6_near_dedup": (q_near.query, q_near.SQL),
    "op7_decontaminate": (q_decontaminate.query, q_decontaminate.SQL),
    "op8_topk": (q_topk.query, q_topk.SQL),
    "op9_bpe": (q_bpe.query, q_bpe.SQL),
    "op10_quality": (q_quality.query, q_quality.SQL),
    "op11_conversation_repair": (q_conversations.query, q_conversations.SQL),
    "op12_runs": (q_runs.query, q_runs.SQL),
    "op13_license_scan": (q_license.query, q_license.SQL),
}
