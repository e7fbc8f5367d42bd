"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm.chat import op2_chat_formatting
from tidemark.llm.html_text import op8_html_extraction
from tidemark.llm.jaccard import OP11_SQL, op11_jaccard_join
from tidemark.llm.language import op9_language_id
from tidemark.llm.manifest import OP12_SQL, op12_dataset_manifest
from tidemark.llm.media import op10_media_columns
from tidemark.llm.mixing import op5_source_mixing
from tidemark.llm.order_minhash import op4_document_fingerprints
from tidemark.llm.packing import op6_packing
from tidemark.llm.repair import OP13_SQL, op13_conversation_repair
from tidemark.llm.secrets import op1_secret_scans
from tidemark.llm.simhash import op7_simhash_near_dedup
from tidemark.llm.token_counts import op3_token_counts


def queries() -> dict:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_token_counts": op3_token_counts,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_source_mixing": op5_source_mixing,
        "op6_packing": op6_packing,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_language_id": op9_language_id,
        "op10_media_columns": op10_media_columns,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_dataset_manifest": op12_dataset_manifest,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_jaccard_join": OP11_SQL, "op12_dataset_manifest": OP12_SQL, "op13_conversation_repair": OP13_SQL}
