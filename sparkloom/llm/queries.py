"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from .decontam import op6_decontamination
from .embeddings import OP10_SQL, op10_embedding_near_dedup
from .katz import op2_katz
from .minhash import OP7_SQL, op7_minhash_near_dedup
from .mixing import OP4_SQL, op4_mixing
from .ordered import op11_order_minhash
from .pii import op9_pii_pseudonyms
from .runs import OP13_SQL, op13_periodic_runs
from .search import OP12_SQL, op12_lexical_search
from .substrings import OP1_SQL, op1_substring_dedup
from .toxicity import op5_toxicity
from .urls import OP8_SQL, op8_url_reputation
from .warc import OP3_SQL, op3_warc


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_katz": op2_katz,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_url_reputation": op8_url_reputation,
        "op9_pii_pseudonyms": op9_pii_pseudonyms,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_order_minhash": op11_order_minhash,
        "op12_lexical_search": op12_lexical_search,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_warc": OP3_SQL, "op4_mixing": OP4_SQL, "op7_minhash_near_dedup": OP7_SQL, "op8_url_reputation": OP8_SQL, "op10_embedding_near_dedup": OP10_SQL, "op12_lexical_search": OP12_SQL, "op13_periodic_runs": OP13_SQL}
