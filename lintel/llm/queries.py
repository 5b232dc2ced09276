"""The registered queries of this subpackage."""

from __future__ import annotations

from . import chat, licenses, warc
from .chat import op9_chat_formatting
from .decontamination import op6_greedy_tiling
from .html_text import op3_html_main_text
from .licenses import op10_license_digests
from .packing import op7_best_fit_packing
from .quality import op1_quality_classifier
from .repetition import op5_suffix_repetition
from .simhash import op8_simhash_near_dedup
from .toxicity import op2_toxicity_bigru
from .warc import op4_warc_transactions

_QUERIES = (op1_quality_classifier, op2_toxicity_bigru, op3_html_main_text, op4_warc_transactions, op5_suffix_repetition, op6_greedy_tiling, op7_best_fit_packing, op8_simhash_near_dedup, op9_chat_formatting, op10_license_digests)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {"op4_warc_transactions": warc.OP4_SQL, "op9_chat_formatting": chat.OP9_SQL, "op10_license_digests": licenses.oracle()}
