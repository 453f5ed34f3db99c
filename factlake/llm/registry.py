"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .mixing import op7_mix_sources
from .ngram_join import op6_ngram_join
from .packing import op1_pack
from .pii import OP10_SQL, op10_pii
from .quality_rules import OP8_SQL, op8_quality_rules
from .secret_scan import OP3_SQL, op3_secret_scan
from .token_output import op5_token_output
from .toxicity import op9_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_pack": op1_pack,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_token_output": op5_token_output,
    "op6_ngram_join": op6_ngram_join,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}

SQL = {
    "op2_url_filter": OP2_SQL,
    "op3_secret_scan": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_pii": OP10_SQL,
}
