"""Queries of this subpackage and the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from .bpe import op11_bpe
from .decontam import OP10_SQL, op10_decontam
from .lines import OP3_SQL, op3_lines
from .negatives import OP13_SQL, op13_negatives
from .packing import op2_packing
from .pii import op7_pii
from .simhash import op4_simhash
from .substrings import op5_substrings
from .tokens import op6_tokens
from .topk import OP8_SQL, op8_topk
from .toxicity import op1_toxicity
from .warc import OP9_SQL, op9_warc
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_lines, op4_simhash, op5_substrings, op6_tokens, op7_pii, op8_topk, op9_warc, op10_decontam, op11_bpe, op12_whitening, op13_negatives)}
ORACLES = {"op3_lines": OP3_SQL, "op8_topk": OP8_SQL, "op9_warc": OP9_SQL, "op10_decontam": OP10_SQL, "op13_negatives": OP13_SQL}
