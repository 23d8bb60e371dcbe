"""The registered queries of this package and the SQL that some of them must agree with."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat import OP8_SQL, op8_chat
from .decontaminate import OP10_SQL, op10_decontaminate
from .imatch import op11_imatch
from .lines import OP4_SQL, op4_lines
from .merkle import op13_merkle
from .pivots import op5_pivots
from .secret_scan import op6_secrets
from .simhash import op1_simhash
from .suffixes import op3_suffixes
from .toxicity import op2_toxicity
from .warc import OP9_SQL, op9_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_suffixes": op3_suffixes,
    "op4_lines": op4_lines,
    "op5_pivots": op5_pivots,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_imatch": op11_imatch,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op4_lines": OP4_SQL,
    "op8_chat": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
}
