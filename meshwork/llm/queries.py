"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from .bpe import op8_bpe
from .conversations import OP12_SQL, op12_conversations
from .licences import op4_licences
from .lines import OP1_SQL, op1_line_dedup
from .lm import op2_log_bilinear
from .merkle import OP13_SQL, op13_merkle
from .minhash import OP7_SQL, op7_minhash
from .mixing import op9_mixing
from .pii import op10_pii
from .quality import op5_quality
from .sentencepiece import op11_sentencepiece
from .suffix import OP6_SQL, op6_suffix_array
from .webp import op3_webp

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_log_bilinear": op2_log_bilinear,
    "op3_webp": op3_webp,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_suffix_array": op6_suffix_array,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversations": op12_conversations,
    "op13_merkle": op13_merkle,
}

#: DuckDB SQL of those queries that SQL can express.
SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op6_suffix_array": OP6_SQL,
    "op7_minhash": OP7_SQL,
    "op12_conversations": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
