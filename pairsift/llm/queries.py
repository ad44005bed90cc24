"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from .chat import ORACLE_OP1, op1_chat
from .decontaminate import op5_decontaminate
from .html import op6_html
from .infill import ORACLE_OP13, op13_infill
from .language import op4_language
from .quality import op8_quality
from .license import ORACLE_OP3, op3_license
from .mixing import ORACLE_OP2, op2_mixing
from .ppm import op10_lm
from .simhash import op9_neardup
from .trie import ORACLE_OP12, op12_trie
from .vectors import ORACLE_OP7, op7_topk
from .warc import ORACLE_OP11, op11_warc

QUERIES = {
    "op1_chat": op1_chat,
    "op2_mixing": op2_mixing,
    "op3_license": op3_license,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_html": op6_html,
    "op7_topk": op7_topk,
    "op8_quality": op8_quality,
    "op9_neardup": op9_neardup,
    "op10_lm": op10_lm,
    "op11_warc": op11_warc,
    "op12_trie": op12_trie,
    "op13_infill": op13_infill,
}

ORACLES: dict[str, str] = {
    "op1_chat": ORACLE_OP1,
    "op2_mixing": ORACLE_OP2,
    "op3_license": ORACLE_OP3,
    "op7_topk": ORACLE_OP7,
    "op11_warc": ORACLE_OP11,
    "op12_trie": ORACLE_OP12,
    "op13_infill": ORACLE_OP13,
}
