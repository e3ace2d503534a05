"""The queries of the training-data operators, and SQL for those that it can express."""

from .alignment import op12_alignment
from .bpe import op9_bpe
from .decontaminate import op7_decontaminate
from .html import op3_html
from .jaccard import op5_jaccard
from .licenses import op8_licenses
from . import jaccard, lines, minhash
from .lines import op2_lines
from .media import op6_media
from .minhash import op11_minhash
from .pii import op4_pii
from .quality import op10_quality
from .substrings import op1_substrings
from .whitening import op13_whitening

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_lines": op2_lines,
    "op3_html": op3_html,
    "op4_pii": op4_pii,
    "op5_jaccard": op5_jaccard,
    "op6_media": op6_media,
    "op7_decontaminate": op7_decontaminate,
    "op8_licenses": op8_licenses,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_minhash": op11_minhash,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op2_lines": lines.ORACLE_SQL, "op5_jaccard": jaccard.ORACLE_SQL, "op11_minhash": minhash.ORACLE_SQL}
