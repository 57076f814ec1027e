"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chunking import op3_substring_dedup
from .decontamination import OP9_SQL, op9_decontamination
from .html_text import op8_html_extraction
from .lines import op4_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .quality import op10_quality
from .sharding import op5_sharding
from .simhash import op7_simhash
from .suffix import op1_suffix_dedup
from .toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_html_extraction": op8_html_extraction,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}
ORACLES = {"op6_mixing": OP6_SQL, "op9_decontamination": OP9_SQL}
