"""The queries of this subpackage by name."""

from __future__ import annotations

from .bpe import op1_bpe_round_trip
from .collocations import OP13_SQL, op13_collocations
from .decontaminate import op7_decontamination
from .quality import op3_quality_classifier
from .rollup import OP8_SQL, op8_token_rollup
from .setsketch import op11_setsketch_near_dedup
from .simhash import op5_simhash_near_dedup
from .substrings import OP6_SQL, op6_substring_dedup
from .tokenfile import op4_token_files
from .topk import OP9_SQL, op9_exact_topk
from .toxicity import op2_toxicity_neighbours
from .urls import OP10_SQL, op10_url_filter
from .whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_toxicity_neighbours, op3_quality_classifier, op4_token_files, op5_simhash_near_dedup, op6_substring_dedup, op7_decontamination, op8_token_rollup, op9_exact_topk, op10_url_filter, op11_setsketch_near_dedup, op12_embedding_whitening, op13_collocations)}

ORACLES: dict[str, str] = {"op6_substring_dedup": OP6_SQL, "op8_token_rollup": OP8_SQL, "op9_exact_topk": OP9_SQL, "op10_url_filter": OP10_SQL, "op13_collocations": OP13_SQL}
