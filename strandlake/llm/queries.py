"""The registered queries of the training-data operators."""

from __future__ import annotations

from .decontaminate import op9_prefix_filtered_decontamination
from .exact_dedup import op5_lsm_exact_dedup
from .kmeans import op11_centroid_gemm
from .line_dedup import op4_line_windows
from .merkle import op12_merkle_manifest
from .minhash import op13_minhash_multi_index
from .mixing import op3_rake_mixture
from .quality import op8_factorisation_machine
from .sharding import op1_histogram_sort
from .simhash import op6_simhash_tiles
from .substring_dedup import op7_repeated_phrase_automata
from .token_records import op2_token_records
from .warc import op10_warc_index_first

QUERIES = {
    "op1_histogram_sort": op1_histogram_sort,
    "op2_token_records": op2_token_records,
    "op3_rake_mixture": op3_rake_mixture,
    "op4_line_windows": op4_line_windows,
    "op5_lsm_exact_dedup": op5_lsm_exact_dedup,
    "op6_simhash_tiles": op6_simhash_tiles,
    "op7_repeated_phrase_automata": op7_repeated_phrase_automata,
    "op8_factorisation_machine": op8_factorisation_machine,
    "op9_prefix_filtered_decontamination": op9_prefix_filtered_decontamination,
    "op10_warc_index_first": op10_warc_index_first,
    "op11_centroid_gemm": op11_centroid_gemm,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_minhash_multi_index": op13_minhash_multi_index,
}
