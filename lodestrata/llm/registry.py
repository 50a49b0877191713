"""Queries of the subpackage and their SQL."""

from .ann_curves import op6_hilbert_neighbours
from .byte_bpe import op12_recursive_bpe
from .line_dedup import OP7_SQL, op7_line_runs
from .lm_scoring import op1_deleted_interpolation
from .mixing import OP5_SQL, op5_source_mixing
from .near_dedup import op2_minhash_dedup
from .packing import op3_open_window_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op8_byte_cnn
from .sharding import op4_sampled_splitters
from .target_resampling import OP11_SQL, op11_feature_dictionary
from .topk import OP10_SQL, op10_uniform_threshold
from .warc import OP9_SQL, op9_warc_segments

QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_open_window_packing": op3_open_window_packing,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_source_mixing": op5_source_mixing,
    "op6_hilbert_neighbours": op6_hilbert_neighbours,
    "op7_line_runs": op7_line_runs,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_warc_segments": op9_warc_segments,
    "op10_uniform_threshold": op10_uniform_threshold,
    "op11_feature_dictionary": op11_feature_dictionary,
    "op12_recursive_bpe": op12_recursive_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op5_source_mixing": OP5_SQL, "op7_line_runs": OP7_SQL, "op9_warc_segments": OP9_SQL,
    "op10_uniform_threshold": OP10_SQL, "op11_feature_dictionary": OP11_SQL, "op13_prefix_trie": OP13_SQL,
}
