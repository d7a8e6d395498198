"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op2_kmeans_tree
from .language import op6_compression_language
from .lm import op10_kneser_ney
from .mixing import OP3_SQL, op3_curriculum_mix
from .packing import op5_order_preserving_packing
from .pii import op1_feistel_pseudonyms
from .quality import op8_compression_bands
from .repeats import op4_run_length_index
from .resample import OP11_SQL, op11_byte_automaton
from .simhash import op9_simhash_tiles
from .tokens import op12_prefix_tokens
from .warc import OP7_SQL, op7_sharded_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_feistel_pseudonyms, op2_kmeans_tree, op3_curriculum_mix, op4_run_length_index, op5_order_preserving_packing, op6_compression_language, op7_sharded_warc, op8_compression_bands, op9_simhash_tiles, op10_kneser_ney, op11_byte_automaton, op12_prefix_tokens)}
ORACLE_SQL: dict[str, str] = {"op3_curriculum_mix": OP3_SQL, "op7_sharded_warc": OP7_SQL, "op11_byte_automaton": OP11_SQL}
