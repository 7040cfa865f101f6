"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op6_multiprobe_neighbours
from .byte_bpe import op12_byte_bpe_round_trip
from .centroids import op11_centroid_clusters
from .decontamination import op10_wu_manber_decontamination
from .html_extract import op1_tag_path_extraction
from .near_dedup import op3_chosen_path_near_dedup
from .oracles import CLUSTERS, LEAKS, NEAR_DUPLICATES
from .orc_ids import op5_orc_token_ids
from .packing import op4_best_fit_packing
from .periodic_runs import op13_periodic_runs
from .quality_gam import op7_gam_quality
from .sharding import op8_rendezvous_sharding
from .suffix_dedup import op2_suffix_dedup
from .surrogates import op9_pii_surrogates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query runs its operator over its whole table."""
    found = [
        op1_tag_path_extraction,
        op2_suffix_dedup,
        op3_chosen_path_near_dedup,
        op4_best_fit_packing,
        op5_orc_token_ids,
        op6_multiprobe_neighbours,
        op7_gam_quality,
        op8_rendezvous_sharding,
        op9_pii_surrogates,
        op10_wu_manber_decontamination,
        op11_centroid_clusters,
        op12_byte_bpe_round_trip,
        op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others have checksums, hashes, models or tokenizers without a form in SQL, or are too slow in it; tests compare them with brute force."""
    return {"op3_chosen_path_near_dedup": NEAR_DUPLICATES, "op10_wu_manber_decontamination": LEAKS, "op11_centroid_clusters": CLUSTERS}
