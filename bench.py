"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Results are fully computed into a no-op sink. One untimed query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "flagship_transition_shares", "P2_collapse_runs_calls", "P4_clean", "P5_short_trace", "A2_token_counts", "A2_token_counts_calls",
    "E0_build_vocabulary", "E0b_frequency_vocabulary", "E1_encode", "E3_unknown_ratio", "N1_resolve_spellings", "P14_prepare_external",
    "W1_sliding_windows", "K3_top_ngrams", "F1_ngram_vocabulary", "F2_ngram_shares", "F3_statistics", "F4_category_shares_dampened",
    "F5_transition_shares_dampened", "F7_engineered_features", "F6_feature_matrix", "R1_stratified_split", "R3_augment",
    "J4_unified_labels", "K1_select_targets", "V1_family_vote", "J8_label_from_reports", "T1_parse_traces", "T2_trace_rows",
    "S1_aligned_text", "G2_per_class", "G6_roc_auc", "G8_secondary_hit_rate", "G10_generalisation_gap", "M5_confidence_gate",
    "M2_transition_scores", "M1_forest_scores", "M10_prepared_texts", "M10_score_texts",
]


def main() -> None:
    from seqlab.catalog import QUERIES
    from seqlab.runtime import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("A1_label_distribution")
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
