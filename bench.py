"""Wall time per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """k01_dedup_median k03_dedup_continuity k07_monotone_cap k08_monotone_drop k09_thin k11_trim_tail_drop k15_fill_linear k19_resample clean_curve
clean_curve_min_drop j01_equi_join j04_asof_step j06_nearest j07_mask_boxes j09_nearest_dark j12_fuzzy_name x02_merge_overlap x03_fix_ordering x08_fix_continuity
x11_track q09_qc_score v08_overlay_match v09_dense_match p01_with_hsv p03_classify_color p08_adaptive_dark a02_detect_palette a06_column_pick_continuous a08_column_overlap_rules
w01_runs w06_reference_lines w10_connected_components w19_line_style w20_dash_score w21_group_tokens_by_row m01_dilate m04_skeleton m06_bridge_endpoints c07_correct_axis_labels
c09_calibrate r05_assemble_cells r09_repair_with_anchors r14_reconcile_tables t01_parse_table_response t13_model_points_to_curves g01_sweep s02_read_pixels flow_color_curves
flow_named_curves flow_scored_curves""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("curvekit-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from curvekit.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["p01_with_hsv"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
