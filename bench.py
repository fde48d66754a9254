"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "prj01_doc_token_offset", "prj06_char_to_token_span", "prj23_remove_nested_mentions", "prj32_split_into_segments", "prj36_locate_phrase",
    "jon08_frames_in_segment", "jon11_box_overlap_join", "jon13_token_vectors", "jon15_mention_vector_mean", "agg01_build_vocab", "agg13_pool_segments_mean",
    "win01_rank_antecedents", "win02_topk_retrieval", "em09_fit", "em10_predict_antecedents", "em12_antecedents_to_clusters", "em17_mixture_translate",
    "met02_pairwise_by_type", "met05_muc", "met06_b_cubed", "met10_average_precision",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from corefold import catalog
    from corefold.catalog.tables import Tables
    from corefold.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "corefold-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    tables = Tables(spark, folder)
    tables.mentions()
    tables.log()
    times["derived_tables"] = round(time.time() - start, 3)
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
