"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINES = [
    "t01_knn_search", "t04_keyword_search", "t06_tfidf_vocabulary", "u01_hybrid_fusion", "f39_in_text_citations", "f47_parse_and_link", "j06_nearest_reference", "j12_last_messages",
    "j16_longest_matches", "k24_cascade_delete", "w05_reference_lines", "a29_position_statistics", "r06_latest_state", "p18_uncovered_texts",
]


def main() -> None:
    from folium.plans.catalogue import QUERIES
    from folium.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(**{"spark.local.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
