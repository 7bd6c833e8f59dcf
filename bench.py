"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veldspar.plans import registry

HEADLINE = [
    "vec_topk_exact", "vec_topk_filtered", "vec_quantized_rescore", "lex_bm25_topk", "lex_phrase_slop0", "lex_fuzzy", "fuse_rrf", "fuse_store_policy",
    "doc_live_view", "doc_count_grouped", "graph_two_hop", "graph_optional", "cypher_two_hop", "cypher_group_aggregates", "cypher_count_rels", "cypher_eligible_search",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = registry.queries(), {}
    for name in HEADLINE:
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms the file cache
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
