"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from strandlake.plans import all_queries
from strandlake.session import local_session

HEADLINE = [
    "restriction_sites", "restriction_enzyme_counts", "digest_fragments", "end_partner_counts", "ligation_products",
    "feature_sequences", "translate_all_cds", "six_frames", "open_reading_frames", "library_features",
    "annealing_temperatures", "isoform_expression", "fasta_records", "annotated_digest",
    "detect_features", "binding_sites", "assembly_products", "assembly_optimised_primers", "library_families",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 2 * int(cpus) if cpus.isdigit() else 16)
    catalog = all_queries()
    # One small scan first, so that no query pays for starting the JVM and Python workers.
    catalog["restriction_sites"].run(spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    bases = spark.read.parquet(f"{sf_dir}/part.parquet").count() * 512
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "mb_of_bases_per_sec": {n: round(bases / 1e6 / seconds[n], 3) for n in ("restriction_sites", "restriction_enzyme_counts", "open_reading_frames", "detect_features")},
    }))


if __name__ == "__main__":
    main()
