"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: total seconds, seconds per query, result rows, and
largest reducer load divided by the mean (1.0 = perfectly even): in pairs for the
plans by pairs (``max_load_over_target``), in edit-distance cells for the plan that the split
matcher runs, and the pairs that it compares (``compared``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from skewmatch.operators import distribution as dist  # noqa: E402
from skewmatch.operators import match  # noqa: E402
from skewmatch.operators.distinct import representatives  # noqa: E402
from skewmatch.plans.assign import reducer_load  # noqa: E402
from skewmatch.registry import QUERIES  # noqa: E402
from skewmatch.session import local_session  # noqa: E402
from skewmatch.sources.tables import document_lines, page_urls, part_names  # noqa: E402

PARTS = 8
REDUCERS = 16


def _matcher(kind: str, source):
    def run(spark, d):
        ents = source(spark, d)
        if kind == "basic":
            return match.basic_match(ents, "prefix")
        width = 3 * spark.sparkContext.defaultParallelism
        if kind == "split":
            return match.split_match(ents, "prefix", PARTS, width)
        return match.slice_match(ents, "prefix", PARTS, width)
    return run


def _cells(spark, d) -> dict:
    """The plan by cells over the document lines: balance for three numbers of reducers, and the pairs left after each step."""
    keyed = dist.keyed_entities(document_lines(spark, d))
    reps, _ = representatives(keyed)
    pairs = lambda df: int(dist.block_sizes(dist.block_partition_counts(df)).agg(F.sum("comps")).first()[0])
    out = {"pairs": pairs(keyed), "of_distinct_texts": pairs(reps.withColumn("part", F.lit(0)))}
    balance = {}
    for reducers in (24, 64, 512):
        banded, units, tasks = match.work_plan_assigned(reps, reducers)
        top, total = reducer_load(tasks, "cells").agg(F.max("cells"), F.sum("cells")).first()
        balance[str(reducers)] = round(float(top) * reducers / float(total), 4)
        out["in_bands"] = int(tasks.agg(F.sum("comps")).first()[0])
    return {"max_cells_over_mean": balance, "compared": out}


def _balance(spark, d, kind: str, source) -> float:
    keyed = dist.keyed_entities(source(spark, d), "prefix", PARTS)
    plan = match.split_plan_assigned if kind == "split" else match.slice_plan_assigned
    stats, assigned = plan(keyed, REDUCERS)
    target = stats.first().target
    top = reducer_load(assigned).agg(F.max("comps")).first()[0]
    return round(float(top) / float(target), 4)


BENCH = {
    "pages_basic_match": _matcher("basic", page_urls),
    "pages_split_match": _matcher("split", page_urls),
    "pages_slice_match": _matcher("slice", page_urls),
    "parts_split_match": _matcher("split", part_names),
    "parts_slice_match": _matcher("slice", part_names),
    "documents_basic_match": QUERIES["basic_match"],
    "documents_split_match": QUERIES["split_match"],
    "documents_slice_match": QUERIES["slice_match"],
    "documents_distinct_match": QUERIES["distinct_match"],
    "two_source_match": QUERIES["two_source_match"],
    "documents_block_distribution_matrix": QUERIES["block_distribution_matrix"],
    "documents_split_plan_assigned": QUERIES["assign_reducers"],
    "documents_slice_plan": QUERIES["slice_plan"],
    "documents_slice_route": QUERIES["slice_route"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) * 2, app="skewmatch-bench")
    QUERIES["two_source_match"](spark, sf_dir).count()  # JVM and code warm-up, not timed
    times, rows = {}, {}
    for name, fn in BENCH.items():
        t0 = time.time()
        df = fn(spark, sf_dir)
        rows[name] = df.count()
        times[name] = round(time.time() - t0, 3)
    balance = {
        f"{src}_{kind}": _balance(spark, sf_dir, kind, fn)
        for src, fn in (("pages", page_urls), ("parts", part_names), ("documents", document_lines))
        for kind in ("split", "slice")
    }
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "max_load_over_target": balance,
                      **_cells(spark, sf_dir), "reducers": REDUCERS, "parts": PARTS, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
