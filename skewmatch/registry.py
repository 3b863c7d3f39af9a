"""The registered queries: one per operator, each over whole driver tables.

Inputs (all whole tables, whole texts):
  * ``documents``: every line of every document;
  * ``pages``: page urls, and the lines of the page texts; ``part``: part names;
  * ``benchmark``: lines of even items (source 1) and odd items (source 2).
Parameters: 4 source parts and 4 reducers where the plan is the output, the
session's parallelism where the result does not depend on it; threshold 0.7.
A composite id is returned as its fields: ``doc_id, line_no``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skewmatch.functions.keys import key_first_char, key_prefix, key_prefix_lower, mark_empty
from skewmatch.functions.similarity import DEFAULT_THRESHOLD, filter_similar, score_pairs, similarity
from skewmatch.operators import distribution as dist
from skewmatch.operators import match
from skewmatch.operators.distinct import length_band, representatives
from skewmatch.operators.route import (entity_positions, place_by_reducer, plan_lookup,
                                       slice_route, split_route, split_tasks_by_block)
from skewmatch.plans.assign import reducer_load, tasks_by_cost
from skewmatch.plans.slicer import slice_cost, slice_plan, slice_size
from skewmatch.plans.split import TASK_KEY as SPLIT_KEY
from skewmatch.plans.split import split_plan
from skewmatch.plans.work import length_distribution
from skewmatch.session import run_dir
from skewmatch.sources.paths import new_output_path
from skewmatch.sources.lines import (drop_empty_lines, entity_lines, read_lines, read_matches,
                                     write_lines, write_matches)
from skewmatch.sources.tables import (benchmark_sources, distinct_lines, document_lines, page_lines,
                                      page_urls, part_names, table, tokenize_words)

PARTS = 4
REDUCERS = 4
THRESHOLD = DEFAULT_THRESHOLD
CHUNK = 256


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


def _fields(df: DataFrame) -> DataFrame:
    """Composite ids as plain columns: the fields of ``id``, and of ``id_a`` and ``id_b`` with that ending."""
    cols = []
    for c in df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, StructType):
            cols += [F.col(c)[f].alias(f + c.removeprefix("id")) for f in kind.names]
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _keyed_docs(spark, d, key="prefix"):
    return dist.keyed_entities(document_lines(spark, d), key, PARTS)


def _stats_docs(spark, d):
    return dist.block_stats(_keyed_docs(spark, d), REDUCERS)


def _next_pairs(ents: DataFrame) -> DataFrame:
    """Each entity with the entity of the next id (an equi-join, so it scales)."""
    a = ents.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    b = ents.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    return a.join(b, F.col("id_b") == F.col("id_a") + 1)


def _bench_words(spark, d):
    left, right = benchmark_sources(spark, d)
    return tokenize_words(distinct_lines(left)), tokenize_words(distinct_lines(right))


# --- 2.1 sources and sinks ---------------------------------------------------

def q_entity_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return entity_lines(docs, "doc_id", "text").drop("id")


def q_drop_empty_lines(spark, d):
    return drop_empty_lines(page_lines(spark, d)).drop("id")


def q_write_matches(spark, d):
    matches = match.split_match(page_urls(spark, d), "prefix", threshold=THRESHOLD, bring=True, **_width(spark))
    path = write_matches(matches, new_output_path(run_dir(spark)))
    return read_matches(spark, path)


def q_file_lines(spark, d):
    """The document texts as text files in doc_id order, read back as numbered lines in twice as many partitions as parts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = write_lines(docs, new_output_path(run_dir(spark), "lines"), ["doc_id"])
    return read_lines(spark, path, line_numbers=True, partitions=2 * PARTS)


# --- 2.2 projections, scalars, filters --------------------------------------

def q_block_key_prefix(spark, d):
    return _fields(document_lines(spark, d).select("id", "text", key_prefix("text").alias("block")))


def q_block_key_prefix_lower(spark, d):
    return _fields(document_lines(spark, d).select("id", "text", key_prefix_lower("text").alias("block")))


def q_block_key_first_char(spark, d):
    left, right = _bench_words(spark, d)
    words = left.unionByName(right)
    return words.select("word", key_first_char("word").alias("block"))


def q_tokenize_words(spark, d):
    left, right = benchmark_sources(spark, d)
    return (tokenize_words(left).withColumn("source", F.lit(1))
            .unionByName(tokenize_words(right).withColumn("source", F.lit(2))))


def q_distinct_lines(spark, d):
    return distinct_lines(document_lines(spark, d), "text")


def q_source_partition(spark, d):
    return _long(_fields(_keyed_docs(spark, d).select("id", "part")), "part")


def q_mark_empty_entities(spark, d):
    return _fields(page_lines(spark, d).select("id", key_prefix("text").alias("block"), mark_empty("text").alias("text")))


def q_string_similarity(spark, d):
    pairs = _next_pairs(part_names(spark, d))
    return pairs.select("id_a", "id_b", "text_a", "text_b", similarity("text_a", "text_b").alias("similarity"))


def q_score_pairs(spark, d):
    return score_pairs(_next_pairs(page_urls(spark, d)), "text_a", "text_b")


def q_filter_similar(spark, d):
    return filter_similar(score_pairs(_next_pairs(page_urls(spark, d)), "text_a", "text_b"), THRESHOLD)


# --- 2.3 grouping and aggregation -------------------------------------------

def q_block_partition_counts(spark, d):
    return _long(dist.block_partition_counts(_keyed_docs(spark, d)), "part")


def q_block_distribution_matrix(spark, d):
    bdm = dist.block_distribution_matrix(dist.block_partition_counts(_keyed_docs(spark, d)))
    return bdm.select("block", F.col("n").cast("long").alias("n"), F.col("comps").cast("long").alias("comps"),
                      dist.sizes_text(F.col("sizes")).alias("sizes"))


def q_block_partition_size(spark, d):
    bdm = dist.block_distribution_matrix(dist.block_partition_counts(_keyed_docs(spark, d)))
    return _long(dist.block_partition_size(bdm, PARTS), "part")


def q_block_index(spark, d):
    sizes = dist.block_sizes(dist.block_partition_counts(_keyed_docs(spark, d)))
    return dist.block_index(sizes.select("block"))


def q_block_sizes(spark, d):
    return _long(dist.block_sizes(dist.block_partition_counts(_keyed_docs(spark, d))), "n", "comps")


def q_block_totals(spark, d):
    sizes = dist.block_sizes(dist.block_partition_counts(_keyed_docs(spark, d)))
    return _long(dist.block_totals(sizes, REDUCERS), "n_blocks", "total_comps", "target")


def q_oversized_blocks(spark, d):
    stats = _stats_docs(spark, d)
    return _long(dist.oversized_blocks(stats).select("block", "n", "comps", "target"), "n", "comps", "target")


def q_block_members(spark, d):
    members = dist.block_members(_keyed_docs(spark, d), CHUNK)
    return members.select("block", "chunk", F.array_join(F.transform("ids", lambda i: F.concat_ws(":", i["doc_id"], i["line_no"])), ",").alias("ids"),
                          F.col("n").cast("long").alias("n"))


def q_block_cogroup(spark, d):
    left, right = _bench_words(spark, d)
    both = dist.block_cogroup(left.withColumn("block", key_first_char("word")),
                              right.withColumn("block", key_first_char("word")), "word", CHUNK)
    # words hold no space
    return both.withColumns({side: F.array_join(side, " ") for side in ("left", "right")})


# --- 2.4 match planning -------------------------------------------------------

def _split_assigned(spark, d):
    return match.split_plan_assigned(_keyed_docs(spark, d), REDUCERS)


def q_split_plan(spark, d):
    return _long(split_plan(_stats_docs(spark, d)), "i", "j", "comps")


def q_slice_size(spark, d):
    stats = _stats_docs(spark, d)
    return _long(stats.select("block", "n", "target", slice_size(F.col("n"), F.col("target")).alias("u")), "n", "target")


def q_slice_cost(spark, d):
    stats = _stats_docs(spark, d)
    u = slice_size(F.col("n"), F.col("target"))
    return _long(stats.select("block", "n", u.alias("u"), slice_cost(F.col("n").cast("long"), u).alias("comps")), "n", "comps")


def q_slice_plan(spark, d):
    return _long(slice_plan(_stats_docs(spark, d)), "slice", "comps")


def q_tasks_by_cost(spark, d):
    return _long(tasks_by_cost(split_plan(_stats_docs(spark, d)), SPLIT_KEY), "i", "j", "comps")


def q_assign_reducers(spark, d):
    _, assigned = _split_assigned(spark, d)
    return _long(assigned, "i", "j", "reducer", "comps")


def q_reducer_load(spark, d):
    _, assigned = _split_assigned(spark, d)
    return _long(reducer_load(assigned), "reducer", "comps")


# --- 2.5 routing ----------------------------------------------------------------

def q_split_route(spark, d):
    keyed = _keyed_docs(spark, d)
    stats, assigned = match.split_plan_assigned(keyed, REDUCERS)
    routed = split_route(keyed, stats, assigned)
    return _long(_fields(routed.select("reducer", "block", "i", "j", "part", "id")), "reducer", "i", "j", "part")


def q_slice_route(spark, d):
    keyed = _keyed_docs(spark, d)
    stats, assigned = match.slice_plan_assigned(keyed, REDUCERS)
    routed = slice_route(entity_positions(keyed), stats, assigned)
    return _long(_fields(routed.select("reducer", "block", "slice", "pos", "replicated", "id")), "reducer", "slice")


def q_place_by_reducer(spark, d):
    keyed = _keyed_docs(spark, d)
    stats, assigned = match.split_plan_assigned(keyed, REDUCERS)
    placed = place_by_reducer(split_route(keyed, stats, assigned), REDUCERS)
    return (placed.withColumn("partition", F.spark_partition_id().cast("long"))
                  .groupBy("partition", "reducer").agg(F.count(F.lit(1)).alias("rows"))
                  .withColumn("reducer", F.col("reducer").cast("long")))


def q_plan_lookup(spark, d):
    keyed = _keyed_docs(spark, d)
    stats, assigned = match.split_plan_assigned(keyed, REDUCERS)
    tasks = split_tasks_by_block(stats, assigned).select("block", "tasks")
    info = stats.select("block", "oversized", "n", "comps").join(tasks, "block", "left")
    looked = plan_lookup(keyed, info, stats)
    n_tasks = F.when(F.col("tasks").isNull(), 0).otherwise(F.size("tasks")).alias("n_tasks")
    return _long(_fields(looked.select("id", "block", "part", "n", "comps", "oversized", n_tasks)),
                 "part", "n", "n_tasks", "comps")


# --- 2.6 matchers ---------------------------------------------------------------

def _width(spark) -> dict:
    """Parts and reducers of a matcher whose result does not depend on them: three reducers per core, so that the slowest one does
    not set the time."""
    reducers = max(REDUCERS, 3 * spark.sparkContext.defaultParallelism)
    return {"parts": max(PARTS, math.ceil(math.sqrt(2 * reducers))), "reducers": reducers}


def q_basic_match(spark, d):
    return _fields(match.basic_match(document_lines(spark, d), "prefix_lower", THRESHOLD))


def q_split_match(spark, d):
    return _fields(match.split_match(document_lines(spark, d), "prefix", threshold=THRESHOLD, **_width(spark)))


def q_split_match_tagged(spark, d):
    out = match.split_match(document_lines(spark, d), "prefix", PARTS, REDUCERS, THRESHOLD, tagged=True)
    return _long(_fields(out), "reducer", "i", "j", "part_a", "part_b")


def q_slice_match(spark, d):
    return _fields(match.slice_match(document_lines(spark, d), "prefix", threshold=THRESHOLD, **_width(spark)))


def q_two_source_match(spark, d):
    left, right = _bench_words(spark, d)
    return match.two_source_match(left, right, _width(spark)["reducers"], THRESHOLD)


def q_length_distribution(spark, d):
    """Entities and characters (one more per text) per block and length band."""
    lines = document_lines(spark, d).select(key_prefix("text").alias("block"), F.length(F.lower("text")).alias("llen"))
    banded = lines.withColumn("band", length_band(F.col("llen"), THRESHOLD))
    return _long(length_distribution(banded), "band", "chars", "squares")


def q_distinct_match(spark, d):
    """Matching distinct texts of a block instead of matching lines: the scalable form of the matchers' result."""
    reps, _ = representatives(dist.keyed_entities(document_lines(spark, d), "prefix", PARTS))
    found = match.distinct_match(reps, _width(spark)["reducers"], THRESHOLD)
    return found.select("block", "low_a", "low_b", "similarity", "n_a", "n_b")


# --- the same operators on other inputs ------------------------------------------
# pages: all urls share one block (the hottest possible key); parts: 8 blocks.

def q_split_match_pages(spark, d):
    return match.split_match(page_urls(spark, d), "prefix", threshold=THRESHOLD, bring=True, **_width(spark))


def q_slice_match_pages(spark, d):
    return match.slice_match(page_urls(spark, d), "prefix", threshold=THRESHOLD, bring=True, **_width(spark))


def q_basic_match_parts(spark, d):
    return match.basic_match(part_names(spark, d), "prefix_lower", THRESHOLD)


def q_split_match_parts(spark, d):
    return match.split_match(part_names(spark, d), "prefix", threshold=THRESHOLD, **_width(spark))


def q_slice_match_parts(spark, d):
    return match.slice_match(part_names(spark, d), "prefix", threshold=THRESHOLD, **_width(spark))


def _slice_assigned(spark, d):
    return match.slice_plan_assigned(_keyed_docs(spark, d), REDUCERS)


def q_assign_reducers_slices(spark, d):
    _, assigned = _slice_assigned(spark, d)
    return _long(assigned, "slice", "reducer", "comps")


def q_reducer_load_slices(spark, d):
    _, assigned = _slice_assigned(spark, d)
    return _long(reducer_load(assigned), "reducer", "comps")


QUERIES = {
    "entity_lines": q_entity_lines,
    "drop_empty_lines": q_drop_empty_lines,
    "file_lines": q_file_lines,
    "write_matches": q_write_matches,
    "block_key_prefix": q_block_key_prefix,
    "block_key_prefix_lower": q_block_key_prefix_lower,
    "block_key_first_char": q_block_key_first_char,
    "tokenize_words": q_tokenize_words,
    "distinct_lines": q_distinct_lines,
    "source_partition": q_source_partition,
    "mark_empty_entities": q_mark_empty_entities,
    "string_similarity": q_string_similarity,
    "score_pairs": q_score_pairs,
    "filter_similar": q_filter_similar,
    "block_partition_counts": q_block_partition_counts,
    "block_distribution_matrix": q_block_distribution_matrix,
    "block_partition_size": q_block_partition_size,
    "block_index": q_block_index,
    "block_sizes": q_block_sizes,
    "block_totals": q_block_totals,
    "oversized_blocks": q_oversized_blocks,
    "block_members": q_block_members,
    "block_cogroup": q_block_cogroup,
    "split_plan": q_split_plan,
    "slice_size": q_slice_size,
    "slice_cost": q_slice_cost,
    "slice_plan": q_slice_plan,
    "tasks_by_cost": q_tasks_by_cost,
    "assign_reducers": q_assign_reducers,
    "reducer_load": q_reducer_load,
    "split_route": q_split_route,
    "slice_route": q_slice_route,
    "place_by_reducer": q_place_by_reducer,
    "basic_match": q_basic_match,
    "split_match": q_split_match,
    "split_match_tagged": q_split_match_tagged,
    "slice_match": q_slice_match,
    "two_source_match": q_two_source_match,
    "length_distribution": q_length_distribution,
    "distinct_match": q_distinct_match,
    "plan_lookup": q_plan_lookup,
    "split_match_pages": q_split_match_pages,
    "slice_match_pages": q_slice_match_pages,
    "basic_match_parts": q_basic_match_parts,
    "split_match_parts": q_split_match_parts,
    "slice_match_parts": q_slice_match_parts,
    "assign_reducers_slices": q_assign_reducers_slices,
    "reducer_load_slices": q_reducer_load_slices,
}
