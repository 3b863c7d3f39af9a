"""Sources and sinks: text files, table lines, the result writer, block tables."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import entities
from skewmatch.operators import distribution as dist
from skewmatch.operators import match
from skewmatch.session import checkpoint_dir, exists, run
from skewmatch.sources.lines import drop_empty_lines, entity_lines, read_lines, read_matches, write_matches
from skewmatch.sources.paths import new_output_path
from skewmatch.sources.tables import document_lines, page_lines
from test_match import SAMPLE


def test_read_lines_numbers_lines(spark):
    folder = tempfile.mkdtemp(prefix="skewmatch-src-", dir="/tmp")
    path = os.path.join(folder, "doc.txt")
    with open(path, "w", newline="") as f:
        f.write("\r\n".join(SAMPLE))  # CRLF line ends, no final newline
    got = read_lines(spark, path, line_numbers=True).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == list(enumerate(SAMPLE))
    plain = read_lines(spark, path).collect()
    assert sorted(r.text for r in plain) == sorted(SAMPLE) and len({r.id for r in plain}) == len(SAMPLE)


def test_line_numbers_over_many_splits_and_files(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"f{k}.txt", "w") as f:
            f.writelines(f"file {k} line {i} {'x' * (i % 50)}\n" for i in range(2000 + k))
    want = [f"file {k} line {i} {'x' * (i % 50)}" for k in range(3) for i in range(2000 + k)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = read_lines(spark, str(tmp_path), line_numbers=True)
        assert lines.rdd.getNumPartitions() > 10
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert [(r.id, r.text) for r in lines.orderBy("id").collect()] == list(enumerate(want))
        assert "rangepartitioning" not in plan and "Exchange" not in plan.split("FileScan")[0].replace("BroadcastExchange", "")
        assert read_lines(spark, str(tmp_path), line_numbers=True, partitions=5).rdd.getNumPartitions() == 5
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def _folders(base):
    return sorted(os.listdir(base.removeprefix("file:")))


def test_nothing_is_left_of_a_run(spark, tmp_path):
    base = checkpoint_dir(spark)
    before = _folders(base)
    ents = entities(spark, SAMPLE)
    with run(spark) as folder:
        out = write_matches(match.split_match(ents), str(tmp_path / "out"))
        assert exists(spark, folder)
    assert _folders(base) == before and read_matches(spark, out).count() > 0
    try:
        with run(spark) as folder:
            match.split_match(ents).select(F.raise_error(F.lit("broken"))).collect()
    except Exception as e:
        assert "broken" in str(e)
    assert not exists(spark, folder) and _folders(base) == before


def test_results_are_written_whole_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "result")
    bad = entities(spark, ["a", "b"]).select(F.when(F.col("text") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("text")).alias("t"))
    for attempt in range(2):
        try:
            write_matches(bad, out)
            raise AssertionError
        except Exception as e:
            assert "broken" in str(e)
        assert os.listdir(tmp_path) == []
    good = entities(spark, ["a", "b"])
    write_matches(good, out)
    try:
        write_matches(good, out)
        raise AssertionError
    except FileExistsError:
        pass
    write_matches(good.limit(1), out, mode="overwrite")
    assert os.listdir(tmp_path) == ["result"] and read_matches(spark, out).count() == 1


def test_entity_lines_of_a_column(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "\n")], "rid long, text string")
    got = entity_lines(df, "rid", "text").select("id", "text", "rid", "line_no").collect()
    assert sorted(tuple(r) for r in got) == [((1, 0), "a", 1, 0), ((1, 1), "b", 1, 1), ((2, 0), "", 2, 0)]
    assert drop_empty_lines(entity_lines(df, "rid", "text")).count() == 2


def test_a_record_of_many_lines(spark):
    # No cap on lines or record numbers: ids stay unique.
    df = spark.createDataFrame([(2**62, "x\n" * 1_200_000), (2**62 + 1, "y")], "rid long, text string")
    lines = entity_lines(df, "rid", "text")
    assert lines.count() == lines.select("id").distinct().count() == 1_200_001


def test_inputs_exercise_the_filters(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    assert 0 < drop_empty_lines(lines).count() < lines.count()
    docs = document_lines(spark, sf_dir).select("text")
    assert docs.distinct().count() < docs.count()


def test_cogroup_members(spark):
    left = spark.createDataFrame([("ab", "a"), ("ab", "a"), ("ac", "a"), ("x", "x")], "word string, block string")
    right = spark.createDataFrame([("aa", "a"), ("z", "z")], "word string, block string")
    got = {(r.block, r.chunk): (r.left, r.right, r.n_left, r.n_right) for r in dist.block_cogroup(left, right, chunk=2).collect()}
    assert got == {("a", 0): (["ab", "ab"], ["aa"], 2, 1), ("a", 1): (["ac"], [], 1, 0),
                   ("x", 0): (["x"], [], 1, 0), ("z", 0): ([], ["z"], 0, 1)}


def test_write_and_read_back(spark):
    ents = entities(spark, ["abcd", "abce", "xyz"])
    m = match.split_match(ents)
    for fmt in ("parquet", "csv", "json"):
        path = write_matches(m, new_output_path(checkpoint_dir(spark)), fmt)
        back = read_matches(spark, path, fmt, schema="id_a long, id_b long, text_a string, text_b string, similarity double")
        assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in m.collect())


def test_block_tables(spark):
    ents = entities(spark, ["abc1", "abc2", "abc3", "abc4", "abc5", "zz"])
    keyed = dist.keyed_entities(ents, "prefix", 2)
    counts = {(r.block, r.part): r.size for r in dist.block_partition_counts(keyed).collect()}
    assert counts == {("ABC", 0): 3, ("ABC", 1): 2, (">>>", 1): 1}
    bdm = dist.block_distribution_matrix(dist.block_partition_counts(keyed))
    dense = {(r.block, r.part): r.size for r in dist.block_partition_size(bdm, 2).collect()}
    assert dense[(">>>", 0)] == 0 and dense[("ABC", 1)] == 2
    text = {r.block: r.s for r in bdm.select("block", dist.sizes_text(F.col("sizes")).alias("s")).collect()}
    assert text == {"ABC": "0:3,1:2", ">>>": "1:1"}
    tot = dist.block_totals(dist.block_sizes(dist.block_partition_counts(keyed)), 4).first()
    assert (tot.n_blocks, tot.n_entities, tot.total_comps, tot.target) == (2, 6, 10, 3)
    members = dist.block_members(keyed, chunk=2).filter("block = 'ABC'").orderBy("chunk").collect()
    assert [r.ids for r in members] == [[0, 1], [2, 3], [4]]


def test_two_source_grid_salting(spark):
    # Many reducers make the target tiny, so the blocks are salted into grids;
    # the result must equal the unsalted one.
    words = [("w%03d" % i,) for i in range(60)] + [("wx%02d" % i,) for i in range(30)]
    left = spark.createDataFrame(words, "word string")
    right = spark.createDataFrame(words[::2] + words[::3], "word string")
    base = sorted(tuple(r) for r in match.two_source_match(left, right, reducers=1).collect())
    salted = sorted(tuple(r) for r in match.two_source_match(left, right, reducers=500).collect())
    assert base == salted and len(base) > 100


def test_two_source_cells_are_even(spark):
    from skewmatch.plans.assign import reducer_load

    words = spark.range(3000).select(F.concat(F.when(F.col("id") % 3 == 0, "a").otherwise(F.chr(F.col("id") % 20 + 98)), F.hex("id"),
                                              F.repeat(F.lit("z"), (F.col("id") % 9).cast("int"))).alias("word"))
    left, right = match.source_words(words, "l"), match.source_words(words.filter("length(word) < 9"), "r")
    for reducers in (8, 64):
        grid = match.two_source_grid(left, right, reducers)
        tasks = match.two_source_plan(left, right, grid, reducers)
        pairs = left.join(right.withColumnRenamed("word", "other"), "block").count()
        assert tasks.agg(F.sum("comps")).first()[0] == pairs
        loads = [float(r.cells) for r in reducer_load(tasks, "cells").collect()]
        assert max(loads) <= 1.1 * sum(loads) / reducers


def test_written_matches_reach_across_hosts(spark, tmp_path):
    from skewmatch.registry import q_write_matches

    urls = ["http://a.example.com/en/1", "http://b.example.com/en/1", "http://b.example.com/en/1?ref=a&page=22&utm_source=feed", "ftp://a.example.com/en/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [(r.id_a, r.id_b) for r in q_write_matches(spark, str(tmp_path)).collect()] == [(0, 1)]
