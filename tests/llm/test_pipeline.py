"""The pipeline against plain Python, on repeated rows, bad labels, near copies and columns with clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skewmatch.llm import mixing, packing, pipeline, quality
from skewmatch.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _slot string, _takes string, _doc string, _content string, "
          "row string, doc string, slot string, takes string, kept string")
CLASH = ["a", "b", "c", "d", "e", "f", "g", "h", "i"]


def _rows():
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(k, prose(rng.randint(30, 120)), "en", f"s{k % 3}" if k % 11 else None, None) for k in range(60)]
    bad = [(100 + k, "!!! " + "$$$ 000 " * rng.randint(20, 60), "en", "s1", None) for k in range(40)]
    near = []
    for k in range(5):
        words = rows[k][1].split(" ") + prose(80).split(" ")
        rows[k] = (k, " ".join(words), *rows[k][2:])
        words[3] = "changed"
        near.append((200 + k, " ".join(words), "en", "s0", None))
    copies = [(300, rows[9][1].replace(" ", "\n"), "en", "s2", 5), rows[10], rows[10], (None, rows[11][1], "en", "s0", 1), (None, None, None, None, None),
              (5, None, "en", "s0", 0), (301, "", "en", "s0", 0), (None, prose(40), "en", "s9", 7)]
    return rows + bad + near + copies, {r[0]: int(r[0] < 100 or r[0] >= 200) for r in rows + bad if r[0] % 2 == 0}


def _shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def _one_per_exact_group(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _one_per_near_group(rows):
    sets, low = [_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _key(rows):
    return sorted((str(r[0]), r[1] or "", str(r[3])) for r in rows)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, labels = _rows()
    spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(sorted(labels.items()), "doc_id long, quality long").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_every_stage_equals_plain_python(spark, table, tmp_path):
    docs = documents(spark, table)
    now = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, table)
        if k == 4:
            assert sum(r.length for r in out.collect()) == sum(r.doc_tokens for r in packing.pack(docs).filter("start = 0").collect())
            break
        assert out.schema == docs.schema
        out.write.parquet(str(tmp_path / f"s{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"s{k}"))
        got = [tuple(r) for r in docs.collect()]
        assert all(list(r[5:]) == CLASH for r in got), name
        if k == 0:  # the scores are the model's; the decision on each row is checked
            good = quality.quality(before.withColumn("doc_id", F.xxhash64("doc_id", "text")), spark.read.parquet(f"{table}/labels.parquet")).count()
            assert good == len(now) and 40 < len(got) < len(now)
            assert not [r for r in got if (r[1] or "").startswith("!!!")] and len([r for r in got if r[0] is not None and r[0] < 100]) >= 60
        if k == 1:
            assert _key(got) == _key(_one_per_exact_group(now)) and len(got) < len(now)
        if k == 2:
            assert _key(got) == _key(_one_per_near_group(now)) and len(got) == len(now) - 5
        if k == 3:
            size, mixed = Counter(), Counter()
            for r in now:
                size[r[0]] += len(WORD.findall(r[1] or ""))
            taken = Counter()
            for r in mixing.mix(before).collect():
                taken[r.doc_id] += r.taken
            for r in got:
                mixed[r[0]] += len(WORD.findall(r[1]))
                assert r[4] == len(r[1])
                whole = next(" ".join(WORD.findall(x[1])) for x in now if x[0] == r[0] and x[3] == r[3])
                assert all(" ".join(WORD.findall(piece)) in whole for piece in r[1].split("\n") if piece)
            assert {d: n for d, n in mixed.items() if n} == {d: n for d, n in taken.items() if n}
            assert all(n <= 2 * size[d] for d, n in mixed.items())
        now = got
    assert corpus_pipeline.run(spark, table).count() > 0


def test_repeated_rows_each_have_their_ranges(spark):
    rows = [(k % 20, " ".join(f"w{k % 20}x{j}" for j in range(200)), f"s{k % 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = sum(r.taken for r in mixing.mix(docs, block=16).collect())
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs, block=16).collect())
    assert words == plan > 0
    assert pipeline.exact_stage(spark, docs, "").count() == 20
    assert pipeline.near_stage(spark, docs, "").count() == 20


def test_empty_stages(spark, table):
    empty = documents(spark, table).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, table).count() == 0, name
