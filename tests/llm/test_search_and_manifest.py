"""Top-k search, ranked search and the Merkle manifest against plain Python, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewmatch.llm import balltree, merkle, nra

# --- op11 -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row long, dim int, block int, vector string"


def _vectors(spark, rows):
    return spark.createDataFrame([(v, e, 0, 1, 2, 3, "x") for v, e in rows], VECTORS).repartition(3)


def _best(rows, k, mod):
    """Plain Python: rows told apart by place."""
    good = [(v, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e in rows
            if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, a) in enumerate(good):
        if q % mod == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for j, (v, b) in enumerate(good) if j != i and len(b) == len(a))
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def _got(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("shard_rows,settle", [(40, 1), (40, 8), (4096, None)])
def test_top_k_equals_brute_force(spark, shard_rows, settle):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 12)]) for k in range(300)]
    rows += [(300 + k, [float(x) for x in rng.integers(-2, 3, 12)]) for k in range(60)]  # ties
    rows += [(400 + k, [0.5] * 12) for k in range(40)]  # copies
    got = nra.top_k(_vectors(spark, rows), F.col("vec_id") % 20 == 0, 5, settle=settle, shard_rows=shard_rows, block_rows=7)
    assert _got(got) == _best(rows, 5, 20)


def test_top_k_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (40, [inf, 1.0]), (None, [9.0, 9.0]),
            (4, [-1.0, -2.0]), (5, [1.0, 2.0, 3.0]), (60, [1.0]), (7, []), (80, []), (8, [3e12, -1e-30])]
    assert _got(nra.top_k(_vectors(spark, rows), F.col("vec_id") % 20 == 0, 3)) == _best(rows, 3, 20)
    none = nra.top_k(_vectors(spark, []), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert nra.top_k(_vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 5, (2000, 8)))
    vectors[:10] += 400
    ids = np.arange(2000)
    shard = nra.Shard(ids.tobytes(), ids.tobytes(), vectors.tobytes(), 8)
    seen = []
    resolve = shard.resolve
    shard.resolve = lambda query, alive, floor, k: seen.append(len(alive)) or resolve(query, alive, floor, k)
    got, = shard.search(np.full((1, 8), 3.0), np.array([0]), np.array([-np.inf]), 5, 16)
    assert [v for _, v, _ in got] == sorted(range(1, 10), key=lambda j: (-vectors[j].sum(), j))[:5]
    assert seen[0] <= 16


# --- op12 -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _ranking(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    total = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + (25 * c.total() * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in _terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc is not None, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return out


def _text_rows(seed=2, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeßÉ9") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    docs = [(k, " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    docs += [(n + k, docs[5][1]) for k in range(30)] + [(900, None), (901, ""), (902, "...!"), (903, "ab " * 20_000), (904, "_a_b-c")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(25)]
    return docs, items + [(100, None), (101, ""), (102, "zzzz unknown"), (103, "ab ab ab AB"), (104, docs[5][1])]


DOCS = "doc_id long, text string, source string, term string, part int, kind int, df long, item long"


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", 1, 2, 3, 4) for d, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("shard_docs,block_items", [(2048, 256), (16, 4)])
def test_ranking_equals_brute_force(spark, shard_docs, block_items, monkeypatch):
    docs, items = _text_rows()
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    got = balltree.ranked(_docs(spark, docs), table, 20, shard_docs=shard_docs, block_items=block_items).collect()
    assert sorted(map(tuple, got)) == sorted(_ranking(docs, items, 20))


def test_ranking_awkward_rows(spark):
    table = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b")], "item_id long, text string")
    docs = [(None, "a b c"), (3, "a"), (3, "a"), (4, "b a")]
    got = balltree.ranked(_docs(spark, docs), table, 3).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _ranking(docs, [(1, "a b"), (1, "a b"), (None, "b")], 3)))
    assert balltree.ranked(_docs(spark, []), table).count() == 0
    assert balltree.ranked(_docs(spark, docs), table.limit(0)).count() == 0
    assert balltree.ranked(_docs(spark, [(1, None)]), table).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    width = 300
    kinds = [np.sort(rng.choice(width, 12, replace=False)) for _ in range(10)]  # ten texts, each with many near copies
    rows = [np.sort(np.append(np.delete(kinds[k % 10], k % 12), (kinds[k % 10][0] + k) % width)) for k in range(600)]
    rows = [np.unique(r) for r in rows]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    codes, values = np.concatenate(rows).astype(np.int32), rng.integers(900_000, 10 ** 6, starts[-1])
    tree = balltree.Tree(starts, codes, values, width)
    items = np.zeros((width, 5))
    for j in range(5):
        items[rows[j], j] = 5000
    bound = tree.bounds(items)
    full = np.zeros((600, width), np.int64)
    full[np.repeat(np.arange(600), np.diff(starts)), codes] = values
    scores = full @ items.astype(np.int64)
    for node, docs in enumerate(tree.docs):
        assert (scores[docs] <= bound[node]).all()
    best: list = []
    scored = balltree.nearest(tree, items[:, 0].astype(np.int64), bound[:, 0], np.arange(600), best, 5)
    assert sorted(best) == sorted((int(scores[d, 0]), -d) for d in np.lexsort((np.arange(600), -scores[:, 0]))[:5])
    assert scored < 600


# --- op13 -----------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest string, proof string, kind int"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    return _sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], text)))


def _tree(digests, fan=3):
    """The root, and per leaf its siblings as (before, after) level by level."""
    paths, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, k in zip(paths, where):
            a = k - k % fan
            path.append((digests[a:k], digests[k + 1:a + fan]))
        digests = [_sha("".join(digests[a:a + fan])) for a in range(0, len(digests), fan)]
        where = [k // fan for k in where]
    return digests[0], paths


def _manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = [], {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        root, paths = _tree([_leaf(r, r[1]) for r in groups[s]])
        subs.append(root)
        inner[s] = paths
    root, over = _tree(subs)
    out = []
    for s, sub, up in zip(names, subs, over):
        for r, path in zip(groups[s], inner[s]):
            path = path + up
            seen = r[1]
            if r[0] is not None and seen is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                seen = seen.replace("\n", "")
            fold = _leaf(r, seen)
            for before, after in path:
                fold = _sha("".join(before) + fold + "".join(after))
            proof = _sha("".join(x for before, after in path for x in before + after))
            out.append((r[0], _leaf(r, r[1]), sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


def _manifest_rows(n=400):
    rng = random.Random(4)
    rows = [(k * 3, "".join(rng.choice("ab\né ") for _ in range(rng.randint(0, 40))), rng.choice(["en", None]),
             "hot" if k % 2 else rng.choice(["a", "é", "z", "", None, "b%d" % k]), rng.choice([None, 5, 10 ** 12])) for k in range(n)]
    rows += [rows[3], rows[3], (9, "other\ntext", "en", "hot", 1), (None, "x\n", None, "hot", None), (None, None, None, None, None),
             (5000, "line\n" * 20_000, "en", "long", 100_000), (5001, "", "en", "hot", 0)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_brute_force(spark, levels):
    rows = _manifest_rows()
    docs = spark.createDataFrame([(*r, "t", 1, "d", "p", 0) for r in rows], SCHEMA).repartition(4)
    got = merkle.manifest(docs, tampers=merkle.half_without_newlines(), levels=levels)
    want = _manifest(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


def test_manifest_without_changes_is_verified(spark):
    rows = _manifest_rows(30)
    docs = spark.createDataFrame([(*r, "t", 1, "d", "p", 0) for r in rows], SCHEMA)
    assert merkle.manifest(docs).filter("not verified").count() == 0
    one = merkle.manifest(docs.filter("doc_id = 5000")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == _sha("")
    assert merkle.manifest(docs.limit(0)).count() == 0
