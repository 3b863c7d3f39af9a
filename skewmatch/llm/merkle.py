"""Merkle manifest of a data set by time-forward processing.

A node's label is ``(level, place)``, so children have smaller labels than their parent. In the forward sweep a
priority queue ordered by label delivers the digests of children to their parent: the node whose label comes up hashes what
was delivered and sends its digest on. In the reversed sweep labels come down: each node gets the proof of its parent
and sends every child that proof with the child's own siblings in front.

The queue is external: between bands of ``levels`` levels it is Spark's exchange, sorted by label, and in a task it is a heap
over the nodes of one subtree (at most ``fan ** levels`` of them). No task holds more than a subtree, a hot group is as many
subtrees as its size asks for, and the number of exchanges grows with the logarithm of the rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import partitions, written
from skewmatch.operators.ordinal import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for a null, else byte count, colon, value."""
    one = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
           for c in fields]
    return F.sha2(F.concat(*one), 256)


def forward(leaves: list[str], fan: int, height: int) -> list[list[str]]:
    """The digests of every level above ``leaves``, by a queue of messages ``(level, place, digest)``."""
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    queue = [(0, place, digest) for place, digest in enumerate(leaves)]  # in label order: a heap
    run: list[str] = []
    while queue:
        level, place, digest = heapq.heappop(queue)
        levels[level].append(digest)
        if level == height:
            continue
        run.append(digest)
        if place % fan == fan - 1 or not queue or queue[0][0] != level:
            heapq.heappush(queue, (level + 1, place // fan, sha("".join(run))))
            run = []
    return levels


def reverse(levels: list[list[str]], fan: int, top: tuple) -> list[tuple]:
    """Each leaf's proof ``(before, after, rest)``: the siblings on both sides, then the parent's proof; ``top`` is the root's."""
    proofs = [top]
    for digests in reversed(levels[:-1]):
        below = []
        for place in range(len(digests)):
            first = place - place % fan
            below.append(("".join(digests[first:place]), "".join(digests[place + 1:first + fan]), proofs[place // fan]))
        proofs = below
    return proofs


def read_proof(text: str) -> tuple:
    proof: tuple = ()
    for part in reversed(text.split(";")[:-1]):
        before, after = part.split(":")
        proof = (before, after, proof)
    return proof


def write_proof(proof: tuple) -> str:
    parts = []
    while proof:
        parts.append(f"{proof[0]}:{proof[1]};")
        proof = proof[2]
    return "".join(parts)


def folded(digest: str, proof: tuple) -> tuple[str, str]:
    """The root that ``digest`` and its proof give, and the hash over the proof's siblings."""
    siblings = hashlib.sha256()
    while proof:
        before, after, proof = proof
        siblings.update((before + after).encode())
        digest = sha(before + digest + after)
    return digest, siblings.hexdigest()


def height_of(count: int, place: int, fan: int, levels: int) -> int:
    """Levels above a subtree's nodes: all of them unless the subtree is the whole, smaller tree."""
    if place:
        return levels
    height = 0
    while fan ** height < count:
        height += 1
    return height


def _groups(batches, key: list[str]):
    """Runs of rows with equal ``key``, in order, as lists of dicts."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            this = [row[k] for k in key]
            if this != now and rows:
                yield rows
                rows = []
            now = this
            rows.append(row)
    if rows:
        yield rows


def lift(fan: int, levels: int):
    def run(batches):
        out = []
        for rows in _groups(batches, ["tree", "above"]):
            tree, above = rows[0]["tree"], rows[0]["above"]
            top = forward([r["digest"] for r in rows], fan, height_of(len(rows), above, fan, levels))
            out.append((tree, above, top[-1][0]))
        names = ["tree", "place", "digest"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.string(), pa.int64(), pa.string()))],
                              names=names)
    return run


def lower(fan: int, levels: int, leaves: bool, piece: int = 10_000):
    """Per subtree, after the message of its root (``kind`` 0): the proofs of its nodes, or the rows of the manifest."""
    kinds = ([pa.int64()] + [pa.string()] * 5 + [pa.bool_()]) if leaves else [pa.string(), pa.int64()] + [pa.string()] * 3
    names = (["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] if leaves
             else ["tree", "place", "proof", "subroot", "root"])

    def run(batches):
        out = []
        for rows in _groups(batches, ["tree", "above"]):
            if rows[0]["kind"]:
                raise ValueError("a subtree without the message of its root")
            head, nodes = rows[0], rows[1:]
            digests = forward([r["digest"] for r in nodes], fan, height_of(len(nodes), head["above"], fan, levels))
            for row, proof in zip(nodes, reverse(digests, fan, read_proof(head["proof"]))):
                if leaves:
                    _, siblings = folded(row["digest"], proof)
                    again, _ = folded(row["tampered"], proof)
                    out.append((row["doc_id"], row["digest"], head["subroot"], head["root"], siblings, again, again == head["root"]))
                else:
                    out.append((row["tree"], row["place"], write_proof(proof), head["subroot"], head["root"]))
                if len(out) >= piece:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds)], names=names)
    return run


def _by_label(rows: DataFrame, order: list[str]) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "tree", "above").sortWithinPartitions("tree", "above", *order)


def climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """``nodes`` (``tree, place, digest``) and the nodes after each band of levels, up to one per tree."""
    bands = [nodes]
    most = nodes.agg(F.max("place")).first()[0]
    while most:
        up = bands[-1].select("tree", "place", "digest", F.floor(F.col("place") / fan ** levels).alias("above"))
        bands.append(written(_by_label(up, ["place"]).mapInArrow(lift(fan, levels), "tree string, place long, digest string")))
        most //= fan ** levels
    return bands


def descend(band: DataFrame, heads: DataFrame, fan: int, levels: int, leaves: bool) -> DataFrame:
    """The proofs of a band's nodes from those of the band above."""
    extra = ["doc_id", "tampered"] if leaves else []
    nodes = band.select("tree", F.floor(F.col("place") / fan ** levels).alias("above"), F.lit(1).alias("kind"), "place", "digest", *extra,
                        *[F.lit(None).cast("string").alias(c) for c in ("proof", "subroot", "root")])
    messages = heads.select("tree", F.col("place").alias("above"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"),
                            F.lit(None).cast("string").alias("digest"),
                            *[F.lit(None).cast("long" if c == "doc_id" else "string").alias(c) for c in extra], "proof", "subroot", "root")
    schema = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              if leaves else "tree string, place long, proof string, subroot string, root string")
    return _by_label(messages.unionByName(nodes), ["kind", "place"]).mapInArrow(lower(fan, levels, leaves), schema)


def sweep_down(bands: list[DataFrame], heads: DataFrame, fan: int, levels: int, leaves: bool) -> DataFrame:
    """The proofs of the lowest band. A band of one node per tree has its heads as they are."""
    for band in reversed(bands[1:-1]):
        heads = written(descend(band, heads, fan, levels, False))
    if len(bands) > 1 or leaves:
        return descend(bands[0], heads, fan, levels, leaves)
    return heads


def manifest(docs: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             tampers=None, text_col: str = "text", fan: int = 3, levels: int = 7) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    Leaves ascend by id in their group; groups ascend bytewise, null first. ``tampers`` gives, from the text
    column, the text a reader sees (by default the same): its leaf and the original siblings are folded, and ``verified`` says
    if that is the root. A null field is a value of its own; rows without an id come first in their group; rows that
    repeat are leaves of their own (those equal in all fields in any order: their leaves are equal); rows with one
    id are ordered by their leaf. Texts of any length are hashed whole. An empty table gives no rows. Other columns are ignored.
    """
    as_read = {c: F.col(c) for c in fields}
    seen = as_read | ({text_col: tampers(F.col(text_col))} if tampers else {})
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                               F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("tree"),
                               leaf_digest(list(as_read.values())).alias("digest"), leaf_digest(list(seen.values())).alias("tampered")))
    leaves = written(positions(rows, ["tree"], ["doc_id", "digest"], "place"))
    bands = climb(leaves, fan, levels)
    subroots = bands[-1].select(F.lit("").alias("over"), F.col("tree").alias("name"), "digest")
    groups = written(positions(subroots, ["over"], ["name"], "place").select(F.col("over").alias("tree"), "place", "digest", "name"))
    over = climb(groups, fan, levels)
    top = over[-1].select("tree", F.lit(0).cast("long").alias("place"), F.lit("").alias("proof"), F.lit("").alias("subroot"),
                          F.col("digest").alias("root"))
    proofs = sweep_down(over, top, fan, levels, False)
    heads = written(groups.select(F.col("name").alias("_name"), "place", "digest").join(
        proofs.select("place", "proof", "root").hint("merge"), "place").select(
        F.col("_name").alias("tree"), F.lit(0).cast("long").alias("place"), "proof", F.col("digest").alias("subroot"), "root"))
    return sweep_down(bands, heads, fan, levels, True)


def half_without_newlines(id_col: str = "doc_id"):
    """Texts without their newlines where 2 divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 2 == 0
    return lambda text: F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _sql(levels: int = 20, fan: int = 3) -> str:
    """The manifest in SQL, a level at a time, for groups of at most ``fan ** levels`` rows."""
    def h(text: str) -> str:
        one = [f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(one)})"

    def climb(name: str, source: str) -> list[str]:
        """``name_k``: the nodes of level k; ``name_run_k``: the digests of each run of ``fan`` of them."""
        ctes = [f"{name}_0 AS MATERIALIZED (SELECT tree, place, digest FROM {source})"]
        for k in range(levels):
            ctes += [f"""{name}_run_{k} AS MATERIALIZED (SELECT tree, place // {fan} AS above, n, list(digest ORDER BY place) AS run
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_{k}) GROUP BY ALL)""",
                     f"""{name}_{k + 1} AS MATERIALIZED (SELECT tree, above AS place,
  CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}_run_{k})"""]
        return ctes

    def walk(name: str, tree: str, start: str) -> list[str]:
        """``name_k``: every leaf (at ``node`` of level k) with its siblings so far and the digest folded so far."""
        ctes = [f"{name}_0 AS MATERIALIZED ({start})"]
        for k in range(levels):
            left, right = f"run[1:(node % {fan})]", f"run[(node % {fan}) + 2:]"
            ctes.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, source_tree, tree, above AS node,
  CASE WHEN n = 1 THEN proof ELSE proof || array_to_string({left} || {right}, '') END AS proof,
  CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string({left} || [folded] || {right}, '')) END AS folded
  FROM {name}_{k} w JOIN {tree}_run_{k} r USING (tree) WHERE r.above = w.node // {fan})""")
        return ctes

    step = "lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = ("list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
           "lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))")  # its last bit is the inverse of the CRC-32's
    seen = f"CASE WHEN {crc} & 1 = 1 THEN replace(text, chr(10), '') ELSE text END"
    return "WITH " + ",\n".join([
        f"crc AS (SELECT list(list_reduce([x::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], {step}) ORDER BY x) AS codes FROM range(256) t(x))",
        f"d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {h('text')} AS digest, {h(seen)} AS folded FROM documents, crc)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM d)",
        *climb("up", "leaves"),
        f"parts AS MATERIALIZED (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM up_{levels})",
        *climb("over", "parts"),
        *walk("w", "up", "SELECT doc_id, digest AS leaf, tree AS source_tree, tree, place AS node, '' AS proof, folded FROM leaves"),
        *walk("v", "over", "SELECT doc_id, leaf, source_tree, '' AS tree, place AS node, proof, folded "
                           f"FROM w_{levels} JOIN (SELECT name, place FROM parts) ON name = source_tree"),
    ]) + f"""
SELECT doc_id, leaf, p.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM v_{levels} JOIN parts p ON p.name = source_tree, over_{levels} r"""


ORACLE = _sql()
