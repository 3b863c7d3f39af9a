"""Packing token sequences: bounded-space online best fit.

Each partition tokenizes its documents and keeps ``windows`` open windows. A document's whole windows of 2048
ids are emitted as they are; its rest goes to the open window that it fills best. If it fits nowhere,
the fullest window is topped up with the head of the rest (documents may be cut) and emitted. The open windows
that remain, at most ``windows`` per partition, are merged in groups of ``fan`` partitions, level by level; the
last level keeps one window open, and its final rest becomes sequences whose lengths are powers of two.
So no sequence needs padding, and no task holds more than its open windows and one document.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import id_text, written

WINDOW = 2048
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE = ", ".join(f"{c} long" for c in COLUMNS) + ", ids binary, part long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizer file (``.json``): its vocabulary and added tokens run by tiktoken, whose ids are
    the same (tests compare them) at a third of the time. ``.tiktoken`` rank files are read as they are."""
    import public_tokenizers
    import tiktoken

    if path.endswith(".json"):
        import json

        # the fixed byte alphabet of byte-level BPE: printable bytes stand for themselves, others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    else:
        special = {}
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Packer:
    """The open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, level: int, part: int, windows: int):
        self.next = (level << 57) + (part << 32)
        self.part, self.most = part, windows
        self.open: list[list] = []  # [ids so far, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, tokens: int) -> None:
        while len(ids) >= WINDOW:
            self.emit([(doc, start, ids[:WINDOW], tokens)])
            start, ids = start + WINDOW, ids[WINDOW:]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] + len(ids) <= WINDOW]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.most:
            best = [0, []]
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w[0])
            room = WINDOW - best[0]
            self.open.remove(best)
            self.emit([*best[1], (doc, start, ids[:room], tokens)])
            return self.add(doc, start + room, ids[room:], tokens)
        best[0] += len(ids)
        best[1].append((doc, start, ids, tokens))
        if best[0] == WINDOW:
            self.open.remove(best)
            self.emit(best[1])

    def leave(self) -> None:
        """The open windows as rows with their ids, for the next level."""
        for k, (_, pieces) in enumerate(self.open):
            for n, (doc, start, ids, tokens) in enumerate(pieces):
                self.rows.append((doc, start, len(ids), None, tokens, k, n, ids.tobytes(), self.part))
        self.open = []

    def finish(self) -> None:
        """What is open becomes sequences of powers of two."""
        for fill, pieces in self.open:
            while fill:
                room = 1 << (fill.bit_length() - 1)
                fill -= room
                taken = []
                while room:
                    doc, start, ids, tokens = pieces.pop(0)
                    if len(ids) > room:
                        pieces.insert(0, (doc, start + room, ids[room:], tokens))
                        ids = ids[:room]
                    taken.append((doc, start, ids, tokens))
                    room -= len(ids)
                self.emit(taken)
        self.open = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 9
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*COLUMNS, "ids", "part"])


def pack_texts(path: str, end: int, windows: int):
    def run(batches):
        encode = encoder(path)
        packer = Packer(0, TaskContext.get().partitionId(), windows)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.append(encode.encode_to_numpy(text.as_py(), allowed_special="all"), [end]).astype("<u4")
                packer.add(doc, 0, ids, len(ids))
            yield packer.batch()
        packer.leave()
        yield packer.batch()
    return run


def merge_windows(level: int, windows: int, last: bool):
    def run(batches):
        packer = Packer(level, TaskContext.get().partitionId(), windows)
        for batch in batches:
            for row in batch.to_pylist():
                packer.add(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
            yield packer.batch()
        packer.finish() if last else packer.leave()
        yield packer.batch()
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 1, windows: int = 16, fan: int = 16,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone; long texts are cut, repeated rows and rows without
    ``doc_id`` are packed like any other (``doc_id`` null in their pieces). An empty table gives no rows; other
    columns are ignored. Each level's output is written to the shared folder before the next one reads it.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    done = []
    rows = written(id_text(docs, id_col, text_col).mapInArrow(pack_texts(tokenizer, end, windows), PIECE))
    level = 0
    while True:
        level += 1
        done.append(rows.filter("ids is null").select(*COLUMNS))
        left = rows.filter("ids is not null").withColumn("group", F.floor(F.col("part") / fan).cast("int"))
        groups = left.agg(F.max("group")).first()[0]
        if groups is None:
            break
        last = groups == 0
        # sequence_id and offset of a row that is left are its window and its place there
        rows = written(left.repartitionById(groups + 1, F.col("group"))
                       .sortWithinPartitions(F.col("part"), F.col("sequence_id"), F.col("offset")).drop("group")
                       .mapInArrow(merge_windows(level, 1 if last else windows, last), PIECE))
        if last:
            done.append(rows.select(*COLUMNS))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
