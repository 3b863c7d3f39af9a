"""Language-model scores from Brown classes: exchange clustering, class transitions, word emissions.

1. Tokens are counted in blocks (one per stretch of an input partition) with local word numbers.
2. Frequent words, those with at least ``share`` of all training tokens (so at most 1/``share`` of them at any
   size), are clustered: sweeps over the blocks sum, for each frequent word, the classes on its left and right (rarer words
   are one class, ends another); each sweep moves a word to the class in which the class bigrams are
   likeliest, its own counts taken out of its class (words take turns, half of them in a sweep). The sweeps end when the
   mutual information of neighbouring classes has not risen for either half; the best classes stay.
3. Every other word is exchanged once, over the whole corpus: each training occurrence votes for the class that is
   likeliest between its neighbours, and the word joins the class with most votes (smallest number on a tie).
4. With all words classed, transitions and class sizes are counted over the training tokens.

P(word | previous) = P(class | class of the last known word) * P(word | class). Transitions are smoothed towards the
class shares, emissions are discounted, and the discounts are the mass of the unknown word (one type, as in
the base score). An unknown word leaves the class context as it is; the end token starts the next text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import id_text, scans, word_hashes, written

CLASSES = 64  # 0 is the end of a text, the last one is for words not placed yet
END = 0x1F3D5B79A1C2E3F4  # the end token's number
BLOCK_TOKENS = 2_500_000
PIECE = 1 << 18  # tokens of a block that are worked on at once
DISCOUNT = 0.75
#: A row group for every block: a reader holds a whole row group, and blocks are large.
ROW_GROUP = {"parquet.block.row.count.limit": 1}
RISE = 1e-3  # a sweep that raises the mutual information by a smaller share counts as idle


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix as a binary value, without a copy."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def to_blocks(limit: int):
    """Documents in blocks of about ``limit`` tokens (a longer one alone): ``(block, doc ids, held, sizes, tokens, vocabulary,
    training counts)``; a token is its word's place in the sorted vocabulary of the block."""
    def close(number, docs, held, sizes, words):
        vocabulary = np.unique(np.concatenate([np.unique(w) for w in words]))
        train = np.repeat(~np.array(held, bool), sizes)
        tokens, counts, at = np.empty(len(train), "<i4"), np.zeros(len(vocabulary), "<i8"), 0
        words.reverse()
        while words:  # each piece is let go as soon as it is numbered
            some = np.searchsorted(vocabulary, words.pop())
            counts += np.bincount(some[train[at:at + len(some)]], minlength=len(vocabulary))
            tokens[at:at + len(some)] = some
            at += len(some)
        return pa.record_batch([
            pa.array([number]), pa.array([docs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
            pa.array([sizes], pa.list_(pa.int64())), blobs(tokens[None]), blobs(vocabulary[None]), blobs(counts[None])],
            names=["block", "docs", "held", "sizes", "tokens", "vocabulary", "counts"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        docs, held, sizes, words, total = [], [], [], [], 0
        for batch in batches:
            ids, out = batch["doc_id"].to_pylist(), batch["held"].to_pylist()
            for first, data, off in scans(batch["text"]):
                found, before = word_hashes(data, off)
                size = np.diff(before)
                words.append(np.insert(found, before[1:], np.uint64(END)))
                docs += ids[first:first + len(size)]
                held += out[first:first + len(size)]
                sizes += (size + 1).tolist()
                total += len(found) + len(size)
                if total >= limit:
                    yield close(number, docs, held, sizes, words)
                    number += 1
                    docs, held, sizes, words, total = [], [], [], [], 0
        if docs:
            yield close(number, docs, held, sizes, words)
    return run


BLOCK = "block long, docs array<long>, held array<boolean>, sizes array<long>, tokens binary, vocabulary binary, counts binary"


class Block:
    def __init__(self, row: dict):
        """Columns that a step has no use for may be left out."""
        self.number = row.get("block")
        self.docs = row.get("docs")
        self.held = np.array(row.get("held", ()), bool)
        self.sizes = np.array(row.get("sizes", ()), np.int64)
        self.tokens, self.vocabulary, self.counts = (np.frombuffer(row.get(c, b""), t) for c, t in (("tokens", "<i4"), ("vocabulary", "<u8"), ("counts", "<i8")))

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def blocks_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            yield Block({c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c, x in row.items()})


def local_counts(batches):
    for b in blocks_of(batches):
        some = b.counts > 0
        yield pa.record_batch([pa.array(b.vocabulary[some].view("<i8")), pa.array(b.counts[some])], names=["word", "n"])


def place(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted ``words``, -1 if it is none of them."""
    at = np.searchsorted(words, vocabulary)
    at[at == len(words)] = 0
    return (np.where(words[at] == vocabulary, at, -1) if len(words) else np.full(len(vocabulary), -1)).astype(np.int32)


def token_classes(b: Block, words: np.ndarray, classes: np.ndarray):
    """Of a block's training tokens, ``PIECE`` at a time: their places in its vocabulary and in ``words``, and their class and those on
    the left and right, in small types (a block has millions of tokens)."""
    train = b.train()
    where = place(b.vocabulary, words)
    small = np.append(classes, CLASSES - 1).astype(np.uint8)  # -1: a word not placed yet
    cls = np.zeros(int(train.sum()) + 2, np.uint8)  # between two edges
    cls[1:-1] = small[where].take(b.tokens)[train]
    at = 0
    for low in range(0, len(train), PIECE):
        tokens = b.tokens[low:low + PIECE][train[low:low + PIECE]]
        high = at + len(tokens)
        yield tokens, where[tokens], cls[at + 1:high + 1], cls[at:high], cls[at + 2:high + 2]
        at = high


def neighbour_classes(words: np.ndarray, classes: np.ndarray):
    """Per task and frequent word: how often each class stands on its left and on its right (training tokens)."""
    def run(batches):
        total = np.zeros((len(words), 2 * CLASSES), np.int64)
        for b in blocks_of(batches):
            for _, word, _, left, right in token_classes(b, words, classes):
                known = word >= 0
                row = word[known].astype(np.int64) * (2 * CLASSES)
                np.add.at(total.reshape(-1), row + left[known], 1)
                np.add.at(total.reshape(-1), row + right[known] + CLASSES, 1)
        some = np.flatnonzero(total.any(axis=1))
        for low in range(0, len(some), 1 << 12):
            part = some[low:low + (1 << 12)]
            yield pa.record_batch([pa.array(part.astype(np.int32)), blobs(total[part].astype("<i8"))], names=["word", "sums"])
    return run


def add_sums(batches):
    """Rows sorted by word: one row per word with the summed vectors."""
    word, total = None, None
    for batch in batches:
        for k, sums in zip(batch["word"].to_pylist(), batch["sums"].to_pylist()):
            row = np.frombuffer(sums, "<i8")
            if k == word:
                total = total + row
            else:
                if word is not None:
                    yield _sum_row(word, total)
                word, total = k, row
    if word is not None:
        yield _sum_row(word, total)


def _sum_row(word, total):
    return pa.record_batch([pa.array([word], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["word", "sums"])


def class_sums(near: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``into[c, x]``: tokens of class x before a word of class c; ``out[c, x]``: those after one."""
    into, out = np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES))
    np.add.at(into, classes, near[:, :CLASSES])
    np.add.at(out, classes, near[:, CLASSES:])
    return into, out


def information(near: np.ndarray, classes: np.ndarray) -> float:
    """Mutual information of a frequent word's class and the next token's, in nats a token: what the exchange raises."""
    _, out = class_sums(near, classes)
    total = max(1.0, out.sum())
    free = np.outer(out.sum(axis=1), out.sum(axis=0)) / total
    some = out > 0
    return float((out[some] * np.log(out[some] / free[some])).sum() / total)


def exchanged(near: np.ndarray, classes: np.ndarray, turn: int) -> np.ndarray:
    """One sweep of moves: each word whose turn it is takes the class that raises the class-bigram
    log-likelihood most, all other words as they are; its own class is judged without the word."""
    left, right = near[:, :CLASSES].astype(float), near[:, CLASSES:].astype(float)
    n = left.sum(axis=1)
    into, out = class_sums(near, classes)
    size = np.bincount(classes, weights=n, minlength=CLASSES)
    log = lambda x: np.log(x + 0.1)
    # gain of a word per class: its neighbours under the class's own neighbour shares
    gain = left @ (log(into) - log(size)[:, None]).T + right @ (log(out) - log(size)[:, None]).T
    alone = log(size[classes] - n)[:, None]
    gain[np.arange(len(classes)), classes] = (left * (log(into[classes] - left) - alone)).sum(axis=1) + (
        right * (log(out[classes] - right) - alone)).sum(axis=1)
    gain[:, size == 0] = -np.inf  # an empty class stays empty, and a class's only word stays in it
    gain[:, [0, CLASSES - 1]] = -np.inf
    new = gain.argmax(axis=1)
    mine = (np.arange(len(classes)) * 2654435761 >> 7) % 2 == turn % 2
    keep = ~mine | (n == 0) | (classes == 0)
    return np.where(keep, classes, new)


def votes(words: np.ndarray, classes: np.ndarray, between: np.ndarray):
    """Per block: every word with its training count and the class that most of its occurrences vote for.
    Frequent words vote for their own class. ``between[a, b]`` is the likeliest class from a to b."""
    likeliest = between.astype(np.uint8)

    def run(batches):
        for b in blocks_of(batches):
            key, at = np.empty(int(b.train().sum()), np.int32 if len(b.vocabulary) * CLASSES < 1 << 31 else np.int64), 0
            for tokens, word, cls, left, right in token_classes(b, words, classes):
                cast = np.where(word >= 0, cls, likeliest[left, right])
                key[at:at + len(tokens)] = tokens * key.dtype.type(CLASSES) + cast
                at += len(tokens)
            key.sort()
            start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            n = np.diff(np.append(start, len(key)))
            voter, choice = key[start] // CLASSES, key[start] % CLASSES
            silent = np.flatnonzero(b.counts == 0)
            ids = np.concatenate((b.vocabulary[voter], b.vocabulary[silent])).view("<i8")
            yield pa.record_batch([
                pa.array(ids), pa.array(np.full(len(ids), b.number)),
                pa.array(np.concatenate((choice, np.zeros(len(silent), np.int64))).astype(np.int8)),
                pa.array(np.concatenate((n, np.zeros(len(silent), np.int64))))], names=["word", "block", "cls", "n"])
    return run


def elect(batches):
    """Rows sorted by word: each (word, block) once, with the word's class and count over all blocks, and whether this is the
    word's first row. Holds one batch and one word's rows (one per block and class at most)."""
    held = None
    for batch in batches:
        rows = [batch[c].to_numpy() for c in ("word", "block", "cls", "n")]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [r[cut:] for r in rows]
        if cut:
            yield _elected([r[:cut] for r in rows])
    if held is not None:
        yield _elected(held)


def _elected(rows):
    word, block, cls, n = rows
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    group = np.cumsum(np.concatenate(([0], word[1:] != word[:-1])))
    count = np.add.reduceat(n, start)
    tally = np.zeros((len(start), CLASSES), np.int64) if len(start) * CLASSES <= 1 << 24 else None
    if tally is None:
        key, inverse = np.unique(group * CLASSES + cls, return_inverse=True)
        total = np.bincount(inverse, weights=n)
        order = np.lexsort((-(key % CLASSES), total, key // CLASSES))
        best = np.zeros(len(start), np.int64)
        best[(key // CLASSES)[order]] = (key % CLASSES)[order]
    else:
        np.add.at(tally, (group, cls), n)
        best = tally.argmax(axis=1)
    pair = np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])))
    first = np.zeros(len(word), bool)
    first[start] = True
    return pa.record_batch([pa.array(block[pair]), pa.array(word[pair]), pa.array(best[group][pair].astype(np.int8)),
                            pa.array(count[group][pair]), pa.array((first & (count[group] > 0))[pair])],
                           names=["block", "word", "cls", "count", "first"])


def classed(all_tokens: int, types: int):
    """A block with the class and count of its words: per document what its score needs."""
    base = np.log10(all_tokens + types + 1.0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in ("doc_id", "held", "n_tokens", "n_known", "base_score", "emit", "classes")})
        b = Block(left.iloc[0].to_dict())
        order = np.argsort(right["word"].to_numpy().view("u8"))
        cls = right["cls"].to_numpy()[order]
        count = right["count"].to_numpy()[order]
        tokens = b.tokens
        known = count > 0
        code = np.where(known, cls, 255).astype(np.uint8)[tokens]
        ends = np.cumsum(b.sizes)
        cuts = np.concatenate(([0], np.searchsorted(ends, np.arange(PIECE, len(tokens), PIECE)), [len(ends)]))  # whole documents, about PIECE tokens

        def sums(of_word):
            parts = [np.zeros(0)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low < high:  # no document is without its end token
                    first = ends[low:high] - b.sizes[low:high]
                    parts.append(np.add.reduceat(of_word[tokens[first[0]:ends[high - 1]]], first - first[0]))
            return np.concatenate(parts)

        plain = np.log10(count + 1.0) - base
        emit = np.where(known, np.log10(np.maximum(count - DISCOUNT, 1e-9)), 0.0)
        return pd.DataFrame({
            "doc_id": pd.array(b.docs, dtype="Int64"), "held": b.held, "n_tokens": b.sizes,
            "n_known": sums(known.astype(float)).round().astype(np.int64), "base_score": sums(plain),
            "emit": sums(emit), "classes": [c.tobytes() for c in np.split(code, ends[:-1])]})
    return run


def transitions(batches):
    """Counts of (class context, class) over the training documents."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for held, codes in zip(batch["held"].to_pylist(), batch["classes"].to_pylist()):
            if not held:
                code = np.frombuffer(codes, np.uint8)
                total += np.bincount(context(code).astype(np.int64) * CLASSES + code, minlength=len(total))
    cell = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])


def context(code: np.ndarray) -> np.ndarray:
    """The class of the last known word before each token (the end class at the start of a text)."""
    at = np.where(code != 255, np.arange(1, len(code) + 1), 0)
    last = np.maximum.accumulate(np.concatenate(([0], at[:-1])))
    return np.where(last > 0, code[last - 1], 0).astype(np.uint8)


def score_rows(log_step: np.ndarray, log_size: np.ndarray, log_unknown: np.ndarray):
    def run(batches):
        for batch in batches:
            out = []
            for emit, codes in zip(batch["emit"].to_pylist(), batch["classes"].to_pylist()):
                code = np.frombuffer(codes, np.uint8)
                before, known = context(code), code != 255
                out.append(emit + log_step[before[known], code[known]].sum() - log_size[code[known]].sum()
                           + log_unknown[before[~known]].sum())
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "held", "n_tokens", "n_known", "base_score")),
                                   pa.array(out, pa.float64())],
                                  names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def likelihoods(counts: np.ndarray, types: np.ndarray):
    """Log10 tables from the transition counts and the number of word types of each class."""
    size = counts.sum(axis=0).astype(float)
    total = max(1.0, size.sum())
    prior = (size + 0.5) / (total + 0.5 * CLASSES)
    step = (counts + 50.0 * prior) / (counts.sum(axis=1, keepdims=True) + 50.0)
    # the discounts of a class are its share of the unknown word; never nothing
    spare = np.clip((DISCOUNT * types + 1e-3) / np.maximum(size, 1.0), 1e-9, 0.9)
    return np.log10(step), np.log10(np.maximum(size, 1.0)), np.log10(step @ spare)


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 2e-5, sweeps: int = 24,
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is its end token alone; a row without ``doc_id`` trains and is scored; repeated rows
    count each; an empty table, or one without training rows, gives finite scores for whatever rows it has; other
    columns are ignored. A text of any length is scored whole; words that tie for a class take the one with the smallest number. There are
    at most ``sweeps`` sweeps. At most 1/``share`` words, their class vectors and one class matrix reach the driver.
    """
    spark = docs.sparkSession
    blocks = written(id_text(docs, id_col, text_col).withColumn("held", held_out("doc_id"))
                     .mapInArrow(to_blocks(block_tokens), BLOCK), **ROW_GROUP)
    plain = blocks.select("vocabulary", "held", "sizes", "tokens")
    totals = blocks.select("vocabulary", "counts").mapInArrow(local_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    totals = written(totals)
    tokens, types = (int(x or 0) for x in totals.agg(F.sum("n"), F.count(F.lit(1))).first())
    frequent = totals.filter(F.col("n") >= max(1.0, share * tokens)).collect() if tokens else []
    frequent = sorted((np.int64(r["word"]).view(np.uint64), r["n"]) for r in frequent)
    words = np.array([w for w, _ in frequent], np.uint64)
    rank = np.argsort(np.argsort([-n for _, n in frequent], kind="stable"), kind="stable") if frequent else np.zeros(0, np.int64)
    classes = 1 + rank % (CLASSES - 2)
    classes[words == np.uint64(END)] = 0

    near, best, most, idle = np.zeros((len(words), 2 * CLASSES), np.int64), (classes, None), -1.0, 0
    for turn in range(sweeps if frequent else 0):
        summed = (plain.mapInArrow(neighbour_classes(words, classes), "word int, sums binary")
                       .repartition("word").sortWithinPartitions("word").mapInArrow(add_sums, "word int, sums binary"))
        for row in summed.collect():  # one vector per frequent word
            near[row["word"]] = np.frombuffer(row["sums"], "<i8")
        now = information(near, classes)
        idle = 0 if now > most * (1 + RISE) else idle + 1
        if now > most:
            best, most = (classes, near.copy()), now
        if idle == 2:
            break
        classes = exchanged(near, classes, turn)
    classes, near = best[0], near if best[1] is None else best[1]
    to, step = class_sums(near, classes)
    size = np.maximum(1.0, step.sum(axis=1))
    # the class c between a and b: P(c | a) P(b | c), from the neighbours of the classed words
    enter, leave = np.log((to.T + 0.5) / (size + 0.5 * CLASSES)), np.log((step + 0.5) / (size + 0.5 * CLASSES)[:, None])
    odds = (enter + np.log(size))[:, :, None] + leave[None, :, :]
    odds[:, [0, CLASSES - 1], :] = -np.inf
    between = odds.argmax(axis=1)

    told = (blocks.select("block", "vocabulary", "counts", "held", "sizes", "tokens").mapInArrow(votes(words, classes, between), "word long, block long, cls byte, n long")
                 .repartition("word").sortWithinPartitions("word", "block").mapInArrow(
                     elect, "block long, word long, cls byte, count long, first boolean"))
    told = written(told)
    kinds = {r["cls"]: r["n"] for r in told.filter("first").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_doc = written(blocks.groupBy("block").cogroup(told.select("block", "word", "cls", "count").groupBy("block")).applyInPandas(
        classed(tokens, types), "doc_id long, held boolean, n_tokens long, n_known long, base_score double, emit double, classes binary"))
    counts = np.zeros(CLASSES * CLASSES)
    for row in (per_doc.select("held", "classes").mapInArrow(transitions, "cell int, n long")
                       .groupBy("cell").agg(F.sum("n").alias("n")).collect()):
        counts[row["cell"]] = row["n"]
    tables = likelihoods(counts.reshape(CLASSES, CLASSES), np.array([kinds.get(c, 0) for c in range(CLASSES)], float))
    out = per_doc.mapInArrow(score_rows(*tables), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
