"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations,
isotonic calibration.

Statistics come from the text alone. Training rows (at most ``sample`` labelled documents whose
crc32(doc_id) mod 4 is 0 or 1) give one ``X'X`` and ``X'y`` per partition; the sums are solved once. Rows with
remainder 3 calibrate: scores fall in a fixed number of bins, and pool-adjacent-violators runs over the bins.
Remainder 2 is held out from both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import id_text, scans, word_hashes, word_spans, written

STATS = 26
WAVES = 384
BINS = 2000
LOW, HIGH = -0.5, 1.5
THRESHOLD = 0.7

_rng = np.random.default_rng(77)
_FREQ = _rng.standard_normal((STATS, WAVES)) / np.sqrt(STATS / 2)
_PHASE = _rng.uniform(0, 2 * np.pi, WAVES)


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = [_flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("0123456789"), _flags(".,;:"), _flags("!?"), _flags("|"),
            _flags("<>{}[]()=/\\"), _flags("#*%&$@~^_+"), _flags("\n"), _flags("\"'-"), np.arange(256) >= 128]


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``before``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[before[1:]] - total[before[:-1]]


def _distinct(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct ids per row, and how often the most frequent one occurs."""
    rows = len(before) - 1
    if not len(ids):
        return np.zeros(rows), np.zeros(rows)
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(before))
    key = np.sort((row << np.uint64(42)) | (ids >> np.uint64(22)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    owner = (key[first] >> np.uint64(42)).astype(np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=rows).astype(float), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The ``STATS`` numbers of each text; all finite, for an empty text too."""
    size = np.diff(off).astype(float)
    some = np.maximum(size, 1)
    cols = [np.log1p(size)] + [np.sqrt(_sums(c[data], off) / some) for c in _CLASSES]
    start, end, before = word_spans(data, off)
    ids, _ = word_hashes(data, off)
    words = np.diff(before).astype(float)
    many = np.maximum(words, 1)
    long = (end - start).astype(float)
    distinct, top = _distinct(ids, before)
    pair = np.zeros(len(ids), np.uint64)
    same = np.zeros(len(ids))
    if len(ids) > 1:
        pair[:-1] = ids[:-1] * np.uint64(3) + ids[1:]
        same[1:] = ids[1:] == ids[:-1]
    pairs, top_pair = _distinct(pair, before)
    mean = _sums(long, before) / many
    spread = np.sqrt(np.maximum(_sums(long * long, before) / many - mean ** 2, 0))
    upper = _CLASSES[0]
    capital = upper[data[start]].astype(float) if len(start) else long
    shout = (capital * upper[data[end - 1]] if len(start) else long)
    tail = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    lines = _sums((data == 10).astype(float), off) + 1
    cols += [np.log1p(words), mean, spread, distinct / many, top / many, pairs / many, top_pair / many,
             _sums(same, before) / many, _sums(capital, before) / many, _sums(shout, before) / many,
             _sums((long > 20).astype(float), before) / many, _sums((long <= 2).astype(float), before) / many,
             _sums(_CLASSES[2][tail].astype(float), before) / many, np.log1p(words / lines),
             np.log1p(distinct)]
    return np.nan_to_num(np.stack(cols, axis=1))


def text_statistics(column: pa.Array) -> np.ndarray:
    out = [statistics(data, off) for _, data, off in scans(column)]
    return np.concatenate(out) if out else np.zeros((0, STATS))


def to_stats(batches):
    for batch in batches:
        stats = text_statistics(batch["text"]).astype("<f4")
        yield pa.record_batch([batch["doc_id"], pa.array([s.tobytes() for s in stats], pa.binary())], names=["doc_id", "stats"])


def _stats(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), "<f4").reshape(-1, STATS).astype(float)


def waves(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of the standardised statistics, and a constant."""
    x = np.clip((stats - centre) / scale, -6, 6)
    return np.concatenate((np.sqrt(2 / WAVES) * np.cos(x @ _FREQ + _PHASE), np.ones((len(x), 1))), axis=1)


def _moments(batches):
    total = np.zeros((2, STATS + 1))
    for batch in batches:
        x = _stats(batch["stats"])
        total[0, :STATS] += x.sum(axis=0)
        total[1, :STATS] += (x * x).sum(axis=0)
        total[0, STATS] += len(x)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _normal(centre, scale):
    def run(batches):
        total = np.zeros((WAVES + 1, WAVES + 2))
        for batch in batches:
            x = waves(_stats(batch["stats"]), centre, scale)
            total[:, :-1] += x.T @ x
            total[:, -1] += x.T @ batch["quality"].to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return run


def _total(rows: DataFrame) -> np.ndarray | None:
    """Sum of the packed matrices, first in groups of partitions."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0).tobytes()]})
    some = rows.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(8))).groupBy("g").applyInPandas(add, "sums binary")
    parts = [np.frombuffer(r["sums"]) for r in some.collect()]
    return np.sum(parts, axis=0) if parts else None


def isotonic(count: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over bins: a non-decreasing share of good rows; empty bins are filled between."""
    blocks: list[list[float]] = []  # rows, good, first bin, last bin
    for k in np.flatnonzero(count).tolist():
        blocks.append([count[k], good[k], k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, g, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + g, blocks[-1][2], last]
    if not blocks:
        return np.linspace(0, 1, len(count))
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    return np.interp(np.arange(len(count)), at, np.repeat([b[1] / b[0] for b in blocks], 2))


def fold(doc_id) -> F.Column:
    return F.pmod(F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)), F.lit(4))


def fit(stats: DataFrame, labels: DataFrame, sample: int = 200_000, ridge: float = 1e-3) -> dict | None:
    """The model as a few arrays; null if no usable label. ``sample`` bounds the labelled rows used."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")) \
                  .agg(F.max("quality").cast("double").alias("quality"))
    rows = stats.join(marks, "doc_id").withColumn("fold", fold("doc_id")).filter("fold != 2")
    count = marks.count()
    if count > sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample / count))
    rows = written(rows.select("stats", "quality", "fold"))
    train = rows.filter("fold < 2")
    if train.isEmpty():
        train = rows
    sums = _total(train.select("stats").mapInArrow(_moments, "sums binary"))
    if sums is None or not sums[STATS]:
        return None
    sums = sums.reshape(2, STATS + 1)
    n = sums[0, STATS]
    centre = sums[0, :STATS] / n
    scale = np.sqrt(np.maximum(sums[1, :STATS] / n - centre ** 2, 1e-6))
    both = _total(train.select("stats", "quality").mapInArrow(_normal(centre, scale), "sums binary")).reshape(WAVES + 1, WAVES + 2)
    weight = np.linalg.solve(both[:, :-1] + ridge * n * np.diag([*[1 / WAVES] * WAVES, 1e-9]), both[:, -1])
    model = {"centre": centre, "scale": scale, "weight": weight}
    hold = rows.filter("fold = 3")
    hold = rows if hold.isEmpty() else hold

    def bins(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            at, good = bin_of(raw(_stats(batch["stats"]), model)), batch["quality"].to_numpy(zero_copy_only=False)
            total[0] += np.bincount(at, minlength=BINS)
            total[1] += np.bincount(at, weights=good, minlength=BINS)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    counted = _total(hold.select("stats", "quality").mapInArrow(bins, "sums binary")).reshape(2, BINS)
    return model | {"curve": isotonic(*counted)}


def raw(stats: np.ndarray, model: dict) -> np.ndarray:
    return waves(stats, model["centre"], model["scale"]) @ model["weight"]


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip((score - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def scores(stats: np.ndarray, model: dict | None) -> np.ndarray:
    """Calibrated scores; a thousandth of the uncalibrated order breaks the ties of the steps."""
    if model is None:
        return np.ones(len(stats))
    score = raw(stats, model)
    return 0.999 * model["curve"][bin_of(score)] + 0.001 / (1 + np.exp(-4 * (score - 0.5)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null text is empty and scored like any other; a row without ``doc_id`` is scored and counts as not held
    out; of repeated labels the higher holds, null labels count as none; without any usable label every
    score is 1. Empty tables give no rows; other columns are ignored.
    """
    stats = written(id_text(docs, id_col, text_col).mapInArrow(to_stats, "doc_id long, stats binary"))
    model = fit(stats, labels, **options)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(scores(_stats(batch["stats"]), model))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score ``THRESHOLD`` or more, with all their columns; texts are not shuffled."""
    stats = written(id_text(docs, text_col=text_col).mapInArrow(to_stats, "doc_id long, stats binary"))
    model = fit(stats, labels, **options)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                good = scores(text_statistics(part.column(at).cast(pa.string()).fill_null("")), model) >= THRESHOLD
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
