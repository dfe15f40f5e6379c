"""Quality classifier: a factorisation machine (operator 4).

Inputs of a score are hashed words of the whole text, binned statistics of its structure and its declared length. The
pairwise term sum_{i<j} <v_i, v_j> x_i x_j is computed in linear time as half of (sum v x)^2 - sum (v x)^2.

The model is fitted by Adagrad on a bounded sample of labelled rows (``bound``); scoring reads every row. Cases: a null or
empty text has no words and is scored by its structure bins; a null declared length has a bin of its own; without labelled
rows every score is 0.5; labels of one class only give that class; repeated rows score alike; an empty table gives an empty
result; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, runtime

WORDS, BINS, STATS = 1 << 15, 16, 26
META = 34
SIZE = WORDS + BINS * STATS + META


class _Buckets(dict):
    """Word -> bucket, bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word) & (WORDS - 1)
        return bucket


_buckets = _Buckets()


def _worst_line(lines: list[bytes]) -> tuple[float, float, float, float, float]:
    """Largest shares over lines of five words or more: capitals, marks, repeated words, bars; and the words of the line with most repeats."""
    caps = marks = repeats = bars = size = 0.0
    for line in lines:
        words = line.split()
        n = len(words)
        if n < 5:
            continue
        again = 1 - len(set(words)) / n
        if again > repeats:
            repeats, size = again, n
        letters = line.translate(None, _NOT_LETTERS)
        if letters:
            caps = max(caps, len(letters.translate(None, _LOWER)) / len(letters))
        marks = max(marks, len(line.translate(None, _NOT_MARKS)) / n)
        bars = max(bars, line.count(b"|") / n)
    return caps, marks / 4, repeats, bars, math.log2(size + 1) / 12


_LOWER = bytes(range(97, 123))
_NOT_LETTERS = bytes(x for x in range(256) if not (65 <= x < 91 or 97 <= x < 123))
_NOT_MARKS = bytes(x for x in range(256) if x not in b"!?*$#%&|=~^@_")


def features(text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(words), max(1, len(raw))
    if n:
        run = np.fromiter(map(_buckets.__getitem__, words), np.int64, n)
        ids, reps = np.unique(run, return_counts=True)
    else:
        run, ids, reps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    upper, lower, digit = int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum())
    other, space = int(by[128:].sum()), int(by[9:14].sum() + by[32])
    marks = len(raw) - upper - lower - digit - other - space
    per = max(1, n)
    doubled = sum(raw.count(x) for x in (b"!!", b"??", b"**", b"$$", b"##", b"%%", b"&&", b"||", b"--", b"=="))
    worst = _worst_line(full)
    stats = (
        math.log2(n + 1) / 16,
        math.log2(len(raw) + 1) / 20,
        len(raw) / per / 24,
        upper / max(1, upper + lower),
        (upper + lower + other) / size,
        digit / size * 4,
        marks / size * 4,
        other / size * 2,
        (int(by[33]) + int(by[63])) / per * 2,
        (int(by[42]) + int(by[36]) + int(by[35]) + int(by[37]) + int(by[38])) / per * 2,
        int(by[124]) / per * 2,
        (int(by[46]) + int(by[44])) / per * 2,
        doubled / per,
        len(ids) / per,
        int(reps.max(initial=0)) / per * 2,
        len(full) / per * 4,
        1 - len(set(full)) / max(1, len(full)),
        (int(by[60]) + int(by[62]) + int(by[123]) + int(by[125])) / per * 2,
        (int(by[47]) + int(by[95]) + int(by[64])) / per * 4,
        float(np.sum(reps[reps > 1])) / per,
        float((run[1:] == run[:-1]).sum()) / per * 2,
        *worst,
    )
    at = [WORDS + k * BINS + min(BINS - 1, int(max(0.0, s) * BINS)) for k, s in enumerate(stats)]
    at.append(WORDS + STATS * BINS + (META - 1 if declared is None or declared < 0 else min(META - 2, int(declared).bit_length())))
    value = np.concatenate([np.full(len(ids), 1 / math.sqrt(max(1, len(ids)))), np.full(len(at), 0.3)])
    return np.concatenate([ids, np.array(at, np.int64)]), value


class Machine:
    """w0 + <w, x> + half of sum_f (sum v_f x)^2 - sum (v_f x)^2, through the logistic function."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(axis=0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.raw(idx, val)))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], rank: int = 8, updates: int = 1000, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Adagrad on the logistic loss of (label, indexes, values) rows; deterministic for a given order of rows.

    At least ``updates`` steps are taken, or eight passes."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank))
    y = np.array([r[0] for r in rows], float)
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    w0 = math.log(share / (1 - share))
    if not len(y):
        return Machine(0.0, w, v * 0)
    if y.min() == y.max():
        return Machine(w0, w, v * 0)
    gw, gv, g0 = np.full(SIZE, 1e-2), np.full((SIZE, rank), 1e-2), 1e-2
    for _ in range(max(8, -(-updates * batch // (len(rows) + batch)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            idx = np.concatenate([rows[i][1] for i in part])
            val = np.concatenate([rows[i][2] for i in part])
            lens = np.array([len(rows[i][1]) for i in part])
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            row = np.repeat(np.arange(len(part)), lens)
            vx = v[idx] * val[:, None]
            s = np.add.reduceat(vx, first)
            out = w0 + np.add.reduceat(w[idx] * val, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
            u, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, g[row] * val, len(u)) + decay * w[u]
            each = (g[row] * val)[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(inverse, each[:, f], len(u)) for f in range(rank)], 1) + decay * v[u]
            d0 = g.sum()
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += d0 * d0
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
            w0 -= rate * d0 / math.sqrt(g0)
    return Machine(w0, w, v)


def _inputs(docs: DataFrame, text_col: str, length_col: str | None) -> list:
    declared = F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")
    return [F.col(text_col).cast("string").alias("__text"), declared.alias("__declared")]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, bound: int = 8000, text_col: str = "text", length_col: str | None = "n_chars", **how) -> Machine:
    """A machine fitted on at most ``bound`` labelled rows outside the held-out fold."""
    runtime.ship(docs.sparkSession)
    rows = labelled.sample(docs.select("doc_id", *_inputs(docs, text_col, length_col)), labels, label, folds, held_out, bound, ["__text", "__declared"])
    rows = rows.repartition(runtime.partitions(docs.sparkSession))  # whole texts become features in as many tasks as there are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, d) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            packed = [pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())]
            yield pa.record_batch([b.column(0), *packed], names=["y", "idx", "val"])

    got = sorted(rows.mapInArrow(run, "y int, idx binary, val binary").collect(), key=lambda r: (bytes(r.idx), bytes(r.val), r.y))  # an order of their own
    unpacked = sorted(((r.y, bytes(r.idx), bytes(r.val)) for r in got), key=lambda r: (zlib.crc32(r[1]), r))
    return train([(y, np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for y, i, x in unpacked], **how)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """(doc_id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for b in batches:
            s = [m.score(*features(t.as_py(), d.as_py())) for t, d in zip(b.column(1), b.column(2), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *_inputs(docs, text_col, length_col))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Rows of ``docs`` that score at least the threshold, with all of their columns."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    runtime.ship(docs.sparkSession)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        for b in batches:
            good = [m.score(*features(t.as_py(), d.as_py())) >= threshold for t, d in zip(b.column(width), b.column(width + 1), strict=True)]
            yield b.select(list(range(width))).filter(pa.array(good, pa.bool_()))

    return docs.select("*", *_inputs(docs, text_col, length_col)).mapInArrow(run, docs.schema)


