"""Toxicity after noisy-channel deobfuscation (operator 2).

A character trigram model is counted over the words of all documents. Tokens that show leetspeak, spacing, separators or
repeated letters become lattices: each symbol may stand for the letters it imitates, for nothing or for a word break, a
run of one letter may stand for one or two of them, and single characters in a row may be one word. Viterbi decoding
under the character model restores the likeliest spelling; everything else passes as it is. A logistic model then scores
the restored words by word, prefix, suffix and inner n-gram features chosen on a bounded sample of labelled rows.

Cases: a null or empty text has no feature and gets the bias, below 0.5 unless most labelled rows are toxic; without
labelled rows of both classes every score is the smoothed share of toxic rows; very long texts and tokens are read whole;
repeated rows score alike; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, runtime

# Letters that digits and symbols imitate.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(".-_*~'`·^=/\\,:;#%&")
EDGES = ".,;:!?\"'()[]{}<>«»“”…"
SYMBOLS = set("@$!+€£|")  # those that stand for letters at a token's edge as well; brackets there are brackets
SUB, DROP, SEP, BREAK, ONE, TWO = 0.7, 3.0, 0.2, 2.0, 0.3, 0.6
EDGE, GAP = 0.5, 0.5  # cost of a symbol at a token's edge that means nothing, and of a word break between spaced letters
HASH, MOST = 1 << 18, 3


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ^word$ strings in a row, and where each begins."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return flat, np.cumsum([0, *[len(w) + 2 for w in words]])


def _slot(*codes):
    h = np.uint64(0)
    for c in codes:
        h = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c) + np.uint64(1)) if np.isscalar(c) else h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)
    return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)


def ngram_counts(counts: Counter) -> np.ndarray:
    """Counts of hashed character 1-, 2- and 3-grams of words, in one table of HASH slots."""
    table = np.zeros(HASH)
    words = list(counts)
    for k in range(0, len(words), 50_000):
        part = words[k : k + 50_000]
        with np.errstate(over="ignore"):
            flat, first = _codes(part)
            weight = np.repeat([counts[w] for w in part], np.diff(first)).astype(float)
            inside = np.ones(len(flat), bool)
            for n in (1, 2, 3):
                if n > 1:
                    ends = first[1:] - (n - 1)
                    inside[ends[ends >= first[:-1]]] = False
                grams = [flat[i : len(flat) - n + 1 + i] for i in range(n)]
                ok = inside[: len(flat) - n + 1]
                table += np.bincount(_slot(np.full(ok.sum(), n, np.uint64), *[g[ok] for g in grams]).astype(np.int64), weight[: len(ok)][ok], HASH)
    return table


class CharModel:
    """Interpolated character trigrams from a table of hashed counts."""

    def __init__(self, table: np.ndarray):
        self.table, self.total, self.cache = table, max(1.0, float(table.sum()) / 3), {}

    def _n(self, s: str) -> float:
        with np.errstate(over="ignore"):
            return float(self.table[int(_slot(np.uint64(len(s)), *[np.uint64(ord(c)) for c in s]))])

    def logp(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if key not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            one = (self._n(c) + 0.5) / (self.total + 500)
            nb = self._n(b)
            two = (self._n(b + c) + 4 * one) / (nb + 4)
            nab = self._n(a + b)
            self.cache[key] = math.log((self._n(key) + 4 * two) / (nab + 4))
        return self.cache[key]


_ODD = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
_PAIR = re.compile(r"(.)\1")
_JUNK = re.compile(r"[*$#%&!?=~_+|.-]{2,}$|^[*$#%&!?=~_+|.-]{2,}")


def suspicious(token: str) -> bool:
    """Tokens that get a lattice: letters mixed with digits or symbols, a letter three times in a row, or three doublings."""
    if token.isalpha():
        return _RUN.search(token) is not None or sum(1 for _ in _PAIR.finditer(token)) >= 3
    return _ODD.search(token) is not None and (any(c in LEET or c in SEPARATORS for c in token) or _RUN.search(token) is not None)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Alternatives (emitted string, cost) for each run of one character of a token.

    Symbols at the edges of a token are cheap to drop, as most close a sentence. In a spaced run every place between two
    letters may be a word break, also inside a doubled letter, and a blank is one.
    """
    out: list[list[tuple[str, float]]] = []
    marks = "".join(SYMBOLS)
    inner = (len(token) - len(token.lstrip(marks)), len(token.rstrip(marks)))
    letterless = all(c in LEET for c in token)  # nothing would be left if its symbols could be dropped
    for m in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = m[1], len(m[0])
        if spaced and c == " ":
            out.append([("\x03", 0.0)])
            continue
        if c in LEET:
            letters = LEET[c]
            edge = not spaced and c in SYMBOLS and (m.start() < inner[0] or m.start() >= inner[1])
            alts = [(x, SUB) for x in letters] + ([] if letterless else [("", EDGE if edge else DROP + 6.0 * c.isdigit())])
            if n > 1:
                alts += [(x + x, SUB + TWO) for x in letters]
            if c.isdigit():
                alts.append((c * n, 0.0))
        elif c in SEPARATORS:
            alts = [("", SEP), ("\x03", BREAK)]
        elif n == 1 or c.isdigit():
            alts = [(c * n, 0.0)]
        elif n == 2 and not spaced:
            alts = [(c + c, 0.0), (c, 2.0)]
        else:
            alts = [(c, ONE), (c + c, TWO)]
        if spaced:
            if n > 1:
                alts += [(f"{x}\x03{x}", TWO + GAP) for x in (LEET.get(c, c) if c not in SEPARATORS else "")]
            if out and out[-1] != [("\x03", 0.0)]:
                out.append([("", 0.0), ("\x03", GAP)])
        out.append(alts)
    return out


def decode(slots: list[list[tuple[str, float]]], lm: CharModel) -> str:
    """The cheapest path through a lattice, by Viterbi over the last two characters; \\x03 is a word break."""
    beam: dict[tuple[str, str], tuple[float, tuple | None]] = {("\x02", "\x02"): (0.0, None)}
    # the model knows words as ^word$: a word's first letter is predicted from its start mark alone

    def push(state, cost, back, text):
        a, b = state
        for c in text:
            if c == "\x03":
                if b == "\x02":
                    continue
                cost -= lm.logp(a, b, "\x03")
                a, b = "\x02", "\x02"
            else:
                cost -= lm.logp("", b, c) if b == "\x02" else lm.logp(a, b, c)
                a, b = b, c
        return (a, b), (cost, (back, text) if text else back)

    for alts in slots:
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for state, (cost, back) in beam.items():
            for text, price in alts:
                to, entry = push(state, cost + price, back, text)
                if to not in new or entry[0] < new[to][0]:
                    new[to] = entry
        beam = new
    ended = [push(s, c, b, "\x03")[1] for s, (c, b) in beam.items()]
    _, back = min(ended, key=lambda x: x[0])
    parts = []
    while back is not None:
        back, text = back
        parts.append(text)
    return "".join(reversed(parts)).strip("\x03")


_OUTER = "".join(c for c in EDGES if c not in SYMBOLS)


def restore_token(token: str, lm: CharModel) -> list[str]:
    """Restored words of one lower-case token. A token of digits alone is a number and stays one."""
    core = _JUNK.sub("", token.strip(EDGES)).strip(EDGES) or token
    whole = token.strip(_OUTER)
    if whole != core and not SYMBOLS.isdisjoint(whole) and (_ODD.search(whole) or len(whole) > 2 and all(c in LEET for c in whole)):
        core = whole  # symbols at an edge may stand for letters: the lattice holds both readings
    elif not suspicious(core):
        return [core]
    return [w for w in decode(lattice(core), lm).split("\x03") if w] or [core]


_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S))+")


def spaced_runs(text: str, words: list[str], least: int = 3) -> list[str]:
    """Runs of at least ``least`` single characters, not all the same, without the white space between them.

    Where some gaps of a run are wider than others, the wider ones are word breaks and stay as a blank.
    """
    one = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if one.sum() < least or not (one[: len(one) - least + 1] & one[1 : len(one) - least + 2] & one[least - 1 :]).any():
        return []
    out = []
    for m in _SINGLES.finditer(text):
        run = m[0]
        letters = run.split()
        if len(letters) < least or len(set(letters)) < 2:
            continue
        wide = re.split(r"\s{2,}", run)
        out.append(" ".join("".join(x.split()) for x in wide) if 1 < len(wide) < len(letters) else "".join(letters))
    return out


def restored(text: str | None, lm: CharModel) -> list[str]:
    """Words of a text after deobfuscation; words that were spaced out are joined after the others."""
    text = (text or "").lower()
    words = text.split()
    out = [w for t in words for w in restore_token(t, lm)]
    for run in spaced_runs(text, words):
        out += [w for w in decode(lattice(run, spaced=True), lm).split("\x03") if w]
    return out


def keys(word: str) -> list[str]:
    """Feature names of a word."""
    n = len(word)
    out = [f"={word}"]
    out += [f"^{word[:k]}" for k in range(3, min(8, n))]
    out += [f"{word[-k:]}$" for k in range(4, min(7, n))]
    out += [word[k : k + 5] for k in range(1, n - 5)]
    return out


class Restorer:
    """Word -> indexes of chosen features, with a bounded cache in front of decoding."""

    def __init__(self, lm: CharModel, chosen: dict[str, int]):
        self.lm, self.chosen, self.cache = lm, chosen, {}

    def _of(self, words: list[str]) -> tuple[int, ...]:
        return tuple({self.chosen[k] for w in words for k in keys(w) if k in self.chosen})

    def features(self, text: str | None) -> dict[int, int]:
        """Feature -> number of distinct tokens that show it, three at most."""
        text = (text or "").lower()
        words = text.split()
        found: dict[int, int] = {}
        cache = self.cache
        if len(cache) > 150_000:
            cache.clear()
        for w in set(words):
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = self._of(restore_token(w, self.lm))
            for k in hit:
                found[k] = found.get(k, 0) + 1
        for run in spaced_runs(text, words):
            for k in self._of([w for w in decode(lattice(run, spaced=True), self.lm).split("\x03") if w]):
                found[k] = found.get(k, 0) + 1
        return {k: min(n, MOST) for k, n in found.items()}


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The character model's table, counted over all documents; what comes to the driver is at most HASH rows."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = np.zeros(HASH), Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    words.update(t.as_py().lower().split())
                    if len(words) > 400_000:
                        table += ngram_counts(words)
                        words = Counter()
        table += ngram_counts(words)
        at = np.flatnonzero(table)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(table[at].astype(np.int64))], names=["slot", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slot int, n long")
    table = np.zeros(HASH)
    got = rows.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return table


class Model:
    def __init__(self, table: np.ndarray, chosen: dict[str, int], weights: np.ndarray, bias: float):
        self.table, self.chosen, self.weights, self.bias = table, chosen, weights, bias

    def score(self, found: dict[int, int]) -> float:
        z = self.bias + sum(self.weights[k] * n for k, n in found.items())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(rows: list[dict[int, int]], y: np.ndarray, size: int, bias: float, epochs: int = 400, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Full-batch Adagrad over sparse rows."""
    idx = np.array([k for r in rows for k in r], np.int64)
    val = np.array([n for r in rows for n in r.values()], float)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, gw, g0 = np.zeros(size), np.full(size, 1e-6), 1e-6
    for _ in range(epochs):
        z = bias + np.bincount(row, w[idx] * val, len(rows))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        dw = np.bincount(idx, g[row] * val, size) + l2 * w
        d0 = g.sum()
        gw += dw * dw
        g0 += d0 * d0
        w -= 0.5 * dw / np.sqrt(gw)
        bias -= 0.5 * d0 / math.sqrt(g0)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, bound: int = 12_000, text_col: str = "text", candidates: int = 3000, most: int = 300) -> Model:
    """Character counts from all documents, a lexicon and weights from at most ``bound`` labelled rows."""
    spark = docs.sparkSession
    table = count_characters(docs, text_col)
    runtime.ship(spark)
    rows = runtime.staged(labelled.sample(docs, labels, label, folds, held_out, bound, [text_col]).repartition(runtime.partitions(spark)), "toxicity-sample")
    shared = spark.sparkContext.broadcast(table)

    def toxic_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, count = CharModel(shared.value), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update({k for w in set(restored(t, lm)) for k in keys(w)})
        yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["key", "n"])

    base = rows.groupBy("y").count().collect()
    n = {r.y: r["count"] for r in base}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = math.log((pos + 1) / (neg + 1))
    if not pos or not neg:
        return Model(table, {}, np.zeros(0), prior)
    found = rows.where("y = 1").select(text_col).mapInArrow(toxic_keys, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 3")
    known = {r.key: r.n for r in found.collect()}  # bounded by the sample
    offered = spark.sparkContext.broadcast(set(known))

    def clean_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, count, have = CharModel(shared.value), Counter(), offered.value
        for b in batches:
            for t in b.column(0).to_pylist():
                count.update({k for w in set(restored(t, lm)) for k in keys(w) if k in have})
        yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["key", "n"])

    clean = {r.key: r.n for r in rows.where("y = 0").select(text_col).mapInArrow(clean_keys, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}

    def gain(k: str) -> float:
        a, b = known[k], clean.get(k, 0)
        p, q = (a + b) / (pos + neg), 0.0
        for seen, total in ((a, pos), (b, neg)):
            r = seen / total
            q += sum(total * x * math.log(x / e) for x, e in ((r, p), (1 - r, 1 - p)) if x > 0 and e > 0)
        return q

    strong = [k for k in known if known[k] / pos > 6 * (clean.get(k, 0) + 0.5) / neg]
    strong.sort(key=lambda k: (-gain(k), len(k), k))
    chosen = {k: i for i, k in enumerate(strong[:candidates])}
    pick = spark.sparkContext.broadcast(chosen)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(CharModel(shared.value), pick.value)
        for b in batches:
            packed = [np.array(sorted(r.features(t).items()), "<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(packed, pa.binary())], names=["y", "idx"])

    got = rows.select("y", text_col).mapInArrow(present, "y int, idx binary").collect()
    sets = sorted((r.y, bytes(r.idx)) for r in got)
    y = np.array([a for a, _ in sets], float)
    sparse = [dict(np.frombuffer(b, "<i4").reshape(-1, 2).tolist()) for _, b in sets]
    names = strong[:candidates]
    rows_of = defaultdict(set)
    for i in np.flatnonzero(y == 1).tolist():
        for k in sparse[i]:
            rows_of[k].add(i)
    purity = {k: math.log((known[names[k]] + 1) / (clean.get(names[k], 0) + 1) * neg / pos + 1) for k in rows_of}
    # forward selection: features that explain toxic rows which too few of the earlier ones explain
    short = dict.fromkeys(np.flatnonzero(y == 1).tolist(), 3)
    lexicon: list[int] = []
    explained: dict[int, set[int]] = {}
    while short and rows_of and len(lexicon) < most:
        best = max(rows_of, key=lambda k: (len(short.keys() & rows_of[k]) * purity[k], -k))
        mine = rows_of.pop(best)
        if len(short.keys() & mine) < 3:
            break
        if any(len(mine & seen) > 0.9 * len(mine | seen) for seen in explained.values()):
            continue  # another name of a feature that is in
        lexicon.append(best)
        explained[best] = mine
        for i in short.keys() & mine:
            short[i] -= 1
            if not short[i]:
                del short[i]
    place = {k: i for i, k in enumerate(lexicon)}
    weights, bias = _logistic([{place[k]: n for k, n in x.items() if k in place} for x in sparse], y, len(lexicon), prior)
    return Model(table, {names[k]: i for k, i in place.items()}, weights, bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast((model.table, model.chosen, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        r = Restorer(CharModel(m.table), m.chosen)
        for b in batches:
            s = [m.score(r.features(t.as_py())) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
