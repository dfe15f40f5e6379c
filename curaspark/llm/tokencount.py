"""Token counts by count-only Viterbi (operator 9).

An Aho-Corasick automaton over a unigram vocabulary lists, end by end, every piece that matches in a word; dynamic programming
carries the best score and its number of pieces alone, so no segmentation is ever built. Ties follow the unigram encoder of
the ``tokenizers`` library exactly: of equal scores the piece that starts first wins; a character that is no piece itself may
pass as unknown at the least piece score less 10; unknown runs are spelled in byte pieces where the vocabulary has them all.

Words are split at ASCII white space and begin with the vocabulary's word mark. Cases: a null or empty text has 0 tokens and
score 0; very long words are read whole; repeated rows count alike; an empty table gives an empty result; other columns of
the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

UNKNOWN_PENALTY, MARK, CACHE_WORDS = 10.0, "▁", 250_000


class Unigram:
    """Counts pieces of words under (piece, score) pairs; a piece listed twice keeps its last score, as a map would."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, mark: str = MARK):
        self.mark, table = mark, dict(pieces)
        self.scores = table
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in table for b in range(256))
        self.single = {p for p in table if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in table.items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.empty = not any(table)
        if not self.empty:
            self.automaton.make_automaton()
        self.cache: dict[bytes, tuple[int, float]] = {}

    def segment(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a string."""
        n = len(word)
        known = self.single.issuperset(word)
        if self.empty:
            matches = ()
        else:
            matches = self.automaton.iter(word)
        if known:  # every end is reached by a single character at least
            best, count = [0.0] * (n + 1), [0] * (n + 1)
            last = -1
            top, pieces = 0.0, 0
            for end, (size, score) in matches:  # longest first at each end: the order of starts
                if end != last:
                    if last >= 0:
                        best[last + 1], count[last + 1] = top, pieces
                    start = end + 1 - size
                    top, pieces, last = best[start] + score, count[start] + 1, end
                    continue
                start = end + 1 - size
                value = best[start] + score
                if value > top:
                    top, pieces = value, count[start] + 1
            return (pieces, top) if n else (0, 0.0)
        return self._with_unknown(word, matches)

    def _with_unknown(self, word: str, matches) -> tuple[int, float]:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, score) in matches:
            ends[end + 1].append((end + 1 - size, score))
        # score, pieces before the unknown run that ends here, bytes of that run (0: none)
        state: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for e in range(1, n + 1):
            here = None
            for start, score in ends[e]:
                value = state[start][0] + score
                if here is None or value > here[0]:
                    here = (value, self._closed(state[start]) + 1, 0)
            if word[e - 1] not in self.single:
                value = state[e - 1][0] + self.unknown
                if here is None or value > here[0]:
                    _, pieces, run = state[e - 1]
                    here = (value, pieces, run + len(word[e - 1].encode("utf-8", "surrogatepass")))
            state.append(here)
        return self._closed(state[n]), state[n][0]

    def _closed(self, state: tuple[float, int, int]) -> int:
        _, pieces, run = state
        return pieces + (run if self.bytes else 1) if run else pieces

    def count(self, text: bytes | None) -> tuple[int, float, int]:
        """(tokens, score, words) of a text."""
        words = (text or b"").split()
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        tokens, total = 0, 0.0
        for w in words:
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = self.segment(self.mark + w.decode("utf-8", "replace"))
            tokens += hit[0]
            total += hit[1]
        return tokens, total, len(words)


_loaded: dict[str, Unigram] = {}


def piece_table(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def loaded(path: str) -> Unigram:
    if path not in _loaded:
        _loaded[path] = Unigram(piece_table(path))
    return _loaded[path]


def counted(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_words, score) of every row; ``vocabulary`` is the path of a sentencepiece file on every node."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = loaded(vocabulary).count
        for b in batches:
            got = [count(t.as_py()) for t in b.column(1)]
            tokens, scores, words = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "n_words", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_words long, score double")
