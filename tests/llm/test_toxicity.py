import itertools
import math
from collections import Counter

import numpy as np
import pytest

from curaspark.llm import toxicity

CORPUS = Counter({"idiot": 60, "loser": 60, "stupid": 60, "moron": 50, "the": 500, "with": 300, "letter": 200, "committee": 100, "and": 400, "going": 200, "wonder": 100, "lasting": 80, "street": 90})


@pytest.fixture(scope="module")
def lm():
    return toxicity.CharModel(toxicity.ngram_counts(CORPUS))


def cost(path, lm):
    total, word = sum(c for _, c in path), ["\x02", "\x02"]
    for c in "".join(t for t, _ in path) + "\x03":
        if c == "\x03" and word[-1] == "\x02":
            continue
        total -= lm.logp(word[-2], word[-1], c) if word[-1] != "\x02" else (lm.logp("", "\x02", c))
        word = [*word, c] if c != "\x03" else ["\x02", "\x02"]
    return total


def test_counts_are_plain_trigram_counts(lm):
    plain = Counter()
    for w, n in CORPUS.items():
        s = f"\x02{w}\x03"
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                plain[s[i : i + k]] += n
    for g, n in plain.items():
        assert lm._n(g) >= n
    assert lm.table.sum() == sum(plain.values())
    assert math.isfinite(lm.logp("q", "z", "j"))


@pytest.mark.parametrize("token,spaced", [*((t, False) for t in ("l0ser", "st.u.p1d", "m0r0n", "iiddiioott", "l00ser$", "!d10t", "a-b", "$$@", "l.o!")), *((t, True) for t in ("andidiot", "theand", "the and", "ll0o", "letterr"))])
def test_viterbi_is_the_cheapest_path(token, spaced, lm):
    """Against every path of the lattice: no path costs less than the best one that spells what was decoded."""
    slots = toxicity.lattice(token, spaced)
    spelt = {}
    for p in itertools.product(*slots):
        text = "\x03".join(x for x in "".join(t for t, _ in p).split("\x03") if x)
        spelt[text] = min(spelt.get(text, math.inf), cost(p, lm))
    found = "\x03".join(x for x in toxicity.decode(slots, lm).split("\x03") if x)
    assert spelt[found] == pytest.approx(min(spelt.values()), abs=1e-9)


@pytest.mark.parametrize("token,word", [("l0ser", "loser"), ("1d10t", "idiot"), ("st.u.p.id", "stupid"), ("looooser", "loser"), ("$tupid!!", "stupid"), ("m-o-r-o-n", "moron"), ("committee", "committee"), ("letter,", "letter"), ("2024", "2024"), ("$tup1d", "stupid"), ("going!!", "going"), ("the$$", "the"), ("$treet", "street"), ("le††er", "le††er")])
def test_restores(token, word, lm):
    assert toxicity.restore_token(token, lm) == [word]


def test_tokens_of_symbols_alone(lm):
    small = toxicity.CharModel(toxicity.ngram_counts(CORPUS + Counter({"ass": 80, "hat": 60})))
    assert toxicity.restore_token("@$$", small) == ["ass"] and toxicity.restore_token("h@+", small) == ["hat"]
    assert toxicity.restore_token("455", small) == ["455"]  # a number
    assert toxicity.restore_token("--", small) == ["--"] and toxicity.restore_token("!", small) == ["!"]


def test_spaced_words(lm):
    assert "idiot" in toxicity.restored("the i d i o t with", lm)
    assert toxicity.restored(None, lm) == [] and toxicity.spaced_runs("a b", ["a", "b"]) == []
    for text in ("t h e i d i o t", "t h e  i d i o t", "t h e\n\ni d 1 o t"):
        assert toxicity.restored(text, lm)[-2:] == ["the", "idiot"], text
    assert toxicity.restored("s t u p i d  i d i o t  a n d  l o s e r", lm)[-4:] == ["stupid", "idiot", "and", "loser"]
    assert toxicity.restored("g o i n g  g o i n g", lm)[-2:] == ["going", "going"]
    text = "a b  c d e"
    assert toxicity.spaced_runs(text, text.split()) == ["ab cde"]
    wide = "a  b  c"
    assert toxicity.spaced_runs(wide, wide.split()) == ["abc"]


def test_learns_plain_and_hidden_words(spark):
    rng = np.random.default_rng(0)
    usual = [w for w in CORPUS if w not in ("idiot", "loser", "stupid", "moron")]
    rows, labels = [], []
    for k in range(500):
        words = list(rng.choice(usual, 30))
        toxic = k % 5 == 0
        if toxic:
            words[3] = ["idiot", "loser", "stupid", "moron"][k // 5 % 4]
        rows.append((k, " ".join(words), "z"))
        labels.append((k, int(toxic)))
    schema = "doc_id long, text string, score string"
    docs, labs = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.fit(docs, labs)
    odd = [(1000, "the st.u.p.1d going and", ""), (1001, "with the l0o0ser and", ""), (1002, None, ""), (None, "", ""), (1003, "street " * 30_000 + "m0r0n", ""), (1004, "the and", ""), (1004, "the and", "")]
    got = [(r.doc_id, r.score > 0.5) for r in toxicity.scored(spark.createDataFrame(odd, schema), m).collect()]
    assert got == [(1000, True), (1001, True), (1002, False), (None, False), (1003, True), (1004, False), (1004, False)]
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, m).collect()}
    assert np.mean([(scores[d] > 0.5) == (t == 1) for d, t in labels]) > 0.98
    assert toxicity.scored(docs.limit(0), m).collect() == []
    none = toxicity.fit(docs, labs.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}
