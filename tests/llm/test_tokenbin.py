import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curaspark.llm import tokenbin


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=12), st.integers(1, 5))
def test_round_trip_and_random_access(docs, levels):
    b = tokenbin.Block(tokenbin.encode_block([None if k == 1 else k for k in range(len(docs))], [np.array(d, np.uint32) for d in docs], levels))
    assert len(b.levels) <= levels
    flat = [x for d in docs for x in d]
    assert [b.doc(k).tolist() for k in range(len(docs))] == docs
    assert [b.get(p) for p in range(len(flat))] == flat
    assert b.doc_ids == [None if k == 1 else k for k in range(len(docs))]
    mid = len(flat) // 2
    assert b.slice(mid // 2, mid).tolist() == flat[mid // 2 : mid]


@pytest.mark.parametrize("width", range(1, 33))
def test_packing(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        v = rng.integers(0, 1 << width, n, dtype=np.uint64)
        buf = memoryview(tokenbin._pack(v, width))
        plain = sum(int(x) << k * width for k, x in enumerate(v))
        assert int.from_bytes(buf, "little") == plain
        for a, b in ((0, n), (n // 3, n), (n // 2, n // 2 + (n > 0)), (min(n, 70), n)):
            assert tokenbin._unpack(buf, width, a, b).tolist() == v[a:b].tolist()


def test_widths_are_the_cheapest():
    import itertools

    rng = np.random.default_rng(1)
    for top in (1, 5, 9):
        bits = rng.integers(1, top + 1, 400)

        def cost(widths):
            return sum((w + (1 + 32 / tokenbin.RANK) * (k + 1 < len(widths))) * (len(bits) if not k else (bits > sum(widths[:k])).sum()) for k, w in enumerate(widths))

        for levels in (1, 2, 3):
            every = [w for n in range(1, levels + 1) for w in itertools.product(range(1, int(bits.max()) + 1), repeat=n) if sum(w) == bits.max()]
            assert cost(tokenbin.chunk_widths(bits, levels)) == pytest.approx(min(map(cost, every)))


def test_files_of_documents_hold_several_levels(spark):
    """Blocks read back from the files of a whole table: levels, bitmaps and directories are there, and any token is found through them."""
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, tokens, size = np.random.default_rng(0), 0, 0
    encode = tokenbin.word_ids(path).encode
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokenbin.write_blocks(docs, path).collect():
        b = tokenbin.Block(bytes(r.payload))
        tokens, size = tokens + b.n_tokens, size + len(r.payload)
        if b.n_tokens < 1000:
            continue
        assert len(b.levels) >= 2
        for _, n, body, bitmap, ranks in b.levels[:-1]:
            assert len(bitmap) == -(-n // 8) and any(bitmap) and len(ranks) == -(-n // tokenbin.RANK) + 1 and len(body)
        flat = np.concatenate([np.append(encode((texts[d] or "").encode()), 1) for d in b.doc_ids])
        deep = np.flatnonzero(flat >> b.widths[0])  # tokens that go beyond the first level
        at = [*rng.integers(0, b.n_tokens, 200).tolist(), *rng.choice(deep, 100).tolist()]
        assert [b.get(p) for p in at] == flat[at].tolist()
    assert size < 1.9 * tokens  # two bytes a token without the method, ids of documents and offsets included
    with pytest.raises(IndexError):
        b.get(b.n_tokens)


def test_documents_match_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, the World's  end!", None, "", "été İ ΣΣ <|endoftext|>x don't 123  4", "a b\x85c\r\n d", "word " * 3000, "\U0001f600́ ́ x"] * 3
    rows = [(20 - k if k != 4 else None, t, "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = tokenbin.read_documents(tokenbin.write_blocks(df, path, block_tokens=500)).collect()
    tok, want, at = Tokenizer.from_file(path), [], 0
    for d, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenbin.read_documents(tokenbin.write_blocks(df.limit(0), path)).collect() == []
