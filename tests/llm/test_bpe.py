"""Encoding against the public libraries, and its exact round trip."""

import base64
import os
import random

import pytest
import tiktoken

from chartlake.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def public():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(2)
    out = ["", " ", "a", "it's we'll", "<|endoftext|> x", "가나다" * 300, "a" * 3000, " " * 777, "ab" * 999, "👩‍🎤" * 80, "\r\n\t x y", "Ωμέγα 123456"]
    for n in (1, 2, 63, 64, 65, 1000, 5000):
        out.append("".join(rnd.choice("abcdefghijklmnop") for _ in range(n)))
    out += ["".join(rnd.choice("thein gs.,'12\n한é") for _ in range(rnd.randrange(400))) for _ in range(300)]
    return out


def test_same_as_public(public):
    with open(bpe.VOCABULARY, "rb") as f:
        e = bpe.Encoder(f.read())
    t = texts()
    ids, offs = e.encode(t)
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [public.encode_ordinary(x) for x in t]


def test_forgets_and_stays_right(public, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    with open(bpe.VOCABULARY, "rb") as f:
        e = bpe.Encoder(f.read())
    for x in texts()[:60]:
        ids, _ = e.encode([x, None])
        assert ids.tolist() == public.encode_ordinary(x)


def test_frame(spark):
    t = [*texts()[:20], None]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(t)], "i int, text string, ids string")
    out = bpe.encode(df)
    assert out.columns == ["i", "ids"]
    back = {r.i: r.text for r in bpe.decode(out).collect()}
    assert back == {i: x or "" for i, x in enumerate(t)}
    got = {r.i: r.ids for r in out.collect()}
    assert got[len(t) - 1] == [] and got[0] == []
    n = {r.i: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0
