import random

import numpy as np
import pytest

from flowloom.llm.bpe import PIECE, Encoder, Vocabulary, decode, encode

tokenizers = pytest.importorskip("tokenizers")
path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(path)


def texts():
    rng = random.Random(1)
    out = ["", "  ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "Ünï ΣΑΣ İstanbul ŉ ǰ ß", "aaaa bbb aaaaaaaaaaaaaa", "x\x1cy\x1dz\x85w　q r​s﻿t",
           "é é ́a", "don't we'll I'M he's 12345 ½ Ⅳ ٣", "\U0001F600 hi\U0001F468‍\U0001F469", "ᎠꭰᲠ ՘࢏౜Ᲊ₝", "word " * 300_000, "x" * (PIECE + 10)]
    for _ in range(200):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(rng.randrange(1, 80))))
    for _ in range(200):
        out.append("".join(rng.choice("abcstheing ") for _ in range(rng.randrange(1, 200))))
    return out


def test_like_the_library(library, vocabulary):
    for t, ids in zip(texts(), Encoder(vocabulary).encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, vocabulary, monkeypatch):
    import flowloom.llm.bpe as module
    monkeypatch.setattr(module, "CACHE", 20)
    encoder = Encoder(vocabulary)
    for t in texts()[12:80]:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_tables(documents, library, vocabulary):
    rows = [(i, t) for i, t in enumerate(texts()[:12])] + [(None, "hello"), (3, None), (3, None)]
    encoded = encode(documents(rows), vocabulary)
    got = decode(encoded, vocabulary).collect()
    assert sorted(map(str, got)) == sorted(map(str, encode(documents(rows), vocabulary, back=True).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.decoded) for r in got) == sorted(want)
    assert decode(encode(documents([]), vocabulary), vocabulary).collect() == []
