"""Ids of any tokenizers file are the library's own."""

import json
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_file(name):
    from tokenizers import Tokenizer

    from lamella.llm.bitpack import WordEncoder

    path = public_tokenizers.path(name)
    library, encoder, r = Tokenizer.from_file(path), WordEncoder(path), random.Random(2)
    parts = ["Hello", "world.", "don't", "über", "12", "\n", "  ", "日本", "<|endoftext|>", "a,b", "İ", "é", "🙂"]
    texts = ["", *(" ".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(200))]
    got = encoder.encode([t.encode() for t in texts], None)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_by_word():
    from tokenizers import Tokenizer

    from lamella.llm.bitpack import by_word

    known = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    assert by_word(known) and not by_word(known | {"normalizer": None}) and not by_word({})
    assert not by_word(json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str()))


def test_narrow_transitions():
    from lamella.llm import transducer

    assert -transducer._BIAS < 0 < (1 << transducer._SHIFT) - transducer._BIAS
