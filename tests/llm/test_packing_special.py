import public_tokenizers
from tokenizers import Tokenizer

from routecast.llm import packing

from . import test_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "é漢<|endoftext|>!", "<|endoftext", "<|EndOfText|>", "a<|endoftext|>b" * 700, "plain"]


def test_ids_of_the_unmodified_file():
    for encode in (packing.Encoder(PATH), packing.Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        for t in TEXTS:
            assert list(memoryview(encode(t)).cast("I")) == PLAIN.encode(t, add_special_tokens=False).ids


def test_packed_pieces_of_the_unmodified_file(make_docs, monkeypatch):
    monkeypatch.setattr(test_packing, "TOKENIZER", PLAIN)
    rows = list(enumerate(TEXTS))
    test_packing.check(rows, packing.op3_packing(make_docs(rows)).collect())
