"""Added tokens are encoded as the tokenizer's file says."""

import numpy as np
from tokenizers import Tokenizer

from strandlake.llm import token_records


def test_added_tokens_as_loaded():
    path = token_records.default_tokenizer()
    fresh, coder = Tokenizer.from_file(path), token_records.Encoder(path)
    texts = ["one two<|endoftext|>three", "<|endoftext|> x", "a  <|endoftext|>\n b \0", "plain words, no token", "", "<|endoftext", "<|ENDOFTEXT|> x"]
    for _ in range(2):
        assert coder.encode(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in texts]
    assert 50256 in np.frombuffer(coder.encode(texts[:1])[0], coder.dtype)


def test_words_are_looked_up_once_a_call():
    """A word that many texts of a call repeat is looked up once, and odd white space changes no id."""
    path = token_records.default_tokenizer()
    fresh, coder, missed = Tokenizer.from_file(path), token_records.Encoder(path), []

    class Counted(token_records._Known):
        def __missing__(self, word):
            missed.append(word)
            return super().__missing__(word)

    coder.known = Counted(1000)
    texts = ["one two, one two,\none  two", "", " ", "\n", "\n\n one", "two\t one ", "one two, \r\n", "Été… «x» 12,5% (a) don't", "\0one two"] * 3
    for _ in range(2):
        assert coder.encode(texts) == [np.array(fresh.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in texts]
    assert missed.count("two,") == 1
    assert coder.encode([]) == []
