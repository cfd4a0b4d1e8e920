"""Texts that hold a special token's text, against the library's default."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eventloom.llm import bpe


@pytest.mark.parametrize(("name", "lower", "end"), [("word_bpe_49k.json", True, 49407), ("byte_bpe_50k.json", False, 50256)])
def test_special_tokens_are_the_default_ones(name, lower, end):
    path = public_tokenizers.path(name)
    texts = ["one two", "a<|endoftext|>b", "A <|ENDOFTEXT|> b", None, "<|endoftext|>", "<|endoftext|", "x <|startoftext|> y", "é <|endoftext|>\n z"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = []
    for lo, ids, counts in bpe.encoder(path, lower).encode(pa.array(texts, pa.string())):
        ends = np.cumsum(counts)
        got += [ids[a:b].tolist() for a, b in zip(ends - counts, ends)]
    assert got == want and end in got[1] and got[4] == [end]
