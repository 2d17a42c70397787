import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm.tokens import ChunkTokenizer

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["Plain words, here.\nAnd There! the END", "a\x00, b\x00", "\x00", "x, \x00y.", "don't, we'Ll. I'M, 'tis,", "x1a, 12. a1: (a), b), c.)",
       "wo...rd... what?! a,b, ,c .", "\u0130X. X\u0130, caf\u00e9, ecole\u0301, e\u0301. A\u030a, \u212a, \ufb01.", "K\u0308. a\u0301, \u0391\u03a3.", "end,", ",", "a,\n\nb.\n",
       "\nA\n B,", "Ab \u0120cd \u0120, \u0120", "<|EndOfText|>, a", "q" * 300 + ", " + "Z" * 300 + "."]


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
@pytest.mark.parametrize("added", [True, False])
def test_ids_of_odd_texts(path, blanks, added):
    texts = ODD + [f"{a} {b}" for a in ODD for b in ODD] + [f"{a}\n{b}" for a in ODD for b in ODD]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for size in (5, 100_000):
        tok = ChunkTokenizer(path, blanks, cache_chunks=size, added_tokens=added)
        assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode(texts)] == want


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
def test_words_of_letters_go_to_the_model_alone(path, blanks):
    tok = ChunkTokenizer(path, blanks, added_tokens=True)
    seen, ids = [], tok._ids
    tok._ids = lambda texts: seen.extend(texts) or ids(texts)
    tok.encode(["Some plain words, with marks.\nNext line; end!", "Some other, words."])
    assert not any(c.isalpha() for t in seen for c in t)
