import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm.queries import op4_best_fit_packing, op10_token_files
from vigil.llm.tokens import ChunkTokenizer

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(tok, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in tok.encode(texts)]


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
def test_marks_behind_letters_whose_normal_form_has_a_combining_mark(path, blanks):
    texts = ["TAR\u0130H\u0130.", "BELED\u0130YES\u0130, x", *(f"a {chr(c)}. x{chr(c)}, {chr(c)}b!"
             for c in (*range(0x80, 0x1000), *range(0xFB00, 0xFB50)) if chr(c).isalpha())]
    library = Tokenizer.from_file(path)
    assert ids_of(ChunkTokenizer(path, blanks), texts) == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


HELD = ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "x\n <|endoftext|>\n\ny", "<|ENDOFTEXT|> <|endoftext |>", "no token"]


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
def test_strings_of_added_tokens_as_the_library_has_them(path, blanks):
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in HELD]
    tok = ChunkTokenizer(path, blanks, added_tokens=True)
    assert ids_of(tok, HELD) == want and ids_of(tok, HELD[::-1]) == want[::-1]


def test_queries_keep_the_library_default(spark, tmp_path):
    spark.createDataFrame(list(enumerate(HELD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def checksums(path, end):
        library = Tokenizer.from_file(path)
        ids = [library.encode(t, add_special_tokens=False).ids + [end] for t in HELD]
        return [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]

    packed = [op4_best_fit_packing(spark, str(tmp_path)),
              corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))]
    for out in packed:
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out.collect()) == checksums(WORD, 1)
    files = op10_token_files(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in files.collect()) == checksums(BYTE, 0)
