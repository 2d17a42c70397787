import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm.common import fresh_path
from vigil.llm.packing import best_fit_plan, pack_documents
from vigil.llm.token_files import (bits_for, pack_ids, read_checksums, read_documents, read_ids_at, unpack_ids,
                                   write_token_files)
from vigil.llm.tokens import ChunkTokenizer

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a  b ", "x\n y", " lead", "trail ", "a\tb c", "don't  stop", "1 2  3\n\n4", "日本語 テキスト",
       "<|endoftext|> hi", "<|startoftext|>a", "\x1c a", "a \x85b", "ﬁ é Å ①", "a\x7f b \x7f c", "\xa0 x", "a " * 50]


def whole_ids(path, texts):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,blanks", [(BYTE, True), (WORD, False)])
def test_chunks_give_the_ids_of_the_whole_text(path, blanks):
    texts = ODD + [f"{a} {b}" for a in ODD for b in ODD]
    for size in (3, 100_000):       # a cache that forgets all the time, and one that never does
        tok = ChunkTokenizer(path, blanks, cache_chunks=size)
        for _ in range(2):
            got = [np.frombuffer(b, "<u4").tolist() for i in range(0, len(texts), 50) for b in tok.encode(texts[i:i + 50])]
            assert got == whole_ids(path, texts)


def test_pack_bits_and_random_access():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]
    for bits in (1, 5, 8, 13, 16, 17, 31, 32):
        ids = np.random.default_rng(bits).integers(0, 2 ** bits, 1001, dtype=np.uint64).astype("<u4")
        packed = pack_ids(ids, bits)
        assert len(packed) == (1001 * bits + 7) // 8
        assert (unpack_ids(packed, bits, 1001) == ids).all()
        assert (unpack_ids(packed, bits, 37, 501) == ids[501:538]).all()
        assert len(unpack_ids(packed, bits, 0, 5)) == 0


def test_files_round_trip(spark):
    texts = [None, *ODD, "long " * 30_000]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    path = fresh_path(spark, "t")
    write_token_files(docs, path, BYTE, 0, 50257, block_ids=500)
    want, at = [], 0
    for key, text, _ in sorted(rows):
        ids = np.array(whole_ids(BYTE, [text or ""])[0] + [0], dtype="<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in read_checksums(spark, path).collect()) == want
    docs_back = {r.doc_id: r for r in read_documents(spark, path).collect()}
    assert docs_back[99].ids == whole_ids(BYTE, [texts[1]])[0] + [0]
    all_ids = [i for k in sorted(docs_back) for i in docs_back[k].ids]
    assert read_ids_at(spark, path, 30, 2000).tolist() == all_ids[30:2030]
    assert len(read_ids_at(spark, path, at + 5, 10)) == 0


def test_files_ties_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n")], "doc_id long, text string")
    path = fresh_path(spark, "t")
    write_token_files(docs, path, BYTE, 0, 50257)
    assert [(r.doc_id, r.start) for r in read_checksums(spark, path).orderBy("start").collect()] == [
        (None, 0), (1, 2), (1, 4), (1, 6)]
    path = fresh_path(spark, "t")
    write_token_files(docs.limit(0), path, BYTE, 0, 50257)
    assert read_checksums(spark, path).count() == 0


def best_fit_by_hand(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms[rooms.index(min(fits))] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(1, 60))
        histogram = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, capacity + 1, size=12)}
        plan, used = best_fit_plan(histogram, capacity)
        bins = [[] for _ in range(used)]
        for length, lo, hi, first, per, base in plan:
            for q in range(hi - lo):
                bins[first + q // per].append((base + q % per * length, length))
        for held in bins:
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
        assert sorted(capacity - sum(n for _, n in b) for b in bins) == best_fit_by_hand(histogram, capacity)
    assert best_fit_plan({}, 10) == ([], 0)


def test_packing_whole_documents(spark):
    texts = [None, "", "word " * 9000, *ODD, *["some words here " * n for n in range(40)]]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = pack_documents(docs, WORD, 1).collect()
    pieces = []
    for key, text, _ in rows:
        ids = np.array(whole_ids(WORD, [text or ""])[0] + [1], dtype="<u4")
        pieces += [(key, p, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
                   for p, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == -(-sum(p[3] for p in pieces) // 4096)
    assert pack_documents(docs.limit(0), WORD, 1).count() == 0


def test_a_small_cache_gives_the_same_pieces(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(400)) + "\n\n tail!") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = ("doc_id", "piece", "start", "length", "ids_crc32")
    small, usual = (sorted(tuple(r) for r in pack_documents(docs, WORD, 1, added_tokens=True, **kind).select(*order).collect())
                    for kind in (dict(cache_chunks=20), {}))
    assert small == usual and len(small) >= 40
