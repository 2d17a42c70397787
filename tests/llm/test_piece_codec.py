import hashlib

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as schema

from vigil.llm.piece_codec import Normaliser, PieceCodec, decode_documents, encode_documents, round_trip_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "x\n y", "trail ", "a\tb c", "▁a ▁", "a ▁ b", "日本語 テキスト", "</s> x <unk>", "ﬁ é Å ①",
         "é a", "😀 ok", "word " * 3000, "​z", "Ａ１　２"]


def test_spans_cover_the_text_and_ids_are_the_librarys():
    codec, library = PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in TEXTS:
        for codec.blanks_only in (True, False):     # the short cut, and the general walk along the alignment
            ids, bounds = codec.encode(text)
            assert ids == library.encode(text, add_eos=True)
            assert len(bounds) == len(ids) + 1 and bounds[-1] == bounds[-2]
            assert bounds[-1] == len(text.encode()) and (bounds[1:] >= bounds[:-1]).all()
        data = text.encode()
        if "▁" not in text:
            for n, (i, lo, hi) in enumerate(zip(ids[:-1], bounds, bounds[1:])):
                if not library.is_byte(i):
                    piece = library.id_to_piece(i).replace("▁", " ")
                    assert data[lo:hi].decode() == (piece[1:] if n == 0 else piece)


def test_compiled_character_map_normalises_as_the_library_does():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    model = schema.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    normalise = Normaliser(model.normalizer_spec)
    assert normalise.map
    for text in TEXTS:
        out, source = normalise(text)
        assert out.decode() == library.normalize(text)
        assert len(source) == len(out) + 1 and (source[1:] >= source[:-1]).all()
    out, source = normalise("ﬁ x")
    assert out.decode() == "▁fi▁x" and source.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 5]


def test_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])] + [(0, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = round_trip_digests(docs, MODEL).collect()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((key, len(ids), *sha, len((text or "").encode())))
    assert sorted(tuple(r) for r in got) == sorted(want)
    encoded = encode_documents(docs, MODEL)
    assert {r.doc_id: r.text for r in decode_documents(encoded, MODEL).collect()}[2] == library.decode(library.encode(TEXTS[2]))
    assert round_trip_digests(docs.limit(0), MODEL).count() == 0
