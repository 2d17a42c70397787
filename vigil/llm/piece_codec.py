"""SentencePiece encoding with every piece projected to its original byte span.

Normalisation is done here, by longest-prefix lookup in the model's compiled
character map (a double-array trie over UTF-8 bytes), noting for every byte it
writes which original byte it came from. The library cuts the text into pieces;
the pieces' bytes are walked along that alignment, so each piece gets the byte span of
the original text it stands for. A model without a character map changes blanks
only, and its alignment is a running sum of the pieces' widths.

Defined results: null text counts as empty; an empty text has only the end id, with
the empty span at 0; an empty table gives no rows; repeated rows give repeated
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm.common import text_or_empty

BLANK = "▁"                 # the library writes blanks as U+2581
BLANK_BYTES = len(BLANK.encode())


class CharacterMap:
    """A compiled character map: 4-byte length, trie units, then NUL-ended replacements.

    A trie unit holds a label (low byte), a has-value bit (bit 8) and the distance to its
    children (from bit 10, shifted by 8 more when bit 9 is set); a value unit has bit 31 set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.replacements = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes matched, replacement) of the longest key that starts at ``at``; (0, b"") if none."""
        units, end = self.units, len(data)
        matched, value = 0, -1
        node = self._children(units[0], 0)
        for i in range(at, end):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._children(unit, node)
            if unit & 0x100:
                matched, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not matched:
            return 0, b""
        return matched, self.replacements[value:self.replacements.index(b"\0", value)]

    @staticmethod
    def _children(unit: int, node: int) -> int:
        return node ^ ((unit >> 10) << (8 if unit & 0x200 else 0))


class Normaliser:
    """Text to normalised bytes, with the original byte each of them came from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.blank = BLANK.encode() if spec.escape_whitespaces else b" "

    def steps(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(from byte, to byte, replacement) for the whole text, longest prefixes first."""
        at = 0
        while at < len(data):
            n, new = self.map.longest(data, at) if self.map else (0, b"")
            if not n:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at:at + n]
            yield at, at + n, new
            at += n

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, start): ``start[i]`` is the original byte of byte i, ``start[-1]`` the end."""
        data = text.encode()
        out, source = bytearray(), []
        after_blank, end = self.squeeze, 0       # squeezing drops blanks at the start
        if self.dummy_prefix:
            out += self.blank
            source += [0] * len(self.blank)
        lead = len(out)
        for lo, hi, new in self.steps(data):
            own = new == data[lo:hi]            # a character that is copied keeps its own bytes
            for i, byte in enumerate(new):
                if byte == 0x20:
                    if self.squeeze and after_blank:
                        continue
                    out += self.blank
                    source += [lo] * len(self.blank)
                else:
                    out.append(byte)
                    source.append(lo + i if own else lo)
                after_blank = byte == 0x20
            end = hi if new else end
        if self.squeeze:
            while len(out) > lead and out.endswith(self.blank):
                end = source[-1]
                del out[-len(self.blank):], source[-len(self.blank):]
        if len(out) == lead:
            return b"", np.zeros(1, dtype=np.int64)
        if self.dummy_prefix:
            source[:lead] = [source[lead]] * lead
        return bytes(out), np.array([*source, end], dtype=np.int64)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema
        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, pieces = model.normalizer_spec, model.pieces
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = self.library.eos_id()
        self.normalise = Normaliser(spec)
        self.width = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in pieces], dtype=np.int64)
        # Without a character map, blanks are all that changes: one byte becomes BLANK_BYTES.
        self.blanks_only = (not self.normalise.map and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
                            and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
                            and model.trainer_spec.byte_fallback)
        self.source_width = self.width - (BLANK_BYTES - 1) * np.array([p.piece.count(BLANK) for p in pieces])

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids with the end id, and their span bounds (one more than ids).

        Piece i stands for original bytes [bounds[i], bounds[i + 1]); the end id for the empty
        span at the end of the text.
        """
        ids = self.library.encode(text)
        if self.blanks_only and ids and BLANK not in text:
            bounds = np.zeros(len(ids) + 2, dtype=np.int64)
            np.cumsum(self.source_width[ids], out=bounds[1:-1])
            bounds[1:-1] -= 1                   # the first blank is the model's own, not the text's
            bounds[-1] = bounds[-2]
            size = len(text) if text.isascii() else len(text.encode())
        else:
            normal, source = self.normalise(text)
            surfaces = self.library.encode(text, out_type=str)
            widths = [1 if self.library.is_byte(i) else len(s.encode()) for i, s in zip(ids, surfaces)]
            ends = np.cumsum([0, *widths], dtype=np.int64)
            if ends[-1] != len(normal):
                raise ValueError("the pieces do not cover the normalised text")
            bounds, size = source[np.append(ends, ends[-1])], int(source[-1])
        if bounds[-1] != size:
            raise ValueError("the pieces do not cover the text")
        ids.append(self.end_id)
        return ids, bounds

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _texts(batches, at_once=256):
    for batch in batches:
        for lo in range(0, batch.num_rows, at_once):
            part = batch.slice(lo, at_once)
            yield part.column(0), part.column(1).to_pylist()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, span_start, span_end): piece ids with their byte spans in the original text."""
    def run(batches):
        codec = piece_codec(model_path)
        for keys, texts in _texts(batches):
            done = [codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([d[0] for d in done], pa.list_(pa.int32())),
                 pa.array([d[1][:-1] for d in done], pa.list_(pa.int64())),
                 pa.array([d[1][1:] for d in done], pa.list_(pa.int64()))],
                ["doc_id", "ids", "span_start", "span_end"])
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, span_start array<long>, span_end array<long>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    def run(batches):
        codec = piece_codec(model_path)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) through the same codec.

    ``covered_bytes`` is the sum of the pieces' span lengths: the text's byte length when
    the model drops nothing.
    """
    def run(batches):
        codec = piece_codec(model_path)
        for keys, texts in _texts(batches):
            done = [codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([len(d[0]) for d in done], pa.int64()),
                 pa.array([hashlib.sha256(" ".join(map(str, d[0])).encode()).hexdigest() for d in done], pa.string()),
                 pa.array([hashlib.sha256(codec.decode(d[0]).encode()).hexdigest() for d in done], pa.string()),
                 pa.array([int(d[1][-1] - d[1][0]) for d in done], pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
