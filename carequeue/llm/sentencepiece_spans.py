"""SentencePiece encoding and decoding that keep the place of every piece.

A text is normalized through the model's compiled character map: at each place the longest
known prefix is replaced and the byte it came from is noted for every byte put out. The
normalized text is cut into units no piece can cross, a unit is merged pair by pair in the
order of the scores and each piece is projected back to the bytes of the original.

The model file is parsed for its pieces, scores and character map; encoding and decoding
are done here. Defined cases: null and empty texts have no ids and decode to an empty text;
rows repeated give repeated results; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from carequeue.llm.batches import map_rows
from carequeue.llm.bpe import NEVER, merge

SPACE = "▁"
CACHED_UNITS = 300_000
UNITS = [
    re.compile(u)
    for u in (r" *[A-Za-zÀ-ÖØ-öø-ɏ]+| *[^ \dA-Za-zÀ-ÖØ-öø-ɏ]+|\d| +", r" *[^ ]+| +", r"(?s).+")
]


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes and replaced texts."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at a byte, and that prefix's length."""
        units, found = self.units, None
        node = _offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.texts[start : self.texts.index(0, start)], length


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 1 << 9) >> 6)


@dataclass(frozen=True)
class Piece:
    id: int
    begin: int  # bytes of the original text
    end: int


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[str]
    ranks: dict[str, int]  # pieces that merging may make, by falling score
    byte_ids: dict[int, int]
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or any(
            p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces
        ):
            raise ValueError("only BPE models without user-defined pieces are supported")
        normal = [p for p in proto.pieces if p.type == kinds.NORMAL]
        ordered = sorted(normal, key=lambda p: -p.score)
        byte_ids = {
            int(p.piece[3:5], 16): i
            for i, p in enumerate(proto.pieces)
            if p.type == kinds.BYTE
        }
        spec = proto.normalizer_spec
        return cls(
            [p.piece for p in proto.pieces],
            {p.piece: i for i, p in enumerate(ordered)},
            byte_ids if proto.trainer_spec.byte_fallback else {},
            next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN),
            spec.precompiled_charsmap,
            spec.add_dummy_prefix,
            spec.remove_extra_whitespaces,
        )


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a model file; tasks of one worker share its units."""
    return Encoder(Model.load(path))


class Encoder:
    """Encodes and decodes with one model."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        self.ids = {p: i for i, p in enumerate(model.pieces)}
        self.byte_of = {i: b for b, i in model.byte_ids.items()}
        # the finest of these cuts that no piece crosses; each cut depends on the two
        # characters it lies between alone, so merging never reaches over it
        spaced = [p.replace(SPACE, " ") for p in model.ranks]
        self.unit = next(
            u for u in UNITS if all(len(u.findall(p)) == 1 for p in spaced)
        )
        self.units: dict[str, tuple] = {}
        self.unit_ids: dict[str, tuple[int, ...]] = {}

    # normalization -----------------------------------------------------------------
    def normalize(self, text: str) -> tuple[str, list[int] | None]:
        """The normalized text, spaces as " ", and for each of its characters the byte it
        came from and the end at last; None where every character stands for itself."""
        model = self.model
        text = text if self.map else text.replace(SPACE, " ")
        if self.map is None and not model.squeeze:
            if not text:
                return "", None
            return (" " + text if model.dummy_prefix else text), None
        out, at = [], []
        data = text.encode()
        i = 0
        while i < len(data):
            found = self.map.longest(data, i) if self.map else None
            if found is None:
                size = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                put = data[i : i + size].decode()
            else:
                put, size = found[0].decode(), found[1]
            for c in put.replace(SPACE, " "):
                if model.squeeze and c == " " and (not out or out[-1] == " "):
                    continue
                out.append(c)
                at.append(i)
            i += size
        if model.squeeze:
            while out and out[-1] == " ":
                out.pop()
                i = at.pop()
        if not out:
            return "", []
        if model.dummy_prefix:
            out.insert(0, " ")
            at.insert(0, at[0])
        return "".join(out), [*at, i]

    # units -------------------------------------------------------------------------
    def pieces_of(self, unit: str) -> list[str]:
        ranks = self.model.ranks
        marked = unit.replace(" ", SPACE)
        return merge(marked, lambda a, b, get=ranks.get: get(a + b, NEVER))

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece) if piece in self.model.ranks else None
        if found is not None:
            return [found]
        if self.model.byte_ids:
            return [self.model.byte_ids[b] for b in piece.encode()]
        return [self.model.unknown]

    def known(self, unit: str) -> tuple:
        """(ids, ids as text, decoded text, bytes that each id stands for) of a unit."""
        found = self.units.get(unit)
        if found is None:
            ids, lengths = self.spelled(self.pieces_of(unit))
            found = (ids, ",".join(map(str, ids)), self.decode(ids, bos=False), lengths)
            if len(self.units) >= CACHED_UNITS:
                self.units.clear()
            self.units[unit] = found
        return found

    def ids_of_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit alone, for texts of which no more is asked."""
        found = self.unit_ids.get(unit)
        if found is None:
            found = tuple(i for piece in self.pieces_of(unit) for i in self.ids_of(piece))
            if len(self.unit_ids) >= CACHED_UNITS:
                self.unit_ids.clear()
            self.unit_ids[unit] = found
        return found

    def spelled(self, pieces: list[str], added: int = 0) -> tuple[list[int], bytes]:
        """The ids of some pieces and the bytes of the original that each stands for, where
        characters stand for themselves; ``added`` of the first piece's are not in it.

        Lengths take one byte: pieces of a vocabulary are short, and one of 255 bytes and
        more says so by 255.
        """
        ids: list[int] = []
        lengths: list[int] = []
        for piece in pieces:
            own = self.ids_of(piece)
            ids += own
            size = len(piece.encode()) - 2 * piece.count(SPACE) - added
            added = 0
            if len(own) == 1:
                lengths.append(size if size < 255 else 255)
            elif len(own) == size:
                lengths += [1] * size
            else:
                lengths += [0] * (len(own) - 1) + [min(size, 255)]
        return ids, bytes(lengths)

    def units_of(self, text: str) -> tuple[str, list[tuple]]:
        """The first unit of a text and what is known of every one."""
        normal, _ = self.normalize(text)
        get, known = self.units.get, self.known
        words = self.unit.findall(normal)
        return words[0] if words else "", [get(u) or known(u) for u in words]

    def piece_lengths(self, text: str, first: str, units: list[tuple]) -> np.ndarray:
        """The lengths of the spans of a text's ids: they follow one another from byte 0."""
        data = None
        if not (self.map or self.model.squeeze or SPACE in text):
            parts = [u[3] for u in units]
            if parts and self.model.dummy_prefix:
                _, parts[0] = self.spelled(self.pieces_of(first), added=1)
            data = b"".join(parts)
        if data is None or b"\xff" in data:
            return np.array([p.end - p.begin for p in self.encode_spans(text)], np.uint32)
        return np.frombuffer(data, np.uint8)

    # whole texts -------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        normal, _ = self.normalize(text)
        get, found = self.unit_ids.get, self.ids_of_unit
        return [i for u in self.unit.findall(normal) for i in get(u) or found(u)]

    def encode_spans(self, text: str) -> list[Piece]:
        """Ids with the bytes of the original each stands for.

        The spans follow one another and cover the text. The added space has no bytes of
        its own; of the bytes of a character spelled byte by byte, each has its own.
        """
        normal, at = self.normalize(text)
        if at is None:  # each character stands for itself, after the added space
            at = [0] * (1 + self.model.dummy_prefix)
            for c in text:
                at.append(at[-1] + len(c.encode()))
        found, char = [], 0
        for unit in self.unit.findall(normal):
            for piece in self.pieces_of(unit):
                ids = self.ids_of(piece)
                begin, end = at[char], at[char + len(piece)]
                char += len(piece)
                if len(ids) > 1 and end - begin == len(ids):
                    found += [Piece(i, begin + k, begin + k + 1) for k, i in enumerate(ids)]
                else:
                    found += [Piece(i, begin, end if i is ids[-1] else begin) for i in ids]
        return found

    def decode(self, ids: list[int], bos: bool = True) -> str:
        """The text of ids: bytes joined, marks as spaces, the added space taken off."""
        out: list[str] = []
        run = bytearray()
        pieces, byte_of = self.model.pieces, self.byte_of
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(" ⁇ " if i == self.model.unknown else pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if bos and self.model.dummy_prefix and text.startswith(" ") else text


def encoded_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes_decoded, covered_bytes,
    spans_sha256) of each document.

    ``covered_bytes`` is how many bytes of the original the spans of all ids cover, and
    ``spans_sha256`` the digest of their edges as 32-bit numbers: 0 and the end of each
    span, which is where the next one begins.
    """

    def make():
        encoder = encoder_of(model_path)
        model = encoder.model

        def work(texts):
            rows = []
            for text in texts:
                first, units = encoder.units_of(text)
                ids = ",".join([u[1] for u in units])
                decoded = "".join([u[2] for u in units])
                if model.dummy_prefix and decoded.startswith(" "):
                    decoded = decoded[1:]
                data = decoded.encode()
                lengths = encoder.piece_lengths(text, first, units)
                # each span begins where the one before it ends
                edges = np.zeros(len(lengths) + 1, "<u4")
                np.cumsum(lengths, out=edges[1:])
                rows.append(
                    (
                        len(lengths),
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(data).hexdigest(),
                        len(data),
                        int(edges[-1]),
                        hashlib.sha256(edges.tobytes()).hexdigest(),
                    )
                )
            return rows

        return work

    return map_rows(
        docs.select("doc_id", "text"),
        make,
        "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes_decoded long,"
        " covered_bytes long, spans_sha256 string",
    )


def document_spans(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): every piece with its bytes in the original text."""
    def make():
        encoder = encoder_of(model_path)

        def work(texts):
            found = [encoder.encode_spans(t) for t in texts]
            return [([p.id for p in f], [p.begin for p in f], [p.end for p in f]) for f in found]

        return work

    return map_rows(
        docs.select("doc_id", "text"), make, "ids array<int>, begins array<int>, ends array<int>"
    )


def document_ids(docs: DataFrame, model_path: str, *keep: str) -> DataFrame:
    """``keep`` columns, n_tokens and the ids of each document."""

    def make():
        encoder = encoder_of(model_path)

        def work(texts):
            return [(len(ids), ids) for ids in map(encoder.encode, texts)]

        return work

    return map_rows(docs.select(*keep, "text"), make, "n_tokens long, ids array<int>")
