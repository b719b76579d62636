"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

The normaliser walks the text by the longest prefix found in the model's compiled character
map and records, for each byte it writes, the source byte it came from. The library
merges the pieces of each distinct segment of that normal form, and every piece is projected
through the alignment to a span of bytes of the original text.

Defined results: a null text encodes as the empty text; the empty text has no ids; repeated
rows give repeated results; no text is cut. A text of any length is encoded in one task, in
memory proportional to that text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct segments remembered per Python worker; the memory is emptied when full.
REMEMBERED = 1_000_000


class CharacterMap:
    """A model's compiled character map: a double-array trie and the replacement texts."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that `data` has at a position."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                place = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[place:self.texts.index(0, place)])
        return found


class PieceModel:
    """A BPE piece model read from its file, with its normaliser."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        model.ParseFromString(proto)
        rules, kinds = model.normalizer_spec, schema.ModelProto.SentencePiece
        if model.trainer_spec.model_type != schema.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        if model.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces:
            raise ValueError("only models that mark spaces before words are supported")
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        blob = rules.precompiled_charsmap
        self.map = CharacterMap(blob) if len(blob) > 4 else None
        normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        byte_of = {i: bytes([int(p.piece[3:5], 16)]) for i, p in enumerate(model.pieces)
                   if p.type == kinds.BYTE}
        self.size = np.array([1 if i in byte_of else len(p.piece.encode())
                              for i, p in enumerate(model.pieces)], dtype=np.int64)
        self.marks = np.array([p.piece.count(SPACE) for p in model.pieces], dtype=np.int64)
        self.digits = [str(i) for i in range(len(model.pieces))]
        unk_surface = model.trainer_spec.unk_surface.encode()
        self.shown = [byte_of.get(i) if p.type == kinds.BYTE else unk_surface
                      if p.type == kinds.UNKNOWN else b"" if p.type == kinds.CONTROL
                      else p.piece.replace(SPACE, " ").encode()
                      for i, p in enumerate(model.pieces)]
        # Where no piece has a space mark after another character, no merge crosses that place.
        split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if split else "(?s:.+)")
        self.known: dict[str, str] = {}
        # The library merges the pieces of normal segments; its own normaliser stays off.
        rules.Clear()
        rules.name, rules.add_dummy_prefix = "identity", False
        rules.remove_extra_whitespaces, rules.escape_whitespaces = False, True
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalize(self, text: str) -> tuple[str, array]:
        """The normal form, and per byte of it (and its end) the source byte offset."""
        data, out, place = text.encode("utf-8", "replace"), bytearray(), array("q")
        mark = SPACE.encode()
        at = 0
        before_space = self.squeeze  # leading spaces go, too
        if self.squeeze:
            while at < len(data):
                n, new = self._prefix(data, at)
                if new != b" ":
                    break
                at += n
        if self.prefix and at < len(data):
            out += mark
            place.extend([at] * 3)
        while at < len(data):
            n, new = self._prefix(data, at)
            if self.squeeze:
                while before_space and new.startswith(b" "):
                    new = new[1:]
            if new:
                written = new.replace(b" ", mark)
                out += written
                place.extend([at] * len(written))
                before_space = self.squeeze and new.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:]
                end = place[-3]
                del place[-3:]
                at = end
        place.append(at)
        return out.decode(), place

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at:at + n]

    def segment(self, normal: str) -> np.ndarray:
        """Ids of a normal text. Segments not remembered yet go to the library in one call.

        What is remembered is a string with one character per id: small, and quick to join.
        """
        segments, known = self.segments.findall(normal), self.known
        try:
            joined = "".join(map(known.__getitem__, segments))
        except KeyError:
            new = list({s for s in segments if s not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(segments))
            known.update(zip(new, ["".join(map(chr, ids)) for ids in
                                   self.library.encode(new, num_threads=1)]))
            joined = "".join(map(known.__getitem__, segments))
        return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def sizes(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normal text under each id."""
        if self.unknown not in ids:
            return self.size[ids]
        found = self.library.encode(self.segments.findall(normal), out_type="immutable_proto")
        return np.array([len(p.surface.encode()) for f in found for p in f.pieces])

    def encode(self, text: str | None) -> Encoded:
        if not text:
            return Encoded(self, np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64))
        if self.map is None and not self.squeeze and SPACE not in text:
            # The map is empty: every character is its own longest prefix, and only spaces
            # change. The alignment is then known from the pieces themselves.
            normal = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            ids = self.segment(normal)
            sizes = self.sizes(normal, ids) - 2 * self.marks[ids]
            if self.prefix:
                sizes[0] -= 1  # the mark put in front has no source
            return Encoded(self, ids, np.concatenate([[0], np.cumsum(sizes)]))
        normal, place = self.normalize(text)
        ids = self.segment(normal)
        bounds = np.concatenate([[0], np.cumsum(self.sizes(normal, ids), dtype=np.int64)])
        return Encoded(self, ids, np.frombuffer(place, dtype=np.int64)[bounds])

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, marks as spaces, the mark put in front taken off."""
        data = b"".join(map(self.shown.__getitem__, ids))
        if self.squeeze:
            data = data.lstrip(b" ")
        elif self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


class Encoded:
    """One text's ids, and the bounds of their spans in the source bytes."""

    def __init__(self, model: PieceModel, ids: np.ndarray, bounds: np.ndarray):
        self.model, self.ids, self.bounds = model, ids.tolist(), bounds

    def __len__(self) -> int:
        return len(self.ids)

    def ids_text(self) -> str:
        return ",".join(map(self.model.digits.__getitem__, self.ids))

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()))

    def decoded(self) -> str:
        return self.model.decode(self.ids)


def _model(proto: bytes) -> PieceModel:
    """The model of this worker. Task code travels by value, so the model and its memory of
    segments are kept beside the installed library, where the worker's next task finds them."""
    import sentencepiece

    key, loaded = hashlib.sha256(proto).digest(), getattr(sentencepiece, "_piece_model", None)
    if loaded is None or loaded[0] != key:
        loaded = sentencepiece._piece_model = (key, PieceModel(proto))
    return loaded[1]


#: Output columns by name: SQL type and value.
OUTPUTS = {
    "n_tokens": ("long", lambda e: len(e)),
    "ids": ("array<int>", lambda e: e.ids),
    "begins": ("array<long>", lambda e: e.bounds[:-1].tolist()),
    "ends": ("array<long>", lambda e: e.bounds[1:].tolist()),
    "decoded": ("string", lambda e: e.decoded()),
    "ids_sha256": ("string", lambda e: hashlib.sha256(e.ids_text().encode()).hexdigest()),
    "decoded_sha256": ("string", lambda e: hashlib.sha256(e.decoded().encode()).hexdigest()),
    "spans_sha256": ("string", lambda e: hashlib.sha256(
        e.bounds.astype("<i8").tobytes()).hexdigest()),
}
ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
         "array<long>": pa.list_(pa.int64())}


def read_model(path: str) -> bytes:
    """The model file (under 1 MB for the models meant here), read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded")) -> DataFrame:
    """One row per input row: the kept columns and the chosen outputs (see OUTPUTS).

    `begins` and `ends` are byte offsets in the UTF-8 form of the source text. Outputs must
    not share a name with a kept column. The model travels with the task code.
    """
    if clash := {k.lower() for k in keep} & {o.lower() for o in outputs}:
        raise ValueError(f"columns named twice: {sorted(clash)}")
    kept = [F.col(f"`{k}`") for k in keep]
    fields = [docs.schema[k].dataType.simpleString() for k in keep]
    schema = ", ".join([f"`{k}` {t}" for k, t in zip(keep, fields)]
                       + [f"`{o}` {OUTPUTS[o][0]}" for o in outputs])
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            done = [[] for _ in outputs]
            for value in batch.column(n):
                one = pieces.encode(value.as_py())
                for column, o in zip(done, outputs):
                    column.append(OUTPUTS[o][1](one))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)]
                + [pa.array(c, type=ARROW[OUTPUTS[o][0]]) for c, o in zip(done, outputs)],
                names=[*keep, *outputs])

    return docs.select(*kept, F.col(f"`{text}`")).mapInArrow(work, schema)
