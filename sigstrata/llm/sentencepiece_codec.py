"""SentencePiece encoding that keeps offsets, and decoding.

`Normaliser` applies a model's compiled character map: at each position the longest prefix found in its
double-array trie is replaced, and each normalised byte records the original byte it came from. A model
without a map keeps characters as they are. Then spaces become the meta symbol, one of which is put in
front, as the model's flags say. The normalised text is cut before each meta symbol that follows another
character; no piece of the model crosses such a cut (this is checked against the vocabulary), so a
segment encodes alike wherever it stands, and a worker keeps the ids of short segments it has met, bounded by
bytes. Every id projects to a span of original bytes; where the map replaces several bytes by several, a span that
starts inside the replacement starts where the replaced bytes do. Every text goes through normaliser, segments, ids
and spans, in the query too; what is decoded are the ids of a whole text, by the library.

Null text counts as empty: begin and end ids only. Repeated rows are encoded each; an empty table gives
an empty result.
"""

from __future__ import annotations

import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigstrata.llm.common import Cache, map_texts, row

META = "▁"
META_BYTES = META.encode()
MODEL = "piece_bpe_32k.model"


def _wire(data: bytes):
    """(field number, value) of a protocol-buffer message: ints for varints, bytes for the rest."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Normaliser:
    """The normaliser of a model file: field 3 of the model; in it 2 is the map, 3 to 5 are flags."""

    def __init__(self, model: bytes):
        spec = dict(_wire(next((v for k, v in _wire(model) if k == 3), b"")))
        blob = spec.get(2, b"")
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map at data[at:], and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        node = self._child(units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return best

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes before meta symbols, and for each of them (and the end) its original byte offset."""
        data = text.encode()
        if not self.units:
            out, source = data, np.arange(len(data) + 1, dtype=np.int64)
        else:
            parts, from_ = [], []
            at = 0
            while at < len(data):
                found = self.longest(data, at)
                if found:
                    length, new = found
                else:
                    length = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
                    new = data[at : at + length]
                parts.append(new)
                from_ += [at] * len(new)
                at += length
            out, source = b"".join(parts), np.array([*from_, len(data)], dtype=np.int64)
        if self.squeeze:
            keep = np.ones(len(out), dtype=bool)
            raw = np.frombuffer(out, dtype=np.uint8)
            space = raw == 32
            keep[1:] &= ~(space[1:] & space[:-1])
            full = np.flatnonzero(~space)
            keep[: full[0] if len(full) else len(out)] = False
            keep[full[-1] + 1 if len(full) else 0 :] = False
            out, source = raw[keep].tobytes(), np.append(source[:-1][keep], source[-1])
        return out, source


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.normaliser = Normaliser(f.read())
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.sp.get_piece_size()
        self.names = [self.sp.id_to_piece(i) for i in range(size)]
        if any(META in p.lstrip(META) for p in self.names) or not self.normaliser.dummy_prefix:
            raise ValueError("pieces of this model cross word starts: segments can't be encoded alone")
        #: original bytes of a piece in identity normalisation: a meta symbol is one space
        self.width = np.array([1 if self.sp.is_byte(i) else len(p.replace(META, " ").encode()) for i, p in enumerate(self.names)])
        self.known: Cache = Cache()  # ids of segments as little-endian 32-bit words
        self.alone = self.sp.piece_to_id(META)

    @staticmethod
    def segments(text: str) -> list[str]:
        """Segments of a text, each without its first meta symbol: the words between single spaces, and with
        runs of spaces the spaces beyond the first before the word they lead to."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        if run:
            out.append(" " * run + META)  # a run of spaces at the end; marked, as it has no word
        return out

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Ids of segments; those of short ones are kept."""
        self.known.room()
        short, long = self.known.split(segments)
        here: dict[str, bytes] = {}
        for new, keep in ((sorted(short), True), (sorted(long), False)):
            tails = [s.endswith(META) and not s.strip(" " + META) for s in new]
            texts = [s[:-1][1:] if t else s for s, t in zip(new, tails, strict=True)]
            for s, text, tail, ids in zip(new, texts, tails, self.sp.encode(texts, num_threads=1), strict=True):
                if tail and not text:
                    ids = [self.alone]
                made = np.array(ids, dtype="<u4").tobytes()
                if keep:
                    self.known.keep(s, made, len(made) + 50)
                else:
                    here[s] = made
        return here

    def prepare(self, text: str | None) -> tuple[list[str], tuple[bytes, np.ndarray]]:
        """Segments, and the normalised bytes they come from with their alignment: meta symbols in it count as spaces."""
        aligned = self.normaliser.apply(text or "")
        return self.segments(aligned[0].decode().replace(META, " ")) if text else [], aligned

    def ids(self, segments: list[str], here: dict[str, bytes]) -> bytes:
        """Ids with begin and end as little-endian 32-bit words; the segments are known or here."""
        known = self.known
        made = [here[s] if (found := known.get(s)) is None else found for s in segments]
        return struct.pack("<I", self.sp.bos_id()) + b"".join(made) + struct.pack("<I", self.sp.eos_id())

    def encode(self, segments: list[str], here: dict[str, bytes]) -> tuple[bytes, str]:
        """Ids as above, and the text they decode to."""
        raw = self.ids(segments, here)
        return raw, self.decode(np.frombuffer(raw, dtype="<u4"))

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())

    def spans(self, aligned: tuple[bytes, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in original bytes of each id but begin and end; the meta symbol put in front is empty."""
        norm, source = aligned
        if META_BYTES in norm:  # a meta symbol of the text stands for one space but takes three bytes
            wide = np.frombuffer(norm.decode().replace("\0", " ").replace(META, "\0").encode(), dtype=np.uint8) == 0
            source = source[np.concatenate([[0], np.cumsum(np.where(wide, 3, 1))])]
        stops = source[np.cumsum(self.width[ids]) - 1]
        return np.concatenate([[0], stops[:-1]]).astype(np.int64)[: len(stops)], stops


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: What encoding can give. ids hold begin and end; starts and ends are byte offsets of the original text, one for each id,
#: empty spans for begin and end; ids_le are the ids as little-endian unsigned 32-bit integers, spans_le start and end of each
#: id in turn, likewise.
FIELDS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "starts": T.ArrayType(T.IntegerType(), False),
    "ends": T.ArrayType(T.IntegerType(), False), "ids_le": T.BinaryType(), "spans_le": T.BinaryType(),
    "decoded": T.StringType(),
}


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def _encoding(path: str, fields: tuple[str, ...]):
    def run(texts: list) -> list:
        c = codec(path)
        made = [c.prepare(t) for t in texts]
        here = c.learn(set(chain.from_iterable(s for s, _ in made)))
        raw = [c.ids(s, here) for s, _ in made]
        ids = [np.frombuffer(x, dtype="<u4") for x in raw]
        out: dict[str, object] = {"n_tokens": [len(x) for x in ids], "ids_le": raw}
        if "ids" in fields:
            out["ids"] = _lists(ids)
        if "decoded" in fields:
            out["decoded"] = [c.decode(x) for x in ids]
        if not {"starts", "ends", "spans_le"}.isdisjoint(fields):
            spans = [c.spans(aligned, x[1:-1]) for (_, aligned), x in zip(made, ids, strict=True)]
            size = [len((t or "").encode()) for t in texts]
            starts = [np.concatenate([[0], a, [n]]) for (a, _), n in zip(spans, size, strict=True)]
            ends = [np.concatenate([[0], b, [n]]) for (_, b), n in zip(spans, size, strict=True)]
            if "starts" in fields or "ends" in fields:
                out["starts"], out["ends"] = _lists(starts), _lists(ends)
            if "spans_le" in fields:
                out["spans_le"] = [np.stack(x, axis=1).astype("<u4").tobytes() for x in zip(starts, ends, strict=True)]
        return [out[f] for f in fields]

    return run


def encoded(rows: DataFrame, path: str, fields: tuple[str, ...], column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """rows with fields of FIELDS of a text column."""
    return map_texts(rows, _encoding(path, fields), [T.StructField(f, FIELDS[f], False) for f in fields], column=column, keep=keep)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs as training reads them: their columns, n_tokens, ids, and the bytes each id stands for.

    A caller's column of such a name is left out.
    """
    made = encoded(row(docs), path, ("n_tokens", "ids", "starts", "ends"), "row.text")
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "ids", "starts", "ends")], "n_tokens", "ids", "starts", "ends")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids, of the decoded text, and of the ids' spans in the text's bytes."""
    made = encoded(docs.select("doc_id", "text"), path, ("n_tokens", "ids_le", "spans_le", "decoded"), keep=["doc_id"])
    return made.select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans_le", 256).alias("spans_sha256"),
    )
