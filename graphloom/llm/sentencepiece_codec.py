"""SentencePiece encoding and decoding with source offsets.

Normalisation walks the text once: at every position the longest prefix known to the compiled
character map (a double-array trie over UTF-8 bytes) is replaced, all else is kept, and every
normalised byte remembers the source byte it came from. Byte-pair merges then run on the
normalised text, and each piece is projected back through that alignment to a span of source bytes.

Defined results: null and empty texts give no ids and decode to an empty text; repeated rows are
encoded alike; other columns are carried along, except that a column named like an output column is
replaced by it. Texts are never cut: a text without any space is merged with a heap in n log n.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts_of, unused

SPACE = "▁"
#: Kinds of pieces in the model file (fixed values of the public model format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Merged chunks that a task keeps; beyond that the older half goes.
MEMO = 300_000
#: Characters up to which chunks are merged together, one merge of each chunk a round.
SHORT = 64
#: Bytes of text whose chunks are looked up and merged together.
GATHER = 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of one protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


@dataclass(frozen=True)
class CharsMap:
    """A compiled character map: the trie's units and the replacement texts they point to."""

    units: tuple[int, ...] = ()
    texts: bytes = b""

    @classmethod
    def parse(cls, blob: bytes) -> CharsMap:
        if not blob:
            return cls()
        (size,) = struct.unpack_from("<I", blob)
        return cls(struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix of ``data[at:]``."""
        if not self.units:
            return None
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                start = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return best


@dataclass(frozen=True, eq=False)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    chars: CharsMap
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    ids: dict[str, int] = field(repr=False)
    bytes_at: dict[int, int] = field(repr=False)
    unknown: int
    fallback: bool
    unknown_surface: str = " ⁇ "
    #: No piece holds a space after another character, so merges never cross that border.
    splits: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds = [], [], []
        chars, flags, trainer = CharsMap(), {}, {}
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0])
                kinds.append(entry.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                flags = dict(_fields(value))
                chars = CharsMap.parse(flags.get(2, b""))
        if trainer.get(3, 1) != 2:
            raise ValueError("only byte-pair models are supported")
        if USER in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        mergeable = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, UNUSED)}
        return cls(
            tuple(pieces), tuple(scores), tuple(kinds), chars,
            bool(flags.get(3, 1)), bool(flags.get(4, 1)), bool(flags.get(5, 1)), mergeable,
            {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE},
            kinds.index(UNKNOWN), bool(trainer.get(35, 0)), trainer.get(44, " ⁇ ".encode()).decode(),
            not any(SPACE in p.lstrip(SPACE) for p in mergeable),
        )

    def normalise(self, source: bytes) -> tuple[bytes, np.ndarray | None]:
        """Normalised UTF-8 and, per byte and once more for the end, the source offset (None: identity)."""
        if not self.chars.units and not self.squeeze:
            return source, None
        out, align, i = bytearray(), [], 0
        while i < len(source):
            found = self.chars.longest(source, i)
            if found is None:
                lead = source[i]
                width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (width, source[i : i + width])
            out += found[1]
            align += [i] * len(found[1])
            i += found[0]
        align.append(len(source))
        if self.squeeze:
            keep, before = [], True
            for k, byte in enumerate(out):
                if byte != 32 or not before:
                    keep.append(k)
                before = byte == 32
            if keep and out[keep[-1]] == 32:
                keep.pop()
            align = [align[k] for k in keep] + [align[keep[-1] + 1] if keep else len(source)]
            out = bytearray(out[k] for k in keep)
        return bytes(out), np.asarray(align, dtype=np.int64)

    def merge(self, text: str) -> list[tuple[int, int]]:
        """(id, bytes of the normalised text) of each token of one chunk, by best-score-first merges."""
        return self._tokens(self._merged_long(text))

    def merge_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many chunks after all merges, one behind another, and how many each chunk has.

        A round merges in every chunk the best pair, of equal ones the leftmost, until none is left. A
        symbol is a piece's id, or, of characters that are no piece, the code point above all ids.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbol = self.of_characters[code]
        owner = np.repeat(np.arange(len(chunks)), sizes)
        rank, merged = self._joined(symbol[:-1], symbol[1:])
        none = len(self.pieces)
        rank, merged = np.append(rank, none), np.append(merged, 0)
        rank[np.cumsum(sizes) - 1] = none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts = np.diff(np.append(edge, len(owner)))
            least = np.minimum.reduceat(rank, edge)
            if (ready := least == none).any():
                mask = np.repeat(ready, counts)
                done.append((owner[mask], symbol[mask]))
                owner, symbol, rank, merged = (x[~mask] for x in (owner, symbol, rank, merged))
                if not len(symbol):
                    break
                least, counts = least[~ready], counts[~ready]
            hits = np.flatnonzero(rank == np.repeat(least, counts))
            own = owner[hits]
            at = hits[np.concatenate([[True], own[1:] != own[:-1]])]
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the right halves are gone
            owner, symbol, rank, merged = (x[keep] for x in (owner, symbol, rank, merged))
            behind = at[(at + 1 < len(owner)) & (owner[np.minimum(at + 1, len(owner) - 1)] == owner[at])]
            before = at[(at > 0) & (owner[at - 1] == owner[at])]
            rank[at] = none
            rank[behind], merged[behind] = self._joined(symbol[behind], symbol[behind + 1])
            rank[before - 1], merged[before - 1] = self._joined(symbol[before - 1], symbol[before])
        owner, symbol = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(chunks))

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two symbols make; the number of pieces stands for none."""
        keys, ranks, ids = self.pairs
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], len(self.pieces)), ids[at]

    @functools.cached_property
    def of_characters(self) -> np.ndarray:
        """The symbol of each code point."""
        out = np.arange(0x110000, dtype=np.int64) + len(self.pieces)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                out[ord(piece)] = i
        return out

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of symbols that make a piece: sorted keys, ranks, ids."""

        def symbol(part: str) -> int | None:
            return self.ids.get(part, len(self.pieces) + ord(part) if len(part) == 1 else None)

        rows = [(a << 32 | b, self.ranks[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        keys, ranks, ids = np.array(rows or [(-1, 0, 0)], np.int64).T
        order = np.argsort(keys)
        return keys[order], ranks[order], ids[order]

    def _merged_long(self, text: str) -> list[str]:
        """Merged symbols of a chunk of any length, with a heap in n log n."""
        symbols = list(text)
        ids, scores = self.ids, self.scores
        after = list(range(1, len(symbols))) + [-1]
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            if pair in ids:
                heapq.heappush(queue, (-scores[ids[pair]], left, right, pair))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, pair = heapq.heappop(queue)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [x for x in symbols if x]

    def _tokens(self, symbols: list[str]) -> list[tuple[int, int]]:
        ids = self.ids
        out: list[tuple[int, int]] = []
        for symbol in symbols:
            raw = symbol.encode()
            if symbol in ids:
                out.append((ids[symbol], len(raw)))
            elif self.fallback:
                out += [(self.byte_ids[b], 1) for b in raw]
            elif out and out[-1][0] == self.unknown:
                out[-1] = (self.unknown, out[-1][1] + len(raw))
            else:
                out.append((self.unknown, len(raw)))
        return out

    @functools.cached_property
    def neighbours(self) -> set[tuple[str, str]]:
        """Characters that stand side by side in some piece."""
        return {pair for piece in self.ids for pair in zip(piece, piece[1:])}

    @functools.cached_property
    def ranks(self) -> dict[str, int]:
        """Order of merging: pieces of higher score first, equal scores alike."""
        order = {score: i for i, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        return {piece: order[self.scores[i]] for piece, i in self.ids.items()}

    @functools.cached_property
    def byte_ids(self) -> dict[int, int]:
        return {b: i for i, b in self.bytes_at.items()}

    def decode(self, ids: list[int]) -> str:
        """The library's decoding: spaces restored, the dummy prefix dropped, bytes joined."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        if self.dummy_prefix and ids:
            skip = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
            if skip is not None and self.pieces[ids[skip]].startswith(SPACE):
                data = data[1:]
        return data.decode(errors="replace")

    @functools.cached_property
    def surfaces(self) -> list[bytes]:
        return [
            bytes([self.bytes_at[i]]) if k == BYTE else b"" if k == CONTROL else self.unknown_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
        ]


class Encoder:
    """Encodes texts of a task, remembering how chunks between spaces were merged.

    A chunk's tokens are kept as 64-bit integers: the id and, above it, the length in the normalised text.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.memo: dict[str, bytes] = {}
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if model.splits else re.compile(r"(?s).+")
        self.decimals = [str(i) for i in range(len(model.pieces))]
        self.packed = np.array([i | len(p.encode()) << 32 for i, p in enumerate(model.pieces)], np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Merge chunks that the memo does not hold."""
        model, memo = self.model, self.memo
        short = [c for c in chunks if len(c) <= SHORT]
        if short:
            symbols, counts = model.merge_all(short)
            known = symbols < len(model.pieces)
            flat = self.packed[np.where(known, symbols, 0)].tobytes()
            ends = np.cumsum(counts)
            high = (8 * ends).tolist()
            memo.update(zip(short, [flat[a:b] for a, b in zip([0, *high], high)], strict=True))
            for i in np.flatnonzero(~np.logical_and.reduceat(known, ends - counts)).tolist():
                memo[short[i]] = self._spelled([model.pieces[x] if x < len(model.pieces) else chr(x - len(model.pieces)) for x in symbols[ends[i] - counts[i] : ends[i]].tolist()])
        for chunk in chunks:
            if len(chunk) > SHORT:
                memo[chunk] = self._long(chunk)

    def _spelled(self, symbols: list[str]) -> bytes:
        return np.array([i | n << 32 for i, n in self.model._tokens(symbols)], np.int64).tobytes()

    def _long(self, chunk: str) -> bytes:
        """A long chunk; parts between characters that no piece joins are merged alone."""
        joined = self.model.neighbours
        cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:]), 1) if pair not in joined]
        if not cuts or not self.model.fallback:
            return self._spelled(self.model._merged_long(chunk))
        parts = [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        self.learn([p for p in dict.fromkeys(parts) if p not in self.memo])
        return b"".join([self.memo[p] for p in parts])

    def tokens(self, sources: list[bytes]) -> Iterator[tuple[bytes, np.ndarray | None, np.ndarray, np.ndarray]]:
        """Of each text: normalised bytes, their alignment, and the ids and lengths of its tokens."""
        model, memo = self.model, self.memo
        at = 0
        while at < len(sources):
            if len(memo) > MEMO:
                for old in list(itertools.islice(memo, len(memo) // 2)):
                    del memo[old]
            cut, low, size = [], at, 0
            while at < len(sources) and (size == 0 or size + len(sources[at]) <= GATHER):
                flat, align = model.normalise(sources[at])
                text = flat.decode()
                if model.escape:
                    text = text.replace(" ", SPACE)
                if model.dummy_prefix and flat:
                    text = SPACE + text
                cut.append((flat, align, self.chunk.findall(text)))
                size += len(sources[at])
                at += 1
            self.learn([c for c in dict.fromkeys(itertools.chain.from_iterable(found for _, _, found in cut)) if c not in memo])
            for flat, align, found in cut:
                own = np.frombuffer(b"".join([memo[c] for c in found]), np.int64)
                yield flat, align, own.astype(np.int32), own >> 32

    def spans(self, flat: bytes, align: np.ndarray | None, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The begin and end of each token in the bytes of the source."""
        model = self.model
        if not flat:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        # Tokens lie in the escaped text: mark where each normalised byte begins there, and count marks.
        wide, lead = len(SPACE.encode()) if model.escape else 1, len(SPACE.encode()) if model.dummy_prefix else 0
        widths = np.where(np.frombuffer(flat, np.uint8) == 32, wide, 1)
        ends = np.cumsum(widths)
        marks = np.zeros(lead + int(ends[-1]) + 1, np.int8)
        marks[lead + ends - widths + 1] = 1
        stops = np.cumsum(marks, dtype=np.int32)[np.cumsum(lengths)]
        begins = np.concatenate([np.zeros(1, np.int32), stops[:-1]])
        if align is not None:
            begins, stops = align[begins].astype(np.int32), align[stops].astype(np.int32)
        return begins, stops

    def encode(self, source: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and the begin and end of each token in the bytes of ``source``."""
        ((flat, align, ids, lengths),) = self.tokens([source])
        return ids.tolist(), *self.spans(flat, align, lengths)


ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("begins", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("ends", T.ArrayType(T.IntegerType(), False), False),
])


@functools.lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model.parse(data)


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Add ``ids``, ``begins`` and ``ends``: tokens of ``text`` and the source bytes that each covers.

    ``model`` is the content of a public model file (half a megabyte, so it travels with the task).
    ``keep`` names the columns carried along (default: all). Without ``spans`` both lists are empty.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "begins", "ends")]
    source = docs.select(*kept, docs[text].cast("string").alias(unused(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_model(model))
        for batch in batches:
            offsets, ids, begins, ends = [0], [], [], []
            for flat, align, own, lengths in encoder.tokens(texts_of(batch.column(batch.num_columns - 1))):
                ids.append(own)
                offsets.append(offsets[-1] + len(own))
                if spans:
                    begin, end = encoder.spans(flat, align, lengths)
                    begins.append(begin)
                    ends.append(end)
            lists = [pa.ListArray.from_arrays(pa.array(offsets if x else [0] * len(offsets), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + lists, names=[*kept, "ids", "begins", "ends"])

    schema = T.StructType(source.schema.fields[:-1] + ENCODED.fields)
    return source.mapInArrow(run, schema)


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row's tokens: their number, and digests of ids, decoded text and spans, in one pass.

    (key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256, covered_bytes: where
    the last span ends, spans_sha256 of begins and then ends as little-endian 32-bit integers.)
    """
    source = docs.select(docs[key].alias(key), docs[text].cast("string").alias(unused([key])))
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "spans_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        encoder, sha = Encoder(own), hashlib.sha256
        for batch in batches:
            rows = []
            for flat, align, ids, lengths in encoder.tokens(texts_of(batch.column(1))):
                begins, ends = encoder.spans(flat, align, lengths)
                listed = ids.tolist()
                decimal = ",".join(map(encoder.decimals.__getitem__, listed))
                rows.append((len(ends), sha(decimal.encode()).hexdigest(), sha(own.decode(listed).encode()).hexdigest(), int(ends[-1]) if len(ends) else 0, sha(begins.tobytes() + ends.tobytes()).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    kinds = ("long", "string", "string", "int", "string")
    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema[0].dataType), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names[1:], kinds, strict=True))]))


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for (null ids: an empty text)."""
    schema = _with(encoded.schema, T.StructField(into, T.StringType(), False))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(model)
        for batch in batches:
            lists = batch.column(ids)
            flat, at = lists.flatten().to_numpy().tolist(), lists.value_lengths().fill_null(0).to_pylist()
            texts, i = [], 0
            for n in at:
                texts.append(own.decode(flat[i : i + n]))
                i += n
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, into])

    return encoded.mapInArrow(run, schema)
