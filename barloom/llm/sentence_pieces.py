"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

Normalisation replaces, from left to right, the longest prefix that the model's compiled character map
knows; other characters stay, bytes that are no UTF-8 become U+FFFD. White space is marked, joined or trimmed
as the model says. Every byte of the normalised text remembers the offset of the original bytes it came
from, and every piece is projected through these offsets to the byte span it stands for. Characters
without a piece become byte pieces; as in the public library, the last one carries the character's span, the ones before it
an empty one at its start.

Pieces are merged by score inside chunks: a text is cut wherever two neighbouring characters stand together in no piece of the model,
because no merge can cross such a place. A chunk that occurs again is looked up. Long chunks are merged with a heap, so that a
very long one costs n log n.

How it scales: a map over the texts. A task holds one text, its pieces and a bounded number of chunks. Every
worker opens the model by its path.

Null texts count as empty: begin and end ids only, empty spans, an empty decoded text. Very long texts are read whole. Repeated
rows, null ids and ties need nothing: each row is encoded by itself. Empty tables give empty results. Only doc_id and text are read.
Models of another kind than BPE with byte pieces, and models with user-defined symbols or with marks after words are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.ship import by_value
from barloom.llm.text import whole

by_value(__name__)

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MARK = SPACE.encode()
BAD = "�".encode()
#: kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: chunks remembered by a task, and the longest of them
HELD, SHORT = 1_000_000, 32


class CharacterMap:
    """A compiled character map: the size of a double array, its units, and the replacements one after
    another, each closed by a zero byte. An empty map replaces nothing."""

    def __init__(self, compiled: bytes):
        self.units, self.texts = (), b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
            self.texts = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of ``text`` from ``at``, 0 if none, and what replaces it."""
        units, length, value = self.units, 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                length, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return (length, self.texts[value : self.texts.index(b"\0", value)]) if length else (0, b"")


def character(text: bytes, at: int) -> int:
    """Length of the UTF-8 character at ``at``, 0 if the bytes there are none."""
    lead = text[at]
    n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    try:
        text[at : at + n].decode()
    except UnicodeDecodeError:
        return 0
    return n if at + n <= len(text) else 0


class Normaliser:
    def __init__(self, compiled: bytes = b"", prefix: bool = True, trim: bool = False, mark: bool = True):
        self.map, self.prefix, self.trim, self.space = CharacterMap(compiled), prefix, trim, MARK if mark else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the original offset of each of its bytes and of its end."""
        if not self.map and not self.trim:
            try:
                text.decode()
            except UnicodeDecodeError:
                pass
            else:
                return self._marked(text)
        return self._scanned(text)

    def _marked(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """No character is replaced: only spaces are marked."""
        if not text:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(text, np.uint8)
        offsets = np.arange(len(text) + 1)
        offsets[:-1][(data & 0xC0) == 0x80] = 0
        offsets = np.maximum.accumulate(offsets)  # inside a character, its start
        repeats = np.ones(len(text) + 1, np.int64)
        repeats[:-1][data == 32] = len(self.space)
        head = self.space if self.prefix else b""
        repeats[0] += len(head)
        return head + text.replace(b" ", self.space), np.repeat(offsets, repeats)

    def _piece(self, text: bytes, at: int) -> tuple[int, bytes]:
        if self.map:
            length, new = self.map.longest(text, at)
            if length:
                return length, new
        length = character(text, at)
        return (length, text[at : at + length]) if length else (1, BAD)

    def _scanned(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, out, offsets = 0, bytearray(), []
        if self.trim:
            while at < len(text):
                length, new = self._piece(text, at)
                if new != b" ":
                    break
                at += length
        if at == len(text):
            return b"", np.array([at if self.trim else 0], np.int64)
        if self.prefix:
            out += self.space
            offsets += [at] * len(self.space)
        after_space = self.trim
        while at < len(text):
            length, new = self._piece(text, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = new.endswith(b" ")
                new = new.replace(b" ", self.space)
                out += new
                offsets += [at] * len(new)
            after_space &= self.trim
            at += length
        if self.trim:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                at = offsets[len(out)]
                del offsets[len(out) :]
        return bytes(out), np.array([*offsets, at], np.int64)


class Chunks(dict):
    """Chunk to its ids, packed; computed when asked for the first time, from its parts where it has several."""

    def __init__(self, merge, pairs: set[str]):
        super().__init__()
        self.merge, self.pairs = merge, pairs

    def __missing__(self, chunk: str) -> bytes:
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.pairs]
        if cuts:
            ids = b"".join([self[chunk[a:b]] for a, b in zip([0, *cuts], [*cuts, len(chunk)])])
        else:
            ids = np.array(self.merge(chunk), "<u4").tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= HELD:
                self.clear()
            self[chunk] = ids
        return ids


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        how, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte pieces and without user-defined or unused symbols")
        if model.trainer_spec.treat_whitespace_as_suffix or not how.escape_whitespaces:
            raise ValueError("only models that mark the space before a word")
        self.normaliser = Normaliser(how.precompiled_charsmap, how.add_dummy_prefix, how.remove_extra_whitespaces)
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        place = {score: k for k, score in enumerate(sorted({model.pieces[i].score for i in self.id.values()}, reverse=True))}
        self.rank = {piece: place[model.pieces[i].score] for piece, i in self.id.items()}  # 0: merged first
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.value = np.full(len(kinds), -1, np.int16)  # of byte pieces
        for value, i in self.byte.items():
            self.value[i] = value
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.control = np.array([k == CONTROL for k in kinds])
        self.length = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.begin, self.end = (next(i for i, p in enumerate(model.pieces) if p.piece == name) for name in
                                (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.strip = how.add_dummy_prefix or how.remove_extra_whitespaces
        self.surface = [
            b"" if p.type == CONTROL else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN
            else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces
        ]
        pairs = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        apart = not any(p[1] == SPACE != p[0] for p in pairs)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)")
        self.known = Chunks(self.merge, pairs)

    # ---- encoding ----

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk: of all neighbours that form a piece, the best are merged first, the left one of equals."""
        ids = []
        for part in self._merged_short(chunk) if len(chunk) <= SHORT else self._merged_long(chunk):
            if part in self.id:
                ids.append(self.id[part])
            else:
                ids += [self.byte[b] for b in part.encode()]
        return ids

    def _merged_short(self, chunk: str) -> list[str]:
        """By looking through all pairs before each merge."""
        parts, rank, never = list(chunk), self.rank.get, len(self.rank)
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], never)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], never)
        return parts

    def _merged_long(self, chunk: str) -> list[str]:
        """With a heap of pairs."""
        rank, parts = self.rank, list(chunk)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[a + b], k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        heapq.heapify(heap)
        while heap:
            _, k, piece = heapq.heappop(heap)
            after = right[k]
            if not parts[k] or after >= len(parts) or parts[k] + parts[after] != piece:
                continue  # one of the two was merged with another
            parts[k], parts[after] = piece, ""
            right[k] = further = right[after]
            if further < len(parts):
                left[further] = k
                if (both := piece + parts[further]) in rank:
                    heapq.heappush(heap, (rank[both], k, both))
            if (before := left[k]) >= 0 and (both := parts[before] + piece) in rank:
                heapq.heappush(heap, (rank[both], before, both))
        return [part for part in parts if part]

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): with begin and end ids, whose spans are empty at the text's ends."""
        normal, offsets = self.normaliser(text)
        known = self.known
        ids = np.frombuffer(b"".join([known[c] for c in self.chunk.findall(normal.decode())]), "<u4")
        stops = np.cumsum(self.length[ids])
        starts = stops - self.length[ids]
        begins, ends = offsets[starts], offsets[stops]  # an inner byte of a character points to its start
        edge = lambda a, left, right: np.concatenate([[left], a, [right]])
        return edge(ids, self.begin, self.end).astype("<u4"), edge(begins, 0, len(text)), edge(ends, 0, len(text))

    # ---- decoding ----

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; bytes that form no character become U+FFFD."""
        parts = [self.surface[i] for i in ids.tolist()]
        said = np.flatnonzero(~self.control[ids])
        if self.strip and len(said) and self.marked[ids[said[0]]]:
            parts[said[0]] = parts[said[0]][1:]
        raw = self.value[ids] >= 0
        if raw.any():
            # only runs of byte pieces can be broken, and each run stands for itself
            edges = np.flatnonzero(np.diff(np.concatenate([[False], raw, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                parts[a:b] = [mended(b"".join(parts[a:b])), *[b""] * (b - a - 1)]
        return b"".join(parts)


def mended(run: bytes) -> bytes:
    """Every byte that belongs to no character replaced by U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, at = bytearray(), 0
        while at < len(run):
            n = character(run, at)
            out += run[at : at + n] if n else BAD
            at += n or 1
        return bytes(out)


def path_of(model: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(model)


def encoder(model: str):
    def encoded(batches):
        codec = Codec(path_of(model))
        for batch in batches:
            for doc, body in zip(batch.column("doc_id"), batch.column("body")):
                parts = codec.encode(body.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()], pa.int64()), *(pa.array([p], pa.list_(pa.int64())) for p in parts)], ["doc_id", "ids", "begins", "ends"]
                )

    return encoded


def digester(model: str):
    def digested(batches):
        codec = Codec(path_of(model))
        for batch in batches:
            n, digests = [], ([], [], [])
            for body in batch.column("body"):
                ids, begins, ends = codec.encode(body.as_py())
                n.append(len(ids))
                spans = np.stack([begins, ends], axis=1).astype("<u8")
                for kept, data in zip(digests, (ids.tobytes(), codec.decode(ids), spans.tobytes())):
                    kept.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return digested


def decoder(model: str):
    def decoded(batches):
        codec = Codec(path_of(model))
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decoded


def bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("body"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, begins, ends: a document's ids with begin and end ids, and the span of original UTF-8
    bytes of each."""
    return bodies(docs).mapInArrow(encoder(model), "doc_id long, ids array<bigint>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(decoder(model), "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids (32 bits each), of the text decoded from
    them and of its spans (begin and end, 64 bits each, little-endian)."""
    return bodies(docs).mapInArrow(
        digester(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    )
