"""Exact sub-word encoding by backtracking, and decoding.

The merges of a piece model are replaced by a search: at each place take the longest piece
(one Aho-Corasick pass finds the longest match of every start), accept it if the piece before it
and it stay apart when their joined text is merged again, otherwise try the next shorter piece,
and step back when none is left. A bitfield marks the places from which no encoding was found, so
none is tried twice. The result is the encoding the merges give, in time linear in the text.

Texts are cut at blanks and at letters outside the model, where no merge can cross; chunks repeat,
so each worker keeps a bounded memory of chunk encodings and puts texts together with array work.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm import batches

BLANK = "▁"
#: Chunks one worker remembers before it starts anew; bounds its memory, not the result.
REMEMBERED = 500_000


class _Memory(dict):
    """Chunk to its ordinal; encodes what it does not know."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, chunk):
        return self.codec.learn(chunk)


class Codec:
    """Encoder and decoder of one piece model (merge type)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model with byte fallback and identity normalisation is needed")
        if proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("a model that keeps blanks and adds a leading one is needed")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.names = [p.piece for p in proto.pieces]
        self.byte_ids = [0] * 256
        raw = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                raw.append(bytes([value]))
            else:
                raw.append(p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"")
        self.known = set("".join(self.ids))
        self.reachable = {p for p in self.ids if self.merged(p) == [p]}
        self._automaton()
        self.breaks = "\n" not in self.known
        self.cut = self._cuts()
        self.apart: dict[int, bool] = {}
        self.piece_start, self.piece_len, self.piece_bytes = batches.packed(raw)
        self.text_start, self.text_len, self.text_bytes = batches.packed([f"{i},".encode() for i in range(len(raw))])
        self._forget()

    def _cuts(self) -> re.Pattern:
        """Where texts are cut: no piece may lie across a cut, so no merge can."""
        n = "\n" if self.breaks else ""
        other = f"|{BLANK}+" + "|\n" * self.breaks
        fine = re.compile(rf"{BLANK}*[^\W\d_]+|{BLANK}*(?:[^{BLANK}{n}\w]+|[\d_]+)+" + other)  # letters apart from the rest
        if all(fine.fullmatch(p) for p in self.ids):
            return fine
        return re.compile(rf"{BLANK}*[^{BLANK}{n}]+" + other)

    def _automaton(self):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p in self.reachable:
            self.find.add_word(p, self.ids[p])
        self.find.make_automaton()
        self.size = [0] * len(self.names)
        self.shorter = [-1] * len(self.names)  # the next shorter piece with which a piece begins
        for p in self.reachable:
            self.size[self.ids[p]] = len(p)
            self.shorter[self.ids[p]] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reachable), -1)

    def _forget(self):
        self.memory = _Memory(self)
        self.pending: list[str] = []
        self.flat, self.starts, self.lens = array("i"), array("q"), array("q")

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging the best pair again and again; ties go to the left."""
        score = self.score
        if len(text) <= 24:
            parts = list(text)
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = score.get(parts[i] + parts[i + 1])
                    if found is not None and (best is None or found > best):
                        best, at = found, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return parts
        left = list(range(-1, len(text) - 1))
        right = list(range(1, len(text) + 1))
        part: list[str | None] = list(text)
        heap = [(-score[text[i:i + 2]], i, text[i:i + 2]) for i in range(len(text) - 1) if text[i:i + 2] in score]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(part) and (pair := part[a] + part[b]) in score:
                    heapq.heappush(heap, (-score[pair], a, pair))
        return [p for p in part if p is not None]

    def fits(self, before: int, after: int) -> bool:
        """Whether two neighbours stay as they are when their joined text is merged again."""
        if len(self.apart) >= REMEMBERED * 2:
            self.apart.clear()
        pair = [self.names[before], self.names[after]]
        self.apart[before << 32 | after] = apart = self.merged(pair[0] + pair[1]) == pair
        return apart

    def walk(self, longest: list[int], start: int, stop: int) -> list[int] | None:
        """Ids from one place to another, given the longest piece that begins at each place."""
        size, apart, shorter = self.size, self.apart, self.shorter
        open_ends = bytearray(b"\x01") * (stop - start + 1)
        out: list[int] = []
        at, piece = start, longest[start]
        while at < stop:
            last = out[-1] if out else -1
            while piece >= 0:
                if open_ends[at + size[piece] - start]:
                    if last < 0:
                        break
                    fits = apart.get(last << 32 | piece)
                    if fits is None:
                        fits = self.fits(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece < 0:
                if last < 0:
                    return None
                open_ends[at - start] = 0
                out.pop()
                at -= size[last]
                piece = shorter[last]  # if there is none, the loop steps back once more
                continue
            out.append(piece)
            at += size[piece]
            if at < stop:
                piece = longest[at]
        return out

    def chunks(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each chunk; letters outside the model become the ids of their bytes."""
        joined = "\0".join(texts)
        size = self.size
        longest = [-1] * (len(joined) + 1)
        for end, piece in self.find.iter(joined):  # of one start, longer pieces end later
            longest[end - size[piece] + 1] = piece
        start = 0
        for text in texts:
            stop = start + len(text)
            if not self.known.issuperset(text):
                yield self._foreign(text)
            elif text.startswith(BLANK * 2) or (found := self.walk(longest, start, stop)) is None:
                yield [self.ids[p] for p in self.merged(text)]  # runs of blanks tie, which only merging settles
            else:
                yield found
            start = stop + 1

    def _foreign(self, text: str) -> list[int]:
        parts = re.split(f"([^{re.escape(''.join(sorted(self.known & set(text))))}])", text) if self.known & set(text) else list(text)
        inside = iter(self.chunks([p for p in parts if p and self.known.issuperset(p)]))
        out: list[int] = []
        for p in filter(None, parts):
            out += next(inside) if self.known.issuperset(p) else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    def learn(self, chunk: str) -> int:
        self.memory[chunk] = k = len(self.memory)
        self.pending.append(chunk)
        return k

    def _settle(self):
        """Encode the chunks met since the last time."""
        for ids in self.chunks(self.pending):
            self.starts.append(len(self.flat))
            self.lens.append(len(ids))
            self.flat.extend(ids)
        self.pending.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text starts (one more at the end)."""
        if len(self.memory) > REMEMBERED or len(self.flat) > 16 * REMEMBERED:
            self._forget()
        parts, bounds = [], [0]
        for text in texts:
            if text:
                chunks = self.cut.findall(BLANK + text.replace(" ", BLANK))
                parts.append(np.fromiter(map(self.memory.__getitem__, chunks), np.int64, len(chunks)))
            bounds.append(bounds[-1] + (len(parts[-1]) if text else 0))
        if self.pending:
            self._settle()
        which = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        lens = np.frombuffer(self.lens, np.int64)[which]
        ids = batches.gather(np.frombuffer(self.flat, np.int32), np.frombuffer(self.starts, np.int64)[which], lens)
        return ids, np.concatenate([[0], np.cumsum(lens)])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as UTF-8."""
        lens = self.piece_len[ids]
        raw = batches.gather(self.piece_bytes, self.piece_start[ids], lens).tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[bounds]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a < b and raw[a] == 32:  # the blank put before every text
                a += 1
            out.append(raw[a:b])
        return [x if _whole(x) else x.decode("utf-8", "replace").encode() for x in out]

    def id_digests(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """SHA-256 of each run's ids in decimal, joined by commas."""
        lens = self.text_len[ids]
        raw = batches.gather(self.text_bytes, self.text_start[ids], lens).tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[bounds].tolist()
        return [hashlib.sha256(raw[a:b - 1] if b > a else b"").hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_CODECS: dict[str, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec per worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # the driver reads the model; workers get its bytes (half a MB)
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """Each row with the ids of its whole text, as the model's own library encodes it.

    A null text counts as an empty one, and an empty text has no ids. All other columns come
    back as they are, a column named like ``ids`` is replaced. Rows may repeat; no shuffle.
    """
    model = _model(docs, model_path)
    kept = [c for c in docs.columns if c != ids]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for part in batches.sliced(parts, text):
            flat, bounds = codec.encode(part.column(text).to_pylist())
            cells = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), cells], [*kept, ids])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, batches.schema_of(docs, kept, f"{ids} array<int>"))


def decode(encoded: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """Each row with the text its ids stand for; null ids count as none."""
    model = _model(encoded, model_path)
    kept = [c for c in encoded.columns if c != text]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for part in batches.sliced(parts, None):
            cells = part.column(ids)
            lens = np.array([0 if n is None else n for n in pa.compute.list_value_length(cells).to_pylist()], np.int64)
            flat = np.asarray(cells.flatten().fill_null(0), np.int64)
            texts = codec.decode(flat, np.concatenate([[0], np.cumsum(lens)]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*kept, text])

    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(run, batches.schema_of(encoded, kept, f"{text} string"))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Round trip of every text in one pass: number of ids, digest of the ids, digest of their text."""
    model = _model(docs, model_path)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for part in batches.sliced(parts, "text"):
            flat, bounds = codec.encode(part.column("text").to_pylist())
            decoded = [hashlib.sha256(x).hexdigest() for x in codec.decode(flat, bounds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(codec.id_digests(flat, bounds)), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, batches.schema_of(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
