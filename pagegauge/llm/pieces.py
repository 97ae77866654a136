"""SentencePiece encoding and decoding over a prefix table.

The model merges the best-scored adjacent pair whose joint text is a piece. For such merge-type vocabularies every
prefix of a text has one last token: the piece that ends there, starts where a shorter prefix ends, and stays apart
from that prefix's last token when both are merged together. An automaton finds the pieces that end at each character, pair
tests (remembered) choose among them, and the ids are read backwards through the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, memory, slices, small_batches, with_fields

SPACE = "▁"
#: Words that a worker remembers in either of two generations: what is met again moves to the young one, and when that is
#: full the old one goes. Bounds memory, changes no result.
REMEMBERED = 200_000
#: Pairs of tokens that a worker remembers before it starts anew (some 50 bytes each); changes no result.
REMEMBERED_PAIRS = 300_000
#: Bytes of text that are encoded and handed over at a time (one text at least).
SLICE = 1 << 20
#: Longer words are encoded without being remembered.
LONGEST_REMEMBERED = 48
#: The worker's last encoder by the id of its vocabulary's broadcast: later tasks of the worker use what it remembers.
_ready: dict[int, Encoder] = memory()


def read_vocabulary(path: str) -> dict:
    """Pieces of a merge-type model with byte fallback and no normalisation; refuses others."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "piece" for i in range(n)]
    words = {
        "pieces": [model.id_to_piece(i) for i in range(n)], "scores": [model.get_score(i) for i in range(n)],
        "kinds": kinds, "end": model.eos_id(),
    }
    if kinds.count("byte") != 256 or any(model.is_unused(i) for i in range(n)):
        raise ValueError("needs a model with byte fallback and without unused pieces")
    if model.decode(model.encode(" Ａ  b ")) != " Ａ  b ":
        raise ValueError("needs a model that leaves characters and spaces as they are")
    return words


class Encoder:
    def __init__(self, vocabulary: dict) -> None:
        pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.score = {p: s for p, s, k in zip(pieces, vocabulary["scores"], kinds) if k == "piece"}
        # Of a piece: its id as four bytes. Of an id: the bytes that it decodes to.
        self.token = {p: np.int32(i).tobytes() for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "piece"}
        self.raw = pa.array([
            p.replace(SPACE, " ").encode() if k == "piece" else bytes([int(p[1:-1], 16)]) if k == "byte" else b"" for p, k in zip(pieces, kinds)], pa.binary())
        self.byte_ids = {int(p[1:-1], 16): np.int32(i).tobytes() for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "byte"}
        self.end = vocabulary["end"]
        # Of a piece: the tokens that were seen before it, and whether the two stay apart. How many pairs there are.
        self.apart: list[dict[str, bool]] = []
        self.pairs = 0
        # Of a chunk: its ids as bytes of four each.
        self.known: dict[str, bytes] = {}
        self.known_before: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        # Every prefix has one last token: where no longer piece is it, it is the last character, which needs no match.
        for p in self.score:
            if len(p) > 1 and self.merged(p) == [p]:
                self.apart.append({})
                self.automaton.add_word(p, (p, len(p), self.apart[-1]))
        self.automaton.make_automaton()
        # A space inside a piece only ever stands at its front, so a text can be cut before each run of spaces.
        cut = all(SPACE not in p.lstrip(SPACE) for p in self.score)
        self.chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else "(?s:.+)")

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored adjacent pair, the leftmost of equals, until none is left. For pieces and pairs of them only."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stays_apart(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether the two stay apart, remembered among the pairs of the right one."""
        if self.pairs >= REMEMBERED_PAIRS:
            for own in self.apart:
                own.clear()
            self.pairs = 0
        self.pairs += 1
        known[left] = found = self.merged(left + right) == [left, right]
        return found

    def spelled(self, character: str) -> bytes:
        """The ids of the bytes of a character that is no piece."""
        return b"".join([self.byte_ids[b] for b in character.encode()])

    def encode_chunk(self, text: str) -> bytes:
        """The ids of a chunk as bytes of four each."""
        last: list[str] = [""] * len(text)
        for end, (piece, size, apart) in self.automaton.iter(text):
            if not last[end]:
                before = end - size
                if before >= 0:
                    left = last[before] or text[before]
                    stays = apart.get(left)
                    if stays is None:
                        stays = self.stays_apart(left, piece, apart)
                    if stays:
                        last[end] = piece
                else:
                    last[end] = piece
        out: list[bytes] = []
        i, token = len(text) - 1, self.token
        while i >= 0:
            piece = last[i] or text[i]
            out.append(token.get(piece) or self.spelled(piece))
            i -= len(piece)
        out.reverse()
        return b"".join(out)

    def chunk_result(self, chunk: str) -> bytes:
        """A chunk's ids, remembered from earlier texts if it is short."""
        got = self.known_before.get(chunk)
        if got is None:
            got = self.encode_chunk(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known, self.known_before = {}, self.known
            self.known[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes of four each, the end id last. Of an empty text the end id alone."""
        found = []
        if text:
            known = self.known
            for chunk in self.chunk.findall(SPACE + text.replace(" ", SPACE)):
                got = known.get(chunk)
                if got is None:
                    got = self.chunk_result(chunk)
                    known = self.known
                found.append(got)
        found.append(np.int32(self.end).tobytes())
        return b"".join(found)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """What the ids of several texts decode to, each text's from one end to the next: without the space put in front, bytes
        put together again."""
        raw = self.raw.take(pa.array(ids))
        at = np.frombuffer(raw.buffers()[1], np.int32)[ends].tolist()
        whole = raw.buffers()[2].to_pybytes() if at[-1] else b""
        return [whole[a + (whole[a:a + 1] == b" " and a < b):b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def encoder_of(number: int, sent: Broadcast) -> Encoder:
    """The worker's only encoder: that of this vocabulary, made by the first task that asks."""
    alone(_ready)
    if number not in _ready:
        _ready.clear()
        _ready[number] = Encoder(sent.value)
    return _ready[number]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add `ids` array<int> (the end id last) and `decoded` string to every row, computed from the whole text.

    A null or empty text gives the end id alone and an empty decoded text. Repeated rows give repeated results; an
    empty table gives an empty one. Columns of `docs` named ids or decoded are replaced. The vocabulary is sent to
    the executors (its size is that of the model file), so the file is needed on the driver only. No shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    sent_id = sent._jbroadcast.id()
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = with_fields(docs.select(*kept), "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent_id, sent)
        for batch in slices(batches, text, SLICE):
            done = [encoder.encode(x or "") for x in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *(len(i) // 4 for i in done)], dtype=np.int32)
            flat = np.frombuffer(b"".join(done), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, flat), pa.array(encoder.decode(flat, ends), pa.string())],
                names=[*kept, "ids", "decoded"],
            )

    return docs.select(*kept).mapInArrow(run, schema)


def token_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
