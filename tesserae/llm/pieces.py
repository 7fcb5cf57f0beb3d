"""SentencePiece encoding and decoding by a streaming Viterbi search.

Of all ways to cut a text into pieces the one with the highest sum of piece scores is taken, the pieces, scores and
byte fall-back being those of a SentencePiece model file. This is the unigram search over that vocabulary; a
library that replays byte-pair merges from the same file may cut some words otherwise, and decodes to the same text.

A space is written as U+2581, one more is put in front, and a character that no piece covers becomes its UTF-8 bytes
(``<0x..>`` pieces). A U+2581 of the text itself also becomes bytes, so decoding gives every text back.

The search keeps scores for a window of boundaries no longer than the longest piece, and the back pointers that
survive. A boundary that the window has left and that no surviving path goes through is forgotten at once, with the
boundaries that only led to it; as soon as all surviving paths go through one next boundary, the piece before it is
final: its ids are committed and its pointers forgotten. Each boundary is counted in and out once, so time grows with
the text. Only where paths never meet (a long run of one character may be cut in as many phases as its longest piece has
characters) do back pointers, 24 bytes for each boundary, wait until the run ends.

When no piece has a space mark behind another character, all paths meet before a space mark. So texts are
searched run by run, and the ids that the search committed for a short run are remembered, in a store of bounded size, as it
would commit them again.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .rolling import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with id and score, the ids of the 256 byte pieces, and the id of the unknown piece."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown: int
    longest: int = 0
    unknown_score: float = 0.0
    marks_lead: bool = True
    texts: dict[int, bytes] = field(default_factory=dict)


def vocabulary(pieces: dict[str, tuple[int, float]], byte_ids: tuple[int, ...], unknown: int) -> Vocabulary:
    pieces = {p: v for p, v in pieces.items() if p}
    texts = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
    return Vocabulary(
        pieces,
        byte_ids,
        unknown,
        max(map(len, pieces), default=1),
        min((s for _, s in pieces.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY,
        not any(MARK in p.lstrip(MARK) for p in pieces),
        texts,
    )


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, own = {}, {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            own[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            normal[piece] = (i, model.get_score(i))
    return vocabulary(normal, tuple(own[b] for b in range(256)) if len(own) == 256 else (), model.unk_id())


_NOTHING = {}.get


class Encoder:
    """Encodes with one vocabulary; remembers runs in two generations of at most ``remembered`` entries each."""

    def __init__(self, vocab: Vocabulary, remembered: int = REMEMBERED):
        self.vocab, self.remembered = vocab, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        root: list = [{}, None, 0]  # what follows by character, and score and id of the piece that ends here
        for piece, (number, score) in vocab.pieces.items():
            node = root
            for c in piece:
                node = node[0].setdefault(c, [{}, None, 0])
            node[1:] = score, number

        def frozen(node: list) -> tuple:
            return ({c: frozen(x) for c, x in node[0].items()}.get if node[0] else _NOTHING, node[1], node[2])

        self.trie = frozen(root)  # nodes look up what follows by a bound method

    def fall_back(self, char: str) -> list[int]:
        return [self.vocab.byte_ids[b] for b in char.encode()] if self.vocab.byte_ids else [self.vocab.unknown]

    def search(self, marked: str, literal: frozenset[int] = frozenset()) -> array:
        """The ids of ``marked`` (spaces are marks already). ``literal``: places whose mark is the text's own."""
        follow, missing, lag, n = self.trie[0], self.vocab.unknown_score, self.vocab.longest, len(marked)
        out, size = array("i"), lag + 1
        scores = [-1e300] * size  # of boundaries, in a ring: those before i - lag are out of the window
        ring_from, ring_piece = [0] * size, [0] * size
        scores[0] = 0.0
        origin, ids = [-1], [-1]  # back pointers of boundaries from ``base`` on
        kids, heir = [], []  # how many surviving boundaries lead back to one, and the sum of their places
        base = done = 0  # all before done is committed

        for i in range(n + 1):
            slot = i % size
            if i:
                start = ring_from[slot]
                origin.append(start)
                ids.append(ring_piece[slot])
                if i == lag:  # from here on the window leaves boundaries behind
                    origin, ids = array("q", origin), array("i", ids)
                    kids, heir = array("i", [0] * size), array("q", [0] * size)
                    for b in range(1, size):
                        kids[origin[b]] += 1
                        heir[origin[b]] += b
                elif i > lag:
                    kids.append(0)
                    heir.append(0)
                    kids[start - base] += 1
                    heir[start - base] += i
                if i >= lag:
                    old = i - lag
                    if old > done and not kids[old - base]:  # the window has left it and nothing survives behind it
                        while old > done:
                            up = origin[old - base]
                            kids[up - base] -= 1
                            heir[up - base] -= old
                            if kids[up - base] or up > i - lag:
                                break
                            old = up
                    while done <= i - lag and kids[done - base] == 1:
                        after = heir[done - base]
                        piece = ids[after - base]
                        out.append(piece) if piece >= 0 else out.extend(self.fall_back(marked[done]))
                        done = after
                    if done - base > 4096 and 2 * (done - base) > len(origin):
                        for x in (origin, ids, kids, heir):
                            del x[: done - base]
                        base = done
            if i == n:
                break
            here = scores[slot]
            scores[slot] = -1e300
            node = follow(marked[i]) if not literal or i not in literal else None
            if node is None or node[1] is None:
                to = (i + 1) % size
                if here + missing > scores[to]:
                    scores[to], ring_from[to], ring_piece[to] = here + missing, i, -1
            j = i
            while node is not None:
                j += 1
                follows, score, number = node
                if score is not None:
                    to = j % size
                    score += here
                    if score > scores[to]:
                        scores[to] = score
                        ring_from[to] = i
                        ring_piece[to] = number
                if j == n or literal and j in literal:
                    break
                node = follows(marked[j])
        last, at = [], n
        while at > done:
            last.append(at)
            at = origin[at - base]
        for at in reversed(last):
            piece = ids[at - base]
            out.append(piece) if piece >= 0 else out.extend(self.fall_back(marked[origin[at - base]]))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; of an empty text none."""
        if not text:
            return b""
        if not self.vocab.marks_lead:
            own = frozenset(m.start() + 1 for m in re.finditer(MARK, text))
            return self.search(MARK + text.replace(" ", MARK), own).tobytes()
        runs = text.split(" ")
        if "" in runs:  # spaces side by side or at an end: they go with the run behind them
            joined, spaces = [], ""
            for run in runs:
                if run:
                    joined.append(spaces + run)
                    spaces = ""
                else:
                    spaces += " "
            runs, rest = joined, MARK * len(spaces)
        else:
            rest = ""
        found = list(map(self.young.get, runs))
        if None in found:
            found = [self._learn(run) if ids is None else ids for run, ids in zip(runs, found, strict=True)]
        if rest:
            found.append(self.search(rest).tobytes())
        return b"".join(found)

    def _learn(self, run: str) -> bytes:
        """The ids of a run (and spaces before it), remembered if it is short."""
        ids = self.young.get(run)
        if ids is None:
            ids = self.old.get(run)
        if ids is None:
            own = frozenset(m.start() + 1 for m in re.finditer(MARK, run)) if MARK in run else frozenset()
            ids = self.search(MARK + run.replace(" ", MARK), own).tobytes()
        if len(run) <= 64:
            if len(self.young) >= self.remembered:
                self.old, self.young = self.young, {}
            self.young[run] = ids
        return ids


class Decoder:
    """Joins the bytes of pieces by one gather for many documents."""

    def __init__(self, vocab: Vocabulary):
        top = max(vocab.texts, default=0) + 2
        known = [vocab.texts.get(i, b"\xef\xbf\xbd") for i in range(top)]
        self.size = np.array([len(x) for x in known])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.flat = np.frombuffer(b"".join(known), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ``ids[offsets[k]:offsets[k + 1]]`` without the space put in front; unknown ids give U+FFFD."""
        ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size) - 1, ids)
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])
        data = self.flat[place].tobytes()
        bounds = ends[offsets].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
        return [x[1:] if x.startswith(" ") else x for x in texts]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared, key: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
        gc.freeze()  # the trie lives as long as the worker: no collection walks it
    return _ENCODERS[key]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text. Null and empty texts have no ids; repeated rows are repeated.

    Row by row without a shuffle; an empty table gives none; other columns are not read. The vocabulary (one entry for
    each piece of the model file, whatever the data) is broadcast.
    """
    vocab = load(path)
    key = hashlib.sha256(repr(sorted(vocab.pieces.items())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, key)
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                found = [encoder.encode(x.as_py() or "") for x in batch.column(1)[a:b]]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], ids], ["doc_id", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids_sha256, n_ids, text`` of rows with ``ids``; null ids are read as none."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            a = 0
            while a < len(lists):  # about half a million ids at once
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 19), "right")) - 1)
                cuts = offsets[a : b + 1] - offsets[a]
                ids = values[offsets[a] : offsets[b]].astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([hashlib.sha256(ids[x:y].tobytes()).hexdigest() for x, y in zip(cuts, cuts[1:], strict=False)], pa.string()),
                        pa.array(np.diff(cuts), pa.int64()),
                        pa.array(decoder.decode(ids, cuts), pa.string()),
                    ],
                    ["doc_id", "ids_sha256", "n_ids", "text"],
                )
                a = b

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids_sha256 string, n_ids long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """``doc_id, n_ids, ids, ids_sha256, decoded_chars, decoded_sha256``: what ``encode_texts`` and ``decode_ids`` give, in one
    pass, so each task holds one vocabulary and one Python worker. Rows and edge cases are theirs."""
    vocab = load(path)
    key = hashlib.sha256(repr(sorted(vocab.pieces.items())).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, key)
        decoder = Decoder(encoder.vocab)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                found = [encoder.encode(x.as_py() or "") for x in batch.column(1)[a:b]]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                ids = np.frombuffer(b"".join(found), np.int32)
                texts = decoder.decode(ids, offsets)
                columns = {
                    "doc_id": batch.column(0)[a:b],
                    "n_ids": pa.array(np.diff(offsets), pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    "decoded_chars": pa.array([len(x) for x in texts], pa.int64()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, ids_sha256 string, decoded_chars long, decoded_sha256 string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded, and digests of the ids and of the text decoded from them."""
    return round_trip(table(spark, sf_dir, "documents")).drop("ids")
