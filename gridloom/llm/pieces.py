"""SentencePiece encoding and decoding by an Aho-Corasick driven dynamic programme.

An Aho-Corasick automaton over the pieces is stepped through the text once; at each position
its output links list every piece that ends there, and each may become the last piece of the
text up to that position.

* Unigram models: a link relaxes the best score there (Viterbi). Characters that no piece covers cost
  ``UNKNOWN`` below the least score and are spelled in byte pieces.
* BPE models (such as ``MODEL``): scores are only the order of merges, and the segmentation of greatest sum is not
  what merging gives. A link there holds if merging leaves it as it is next to the last piece before
  it; exactly one of the pieces that end at a position does, so the pass gives the ids of the model's own tokenizer.

A text falls into chunks wherever no piece of the vocabulary holds the bytes on both sides, as mostly between words and
at punctuation: neither scores nor merges reach across. Batches are cut into chunks as flat bytes; each distinct chunk is
encoded once and remembered in a table of bounded size, and ids are gathered from there.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat, free, settled, slices, span_hashes

MARK = "▁"
_MARK = MARK.encode()
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
#: Chunks that a task remembers (twice as many at most), the longest of them, and pairs of pieces.
REMEMBERED, REMEMBERED_BYTES, JOINS = 120_000, 64, 250_000
UNIGRAM, BPE = 1, 2
_WORST = -1e300


def _fields(raw: bytes):
    """(number, value) of the fields of a serialised message: integers, or bytes."""
    i = 0

    def number():
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else number()
            yield tag >> 3, raw[i:i + size]
            i += size


def model_type(model: bytes) -> int:
    """UNIGRAM or BPE; ValueError for other kinds, and for normalisers that change more than blanks."""
    kind, prefix, extra, rules = UNIGRAM, 1, 1, b""
    for name, value in _fields(model):
        if name == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif name == 3:
            spec = dict(_fields(value))
            rules, prefix, extra = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    if rules or extra or not prefix:
        raise ValueError("the model normalises texts, so they would not come back as they were")
    return kind


class Pieces:
    """Encoder and decoder for one model file's bytes."""

    def __init__(self, model: bytes, kind: int | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.kind = model_type(model) if kind is None else kind
        self.byte_ids = [-1] * 256
        self.texts: list[bytes] = [b""] * n
        self.byte_of: dict[int, int] = {}
        self.scores = [0.0] * n
        self.names: dict[str, int] = {}
        self.trie = ahocorasick.Automaton()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.byte_of[i] = i, b
                self.texts[i] = bytes((b,))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            self.texts[i] = piece.replace(MARK, " ").encode()
            self.scores[i] = sp.get_score(i)
            self.names[piece] = i
            self.trie.add_word(piece, (len(piece), i, self.scores[i]))
        self.trie.make_automaton()
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.strings = {i: p for p, i in self.names.items()}
        self.chars = [len(self.strings.get(i, "")) for i in range(n)]
        self.unknown = min(self.scores) - UNKNOWN
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        # Pairs of bytes that a piece, or a character, holds next to each other.
        self.inside = np.zeros(1 << 16, bool)
        self.inside.reshape(256, 256)[:, 0x80:0xC0] = True
        for i in self.strings:
            t = np.frombuffer(self.texts[i], np.uint8).astype(np.int32)
            self.inside[t[:-1] << 8 | t[1:]] = True
        self.joins: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        # Ids of chunks, as bytes: those met lately, and those met before them.
        self.memory: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}

    # ---- one chunk ---------------------------------------------------------

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk, its blanks written as marks."""
        last = self._best(text) if self.kind == UNIGRAM else self._merged(text)
        ids, at = [], len(text)
        while at:
            i = last[at]
            if i >= 0:
                ids.append(i)
                at -= self.chars[i]
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode()))
                at -= 1
        return ids[::-1]

    def _best(self, text: str) -> list[int]:
        """Last piece of each prefix in its best segmentation, -1 for a character in byte pieces. Ties go to the longest last piece."""
        n = len(text)
        best, last, length = [0.0] + [_WORST] * n, [-1] * (n + 1), [0] * (n + 1)
        done = 0

        def unknown_up_to(end):
            nonlocal done
            # Single characters, in byte pieces, up to the position the automaton has reached.
            while done < end:
                done += 1
                score = best[done - 1] + self.unknown
                if score > best[done]:
                    best[done], last[done], length[done] = score, -1, 1

        for end, (size, i, own) in self.trie.iter(text):
            end += 1
            if done < end:
                unknown_up_to(end)
            score = best[end - size] + own
            if score > best[end] or (score == best[end] and size > length[end]):
                best[end], last[end], length[end] = score, i, size
        unknown_up_to(n)
        return last

    def _merged(self, text: str) -> list[int]:
        """Last piece of each prefix as merging leaves it, -1 for a character that no piece covers."""
        last, joins = [-1] * (len(text) + 1), self.joins
        for end, (size, i, _) in self.trie.iter(text):
            if last[end + 1] < 0:
                before = last[end + 1 - size]
                stays = joins.get(before << 32 | i)
                if stays or (stays is None and self._stays(before, i)):
                    last[end + 1] = i
        return last

    def _stays(self, before: int, i: int) -> bool:
        """Whether merging the characters of both pieces leaves these two; merges never cross a character without piece (-1)."""
        left, right = self.strings[before] if before >= 0 else "", self.strings[i]
        stays = self.merge(left + right) == ([left, right] if left else [right])
        if len(self.joins) >= JOINS:
            self.joins.clear()
        self.joins[before << 32 | i] = stays
        return stays

    def merge(self, text: str) -> list[str]:
        """Merging as it is defined: of all neighbours that make a piece, those of the best score first, the leftmost on ties."""
        parts, names, scores = list(text), self.names, self.scores
        while len(parts) > 1:
            best, at = _WORST, -1
            for k in range(len(parts) - 1):
                i = names.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    # ---- texts -------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        """Piece ids of the whole text, after a blank in front. The mark itself in a text is spelled in bytes."""
        ids, _ = self.encode_all(pa.array([text], pa.large_string()))
        return ids.tolist()

    def _chunks(self, buf: np.ndarray, offsets: np.ndarray):
        """Starts and ends of the chunks of a slice: cut wherever no piece holds the bytes on both sides."""
        n = len(buf)
        first = np.zeros(n + 3, bool)
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        first[1:n] |= ~self.inside[buf[:-1].astype(np.int32) << 8 | buf[1:]]
        marks = np.flatnonzero((buf[:-2] == _MARK[0]) & (buf[1:-1] == _MARK[1]) & (buf[2:] == _MARK[2])) if n > 2 else np.zeros(0, np.int64)
        first[marks] = first[marks + 3] = True
        starts = np.flatnonzero(first[:n])
        return starts, np.append(starts[1:], n)

    def _remembered(self, chunk: bytes) -> bytes:
        new, old = self.memory
        got = new.get(chunk)
        if got is None:
            got = old.get(chunk)
            if got is None:
                ids = [self.byte_ids[b] for b in chunk] if chunk == _MARK else self.chunk(chunk.decode().replace(" ", MARK))
                got = np.array(ids, np.int32).tobytes()
            if len(chunk) <= REMEMBERED_BYTES:
                if len(new) >= REMEMBERED:
                    self.memory = new, old = {}, new
                new[chunk] = got
        return got

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column in a row, and n + 1 offsets; null counts as empty."""
        raw, at = flat(texts)
        n = len(at) - 1
        some = np.diff(at) > 0
        # A blank in front of each text that is not empty.
        front = np.concatenate([[0], np.cumsum(some)])
        offsets = at + front
        buf = np.full(int(offsets[-1]), 32, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[offsets[:-1][some]] = False
        buf[inside] = raw
        out, sizes = [], np.zeros(n, np.int64)
        for i, j in slices(offsets):
            own = offsets[i:j + 1] - offsets[i]
            part = buf[offsets[i]:offsets[j]]
            if not len(part):
                continue
            starts, ends = self._chunks(part, own)
            _, index, inverse = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
            text = part.tobytes()
            found = [self._remembered(text[a:b]) for a, b in zip(starts[index].tolist(), ends[index].tolist())]
            size = np.array([len(x) // 4 for x in found], np.int64)
            begin, size = (np.cumsum(size) - size)[inverse], size[inverse]
            out.append(np.frombuffer(b"".join(found), np.int32)[_gather(begin, size)])
            np.add.at(sizes, np.searchsorted(own, starts, "right") - 1 + i, size)
        return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids) -> str:
        out = self.spell(np.array(ids, np.int64)).tobytes()
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of pieces, one after another."""
        return self.bytes[_gather(self.at[ids], self.size[ids])]

    def comes_back(self, texts, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether decoding gives each text back."""
        raw, at = flat(texts)
        size = np.concatenate([[0], np.cumsum(self.size[ids])])[offsets]
        same = np.zeros(len(at) - 1, bool)
        for i, j in slices(at):
            said, own, low = self.spell(ids[offsets[i]:offsets[j]]), raw[at[i]:at[j]], size[i]
            for k in range(i, j):
                a, b = size[k] - low, size[k + 1] - low
                a += int(a < b and said[a] == 32)
                same[k] = b - a == at[k + 1] - at[k] and np.array_equal(said[a:b], own[at[k] - at[i]:at[k + 1] - at[i]])
        return same


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``begin``, one after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def _loaded(digest: str, model: bytes) -> Pieces:
    return Pieces(model)


def load_model(path: str = MODEL) -> bytes:
    """The model file's bytes, read where the job is planned and sent along with it."""
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("a model of more than 64 MB is not sent to every task")
    return data


@settled
def _encode(batches, shared, column, digests):
    model = shared.value
    pieces = _loaded(hashlib.sha256(model).hexdigest(), model)
    pieces.forget()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            texts = part.column("text")
            ids, at = pieces.encode_all(texts)
            if digests:
                raw, back = ids.astype("<i4", copy=False), pieces.comes_back(texts, ids, at)
                shas = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
                columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(shas, pa.string()), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids), mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, column])
    pieces.forget()


@settled
def _decode(batches, shared, ids, column):
    model = shared.value
    pieces = _loaded(hashlib.sha256(model).hexdigest(), model)
    for batch in batches:
        got = [None if x is None else pieces.decode(x) for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, column])


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encoded(docs: DataFrame, model: str = MODEL, column: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text; null for a null text, none for an empty one.

    A ``column`` that is there already gets an underscore behind the new one's name.
    """
    column = free(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))
    return docs.mapInArrow(partial(_encode, shared=shared, column=column, digests=False), f"{_schema(docs)}, `{column}` array<int>")


def decoded(df: DataFrame, ids: str = "piece_ids", model: str = MODEL, column: str = "decoded") -> DataFrame:
    """``df`` with the text that each array of piece ids spells; null for null."""
    column = free(df, column)
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))
    return df.mapInArrow(partial(_decode, shared=shared, ids=ids, column=column), f"{_schema(df)}, `{column}` string")


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip.

    round_trip says whether decoding gives the text back. Null and empty texts have no pieces. Repeated rows give a
    row each; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))
    return docs.mapInArrow(partial(_encode, shared=shared, column="", digests=True), "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean")
