"""SentencePiece encoding and decoding: batched Viterbi in numpy over a public vocabulary.

A text, with a space put before it, is cut before every run of spaces that follows another character and around every
newline; no piece crosses such a cut, so the best path of the text is that of its words. Distinct words of one length
advance together: at each end position, hashes of the substrings that end there probe the sorted keys of the pieces,
and the first of the largest sums is stored as a backpointer. A character outside the vocabulary becomes its bytes.

A vocabulary that was trained by merges holds ranks, not log probabilities; its pieces get -ln(rank + 10), as if their
frequencies followed Zipf's law. Ids are those of the best path under these scores, which can differ from those of the
merges' order. A vocabulary of the unigram kind keeps its own scores.

Contract on edge cases: a null or empty text has no ids and decodes to the empty text; U+2581, which stands for the
space in pieces, is encoded by its bytes, so that every text decodes to itself; a null id passes through; repeated rows
are encoded one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Stands for a U+2581 of the text itself.
LITERAL = 0x110000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r" *[^ \n]+| +|\n")
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffers message: (number, value)."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            n = varint() if wire == 2 else 8 if wire == 1 else 4
            yield number, data[at : at + n]
            at += n


class Vocabulary:
    """pieces and scores by id; byte_ids[b]: the id of byte b."""

    def __init__(self, text_of: list[str], scores: np.ndarray, kinds: list[int], unigram: bool):
        self.byte_ids = np.full(256, next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0), dtype=np.int32)
        self.raw: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(text_of, kinds, strict=True)):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
            self.raw.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(chr(SPACE), " ").encode() if kind == NORMAL else b"")
        ids = [i for i, k in enumerate(kinds) if k == NORMAL]
        if any(chr(SPACE) in text_of[i].lstrip(chr(SPACE)) or "\n" in text_of[i] for i in ids):
            raise ValueError("a piece holds a space or newline after another character")
        used = np.asarray(scores, dtype=np.float64)[ids]
        if not unigram:
            used = -np.log(np.maximum(-used, 0) + 10.0)
        self.longest = max(len(text_of[i]) for i in ids)
        code = np.zeros((len(ids), self.longest), dtype=np.uint32)
        key = np.zeros(len(ids), dtype=np.uint64)
        for row, i in enumerate(ids):
            points = [ord(c) for c in text_of[i]]
            code[row, : len(points)] = points
        with np.errstate(over="ignore"):
            for k in range(self.longest):
                key = np.where(code[:, k] > 0, key * FACTOR + code[:, k], key)
        order = np.argsort(key, kind="stable")
        self.keys, self.code = key[order], code[order]
        self.ids = np.asarray(ids, dtype=np.int32)[order]
        self.scores = used.astype(np.float32)[order]
        self.unknown = np.float32(used.astype(np.float32).min() - np.float32(10.0))
        self.lengths = [int(k) for k in np.unique((code > 0).sum(axis=1))]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        text_of, scores, kinds, unigram = [], [], [], True
        for number, value in fields(Path(path).read_bytes()):
            if number == 1:
                piece = dict(fields(value))
                text_of.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), dtype="<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
        return cls(text_of, np.asarray(scores), kinds, unigram)

    def best_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of each word's ids."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = np.zeros(len(words), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        blocks = []
        for group in np.split(order, cuts):
            n = sizes[group[0]] if len(group) else 0
            if n:
                most = max(1, 200_000 // int(n))
                blocks += [(int(n), group[a : a + most]) for a in range(0, len(group), most)]
        flats, rows = [], []
        for n, group in blocks:
            code = np.frombuffer("".join([words[i] for i in group]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(group), n)
            code = np.where(code == SPACE, np.uint32(LITERAL), np.where(code == 32, np.uint32(SPACE), code))
            flat, size = self._viterbi(code)
            flats.append(flat)
            rows.append(group)
            counts[group] = size
        if not flats:
            return np.zeros(0, dtype=np.int32), counts
        grouped, placed = np.concatenate(flats), np.concatenate(rows)
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        n = counts[placed]
        to = np.repeat(start[placed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = np.empty(len(grouped), dtype=np.int32)
        out[to] = grouped
        return out, counts

    def _viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = code.shape
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, m), dtype=np.uint64)
            for k in range(n):
                prefix[k + 1] = prefix[k] * FACTOR + code[:, k]
            power = [FACTOR ** np.uint64(k) for k in range(self.longest + 1)]
            best = np.full((n + 1, m), -np.inf, dtype=np.float32)
            best[0] = 0
            back = np.zeros((n + 1, m), dtype=np.int16)
            which = np.zeros((n + 1, m), dtype=np.int32)
            last = len(self.keys) - 1
            for end in range(1, n + 1):
                # the single character, known or not, then longer substrings: a longer one wins a tie, as it starts earlier
                for k in self.lengths:
                    if k > end:
                        break
                    key = prefix[end] - prefix[end - k] * power[k]
                    spot = np.minimum(np.searchsorted(self.keys, key), last)
                    hit = np.flatnonzero(self.keys[spot] == key)
                    if len(hit):
                        same = (self.code[spot[hit], :k] == code[hit, end - k : end]).all(axis=1)
                        if k < self.longest:
                            same &= self.code[spot[hit], k] == 0
                        hit = hit[same]
                    if k == 1:
                        best[end] = best[end - 1] + self.unknown
                        back[end], which[end] = 1, -1
                        best[end, hit] = best[end - 1, hit] + self.scores[spot[hit]]
                        which[end, hit] = self.ids[spot[hit]]
                    elif len(hit):
                        sums = best[end - k, hit] + self.scores[spot[hit]]
                        better = sums >= best[end, hit]
                        at = hit[better]
                        best[end, at], back[end, at], which[end, at] = sums[better], k, self.ids[spot[at]]
        out = np.full((m, n), -2, dtype=np.int32)
        at, row = np.full(m, n), np.arange(m)
        while len(row):
            end = at[row]
            got = which[end, row]
            out[row, end - 1] = got
            at[row] = end - back[end, row]
            row = row[at[row] > 0]
        size = (out != -2).sum(axis=1)
        flat = out[out != -2]
        if (flat == -1).any():
            parts, size = [], np.zeros(m, dtype=np.int64)
            for i in range(m):
                ids = []
                for j in np.flatnonzero(out[i] != -2):
                    if out[i, j] >= 0:
                        ids.append(out[i, j])
                    else:
                        c = int(code[i, j])
                        ids.extend(self.byte_ids[list(chr(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass"))])
                parts += ids
                size[i] = len(ids)
            flat = np.asarray(parts, dtype=np.int32)
        return flat, size

    def encode_batch(self, docs: list[str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each. memo keeps the paths of words between calls."""
        if len(memo.get("ids", ())) > 300_000:
            memo.clear()
        ids = memo.setdefault("ids", {})
        old = len(ids)
        lists = [[ids.setdefault(w, len(ids)) for w in WORD.findall(" " + t)] if t else [] for t in docs]
        flat, start, size = memo.get("paths", (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
        if len(ids) > old:
            more, counts = self.best_paths(list(ids)[old:])
            start = np.concatenate([start, len(flat) + np.cumsum(counts) - counts])
            flat, size = np.concatenate([flat, more]), np.concatenate([size, counts])
            memo["paths"] = (flat, start, size)
        used = np.fromiter((w for x in lists for w in x), dtype=np.int64)
        n = size[used]
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(start[used] - bounds[:-1], n) + np.arange(bounds[-1])]
        per_doc = np.diff(bounds[np.concatenate([[0], np.cumsum([len(x) for x in lists])])])
        return out, per_doc

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, ids (array<int>)."""
    vocabulary, kind = Vocabulary.load(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            docs = texts(batch.column(1))
            for a, b in pieces([len(t) for t in docs], 4 << 20):
                ids, n = vocabulary.encode_batch(docs[a:b], memo)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id, text. Null ids decode to the empty text."""
    vocabulary, kind = Vocabulary.load(model), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [vocabulary.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, type=pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), exact (decoding gives the text back)."""
    vocabulary, kind = Vocabulary.load(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        is_byte = np.zeros(len(vocabulary.raw), dtype=bool)
        is_byte[vocabulary.byte_ids] = True
        for batch in batches:
            docs = texts(batch.column(1))
            for a, b in pieces([len(t) for t in docs], 4 << 20):
                ids, n = vocabulary.encode_batch(docs[a:b], memo)
                bounds = np.concatenate([[0], np.cumsum(n)])
                parts = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [pa.array(n), pa.array([int(is_byte[p].sum()) for p in parts], type=pa.int64())]
                columns += [pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts], type=pa.string()), pa.array([vocabulary.decode(p) == t for p, t in zip(parts, docs[a:b], strict=True)], type=pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[id_col, "n_pieces", "n_byte_pieces", "ids_sha256", "exact"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pieces bigint, n_byte_pieces bigint, ids_sha256 string, exact boolean")
