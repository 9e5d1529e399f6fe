"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of pre-tokens form doubly linked lists. Every adjacent pair that has
a merge rank waits in the bucket of that rank, as the list position of its left
symbol. A bitmap over the ranks says which buckets hold something, and a smaller
bitmap says which words of the first are not zero: find-first-set in the small
one and then in one word gives the lowest rank in two steps, however long the
pre-tokens are. A position whose pair has changed since it was queued is stale
and skipped when it comes up. Within a bucket positions go from left to right, as
the rank files' own library merges; a merge that makes a pair of a rank no higher
puts the rest of its bucket back, so that the new pair comes first.

Pre-tokens that a worker hasn't met share a queue by the thousand: their lists
don't touch, so the lowest rank of all is also the lowest of its own list.

Edge cases: null and empty texts have no ids; a text of any length is encoded
whole; repeated rows are encoded alike; extra columns pass by untouched.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import local_file, small_batches, with_columns_of, worker_cache

#: Unicode's White_Space, which the split pattern's \s means. Before a run of these that
#: follows another character every match of the pattern ends, so a text can be cut there.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: Letters after at most one space, and the marks behind them: two matches of the split pattern, found faster.
_LETTERS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Chunks, and pre-tokens, kept per worker; either memo is emptied when full.
MEMO_ENTRIES = 500_000
#: Pre-tokens that share a queue: enough to fill its buckets, few enough for the processor's cache.
QUEUE_PIECES = 1500


#: The pattern for which _LETTERS holds.
_KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = MEMO_ENTRIES):
        import regex

        self.ranks, self.memo_entries = ranks, memo_entries
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, such as {missing[0]}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.byte_pairs = np.full(1 << 16, -1, np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.byte_pairs[piece[0] << 8 | piece[1]] = rank
        self.memo: dict[str, bytes] = {}  # chunk -> ids, packed
        self.pieces: dict[bytes, bytes] = {}  # pre-token -> ids, packed
        self.plain = pattern == _KNOWN_PATTERN

    @classmethod
    def from_file(cls, path: str, pattern: str, memo_entries: int = MEMO_ENTRIES) -> ByteBPE:
        with open(local_file(path), "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, pattern, memo_entries)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens, none of them empty.

        Symbols are known by the offset where they start in the joined pieces: end and before link them,
        stops marks where pieces end, pair[i] is the rank of the symbol at i joined with the next, -1
        without one, ids[i] its id. Bit r & 255 of words[r >> 8] tells of a bucket, bit w of top of a word that isn't 0.
        """
        if not pieces:
            return []
        data, rank_of = b"".join(pieces), self.ranks.get
        n, raw = len(data), np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        firsts = np.concatenate(([0], ends[:-1]))
        end, before = list(range(1, n + 1)), np.arange(-1, n - 1)
        before[firsts] = -1
        before = before.tolist()
        stops = bytearray(n + 1)
        np.frombuffer(stops, np.uint8)[ends] = 1
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.byte_pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ranks[ends - 1] = -1
        pair, ids, alive = ranks.tolist(), self.byte_ids[raw].tolist(), bytearray(b"\1") * n
        order = np.argsort(ranks, kind="stable")  # the first buckets, all at once
        present, begin = np.unique(ranks[order], return_index=True)
        bounds, places = [*begin.tolist(), n], order.tolist()
        buckets = {r: places[bounds[i] : bounds[i + 1]] for i, r in enumerate(present.tolist()) if r >= 0}
        words: dict[int, int] = {}
        top = 0
        for r in buckets:
            words[r >> 8] = words.get(r >> 8, 0) | 1 << (r & 255)
            top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w << 8 | (word & -word).bit_length() - 1
            words[w] = word = word & word - 1
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for nth, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: a neighbour's merge changed the pair
                j = end[i]
                end[i] = k = end[j]
                ids[i] = rank
                pair[j] = -1
                alive[j] = 0
                if stops[k]:
                    pair[i] = new = -1
                else:
                    before[k] = i
                    pair[i] = new = rank_of(data[i : end[k]], -1)
                lower = False
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        w = new >> 8
                        words[w] = words.get(w, 0) | 1 << (new & 255)
                        top |= 1 << w
                    lower = new <= rank
                h = before[i]
                if h >= 0:
                    pair[h] = new = rank_of(data[h:k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            w = new >> 8
                            words[w] = words.get(w, 0) | 1 << (new & 255)
                            top |= 1 << w
                        lower = lower or new <= rank
                if lower:  # that pair comes before what is left here
                    if rest := bucket[nth + 1 :]:
                        if rank in buckets:
                            buckets[rank] += rest
                        else:
                            buckets[rank] = rest
                            w = rank >> 8
                            words[w] = words.get(w, 0) | 1 << (rank & 255)
                            top |= 1 << w
                    break
        left = np.frombuffer(alive, np.uint8)
        packed = np.array(ids, np.uint32)[left.view(bool)].tobytes()
        upto = [0, *(4 * np.cumsum(left, dtype=np.int64)[ends - 1]).tolist()]
        return [packed[a:b] for a, b in zip(upto, upto[1:], strict=False)]

    def _split(self, chunk: str) -> list[bytes]:
        if self.plain and (found := _LETTERS.fullmatch(chunk)):
            letters, marks = found.groups()
            return [letters.encode(), marks.encode()] if marks else [letters.encode()]
        return [p.encode() for p in self.split(chunk)]

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks into the memo."""
        if len(self.pieces) > self.memo_entries:
            self.pieces.clear()
        packed, waiting, memo = self.pieces, {}, self.memo
        parts = [(c, self._split(c)) for c in chunks]
        for _, own in parts:
            for p in own:
                if p not in packed:
                    if (rank := self.ranks.get(p)) is not None:
                        packed[p] = array("I", (rank,)).tobytes()
                    else:
                        waiting[p] = None
        pieces = list(waiting)
        for at in range(0, len(pieces), QUEUE_PIECES):
            own = pieces[at : at + QUEUE_PIECES]
            packed.update(zip(own, self.merge(own), strict=True))
        for c, own in parts:
            memo[c] = packed[own[0]] if len(own) == 1 else b"".join([packed[p] for p in own])
        for p in pieces:  # what is very long is not kept
            if len(p) > 256:
                del packed[p]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; what is new to this worker is merged together."""
        if len(self.memo) > self.memo_entries:
            self.memo.clear()
        memo, cut, new = self.memo, [], set()
        for text in texts:
            chunks = _CHUNK.findall(text) if text else []
            ids = list(map(memo.get, chunks))
            unknown = [i for i, x in enumerate(ids) if x is None]
            new.update([chunks[i] for i in unknown])
            cut.append((chunks, ids, unknown))
        if new:
            self._learn(new)
        for chunks, ids, unknown in cut:
            for i in unknown:
                ids[i] = memo[chunks[i]]
        for chunk in new:
            if len(chunk) > 256:
                del memo[chunk]
        return [np.frombuffer(b"".join(ids), np.uint32) for _, ids, _ in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(path: str, pattern: str, memo_entries: int = MEMO_ENTRIES) -> ByteBPE:
    return worker_cache(("bpe", path, pattern, memo_entries), lambda: ByteBPE.from_file(path, pattern, memo_entries))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """One row per row of docs: its id column, ids array<int> and, if asked, decoded binary (from those ids).

    No shuffle: each task encodes its own rows. Null text: no ids, empty bytes.
    """
    small_batches(docs.sparkSession, rows=1024, mb=4)
    rows = with_columns_of(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, memo_entries)
        for batch in batches:
            ids = codec.encode_batch(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            columns = {id_col: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
            if decode:
                columns["decoded"] = pa.array([codec.decode(x.tolist()) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids; null ids: empty bytes."""
    small_batches(encoded.sparkSession)
    rows = with_columns_of(encoded, id_col, ids_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(path, pattern)
        for batch in batches:
            decoded = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "decoded": pa.array(decoded, pa.binary())})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
