"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in chunks that overlap. Two neighbouring chunks are
spliced at a boundary that both encodings have and that is proven stable: no
piece of the vocabulary holds the two characters that meet there next to each
other, so no merge can ever cross the place, whatever stands around it, and the
text's encoding is the concatenation of what stands on either side. Where an
overlap has no such place, it is widened backwards, and if that reaches the
last splice the chunk itself grows, up to the whole text.

Edge cases: null and empty texts have 0 tokens; a text without any stable place
is encoded in one piece; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import local_file, small_batches, with_columns_of, worker_cache

CHUNK_BYTES = 16_384
OVERLAP_BYTES = 512
_SPACE = "▁"


class OverlapCounter:
    """Counts the tokens of a sentencepiece model. Splits only if the model's normaliser keeps every character."""

    def __init__(self, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        if not 8 <= overlap <= chunk // 2:
            raise ValueError("the overlap must be 8 bytes at least and half a chunk at most")
        self.library = sentencepiece.SentencePieceProcessor(model_file=local_file(path))
        self.chunk, self.overlap = chunk, overlap
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        self.splits = rule.name == "identity" and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.escape_whitespaces and model.trainer_spec.model_type == model.trainer_spec.BPE
        kinds = model.SentencePiece
        self.joined = {p.piece[i : i + 2] for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED) for i in range(len(p.piece) - 1)}

    def stable(self, data: bytes, at: int) -> bool:
        """Whether no piece can cover both the character before data[at] and the one at it."""
        before = _aligned(data, at - 1)
        pair = data[before : at + 4].decode(errors="ignore")[:2]
        return pair.replace(" ", _SPACE) not in self.joined

    def starts(self, data: bytes, begin: int, end: int) -> list[int]:
        """Where the tokens of data[begin:end], encoded on its own, start in data."""
        return [begin + p.begin for p in self.library.encode(data[begin:end].decode(), return_type="proto").pieces]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk or not self.splits:
            return len(self.library.encode(text))
        data = text.encode()  # offsets are in bytes, as the library gives them
        n = len(data)
        total, done, begin, end = 0, 0, 0, _aligned(data, min(n, self.chunk))  # tokens that start before done are counted
        left = self.starts(data, begin, end)
        while end < n:
            overlap, splice = self.overlap, None
            while splice is None:
                start = _aligned(data, max(done, end - overlap))
                stop = _aligned(data, min(n, end - self.overlap + self.chunk))
                right = self.starts(data, start, stop)
                common = set(left).intersection(right)
                splice = max((x for x in common if start < x < end and x > done and self.stable(data, x)), default=None)
                if splice is None and start <= done:
                    break
                overlap *= 2  # no stable boundary that both have: widen
            if splice is None:  # nothing stable since the last splice: a longer chunk
                end = _aligned(data, min(n, end + (end - begin)))
                left = self.starts(data, begin, end)
                continue
            total += sum(done <= x < splice for x in left)
            done, begin, end, left = splice, start, stop, right
        return total + sum(x >= done for x in left)


def _aligned(data: bytes, at: int) -> int:
    """The start of the character that at lies in."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """One row per row of docs: its id column, n_bytes (UTF-8) and n_tokens, without begin, end or added tokens. No shuffle."""
    small_batches(docs.sparkSession)
    rows = with_columns_of(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(("sp", path, chunk, overlap), lambda: OverlapCounter(path, chunk, overlap))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
