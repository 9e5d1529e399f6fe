"""Token ids as wavelet matrices, one compressed file image per shard.

A shard holds the ids of consecutive documents. Its bits stand in planes, the
highest bit first; each plane orders the ids stably by the bit of the plane
before. Popcounts per block of words give rank in constant time and select by
bisection, and so any token, the count of an id in any range and the place of
its k-th occurrence come from the planes alone.

File image: magic, header (ids, planes, documents), document ids and ends,
zeros per plane, then the planes, zstd-compressed as one frame, with a checksum.
Shards are rows of a Parquet table in the shared folder, one image a row, so
that Spark's commit protocol covers them on every store; save() and load() put
one image into a file of its own.

Edge cases: null and empty texts are documents of the end id only; documents
with a null id come first; repeated ids keep their rows, ordered by text hash;
an empty table writes no shard; a document is never split, however long.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_file, materialize, shared_dir, small_batches, with_columns_of, worker_cache

_MAGIC, _HEAD = b"WVMX0001", struct.Struct("<8sQIQI")
_BLOCK = 8  # 64-bit words per popcount entry
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
#: Document id of rows without one, in the files.
_NO_ID = -(1 << 63)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], doc_ids: np.ndarray, ends: np.ndarray):
        self.n, self.planes, self.zeros, self.doc_ids, self.ends = n, planes, zeros, doc_ids, ends
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids=(), ends=()) -> WaveletMatrix:
        n = len(ids)
        height = max(1, int(ids.max()).bit_length()) if n else 1
        x = ids.astype(np.uint16 if height <= 16 else np.uint32)
        planes, zeros = [], []
        for shift in range(height - 1, -1, -1):
            bits = (x & x.dtype.type(1 << shift)) != 0
            planes.append(_packed(bits))
            zeros.append(n - int(np.count_nonzero(bits)))
            x = np.concatenate((np.compress(~bits, x), np.compress(bits, x)))  # several times faster than x[bits]
        return cls(n, planes, zeros, np.asarray(doc_ids, np.int64), np.asarray(ends, np.uint64))

    # -- the file image ---------------------------------------------------
    def to_bytes(self) -> bytes:
        body = b"".join([self.doc_ids.tobytes(), self.ends.tobytes(), np.asarray(self.zeros, np.uint64).tobytes(), *(p.tobytes() for p in self.planes)])
        head = _HEAD.pack(_MAGIC, self.n, len(self.planes), len(self.doc_ids), zlib.crc32(body))
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        magic, n, height, docs, crc = _HEAD.unpack_from(image)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        body = zstandard.ZstdDecompressor().decompress(image[_HEAD.size :])
        if zlib.crc32(body) != crc:
            raise ValueError("a wavelet shard is damaged")
        doc_ids, ends = np.frombuffer(body, np.int64, docs), np.frombuffer(body, np.uint64, docs, 8 * docs)
        zeros = np.frombuffer(body, np.uint64, height, 16 * docs)
        words = -(-n // 64)
        planes = [np.frombuffer(body, np.uint64, words, 16 * docs + 8 * height + 8 * words * i) for i in range(height)]
        return cls(n, planes, [int(z) for z in zeros], doc_ids, ends)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def load(cls, path: str) -> WaveletMatrix:
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    # -- queries ----------------------------------------------------------
    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if self._ranks is None:
            self._ranks = [np.concatenate(([0], np.cumsum(np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), _BLOCK))))) if len(p) else np.zeros(1, np.int64) for p in self.planes]
        word, bit = divmod(i, 64)
        block = word // _BLOCK
        p = self.planes[plane]
        ones = int(self._ranks[plane][block]) + int(np.bitwise_count(p[block * _BLOCK : word]).sum())
        return ones + (int(p[word]) & (1 << bit) - 1).bit_count() if bit else ones

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, words in enumerate(self.planes):
            bit = int(words[i // 64]) >> i % 64 & 1
            value = value << 1 | bit
            ones = self._rank1(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of value in [begin, end) stand after the last plane."""
        height = len(self.planes)
        if value < 0 or value >> height:
            return 0, 0
        for plane in range(height):
            a, b = self._rank1(plane, begin), self._rank1(plane, end)
            if value >> height - 1 - plane & 1:
                begin, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        a, b = self._range(value, begin, self.n if end is None else end)
        return b - a

    rank = count

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a plane is."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of value."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at, height = a + k, len(self.planes)
        for plane in range(height - 1, -1, -1):
            bit = value >> height - 1 - plane & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def to_array(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        height = len(self.planes)
        x = np.zeros(self.n, np.uint16 if height <= 16 else np.uint32)
        for plane in range(height - 1, -1, -1):
            bits = np.unpackbits(self.planes[plane].view(np.uint8), count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~bits)] = x[: self.zeros[plane]]
            y[np.flatnonzero(bits)] = x[self.zeros[plane] :] | x.dtype.type(1 << height - 1 - plane)
            x = y
        return x

    def document(self, at: int) -> np.ndarray:
        begin = int(self.ends[at - 1]) if at else 0
        return np.array([self.access(i) for i in range(begin, int(self.ends[at]))], np.uint32)


def _packed(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)


#: Texts are cut at white space and each piece is encoded once per worker: exact for tokenizers that drop
#: white space, as _drops_space() finds out from the tokenizer's file. str.split() also cuts at these four
#: characters, which aren't white space to the tokenizer.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_PIECE = re.compile(r"[^ \n]+")
#: A run of plain letters and the marks after it are pre-tokens of their own, and lower-casing a letter needs no context.
_LETTERS, _MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)"), frozenset(".,;:!?")
#: Pieces, and words of plain letters, kept per worker; either memo is emptied when full.
MEMO_ENTRIES = 1_500_000


class WordEncoder:
    """A tokenizer of the tokenizers library, with a memo of the pieces between spaces where that is exact."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(local_file(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = _drops_space(path)
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # the same vocabulary and merges for words that need neither normalising nor splitting
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.ends_word = np.array([name.endswith("</w>") for name, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Lower-case words of plain letters, many in one call: the last token of each ends a word, no other does."""
        out = []
        for at in range(0, len(words), 64):
            own = words[at : at + 64]
            ids = np.array(self.plain.encode(" ".join(own), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(own):
                return self._encode(words)
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        if len(self.words) > MEMO_ENTRIES:
            self.words.clear()
        words, memo, match, waiting, odd, new = self.words, self.memo, _LETTERS.fullmatch, [], [], {}
        for piece in pieces:
            if piece.isalpha() and piece.isascii():  # what the pattern finds, sooner
                letters, marks = piece.lower(), ""
            elif piece[-1] in _MARKS and piece.isascii() and piece[:-1].isalpha():
                letters, marks = piece[:-1].lower(), piece[-1]
            elif found := match(piece):
                letters, marks = found.groups()
                letters = letters.lower()
            else:
                odd.append(piece)
                continue
            ids, tail = words.get(letters), words.get(marks) if marks else b""
            if ids is not None and tail is not None:
                memo[piece] = ids + tail
                continue
            waiting.append((piece, letters, marks))
            if ids is None:
                new[letters] = None
            if tail is None:
                words[marks] = self._encode([marks])[0]
        words.update(zip(new, self._encode_words(list(new)), strict=True))
        memo.update(zip(odd, self._encode(odd), strict=True))
        for piece, letters, marks in waiting:
            memo[piece] = words[letters] + words[marks] if marks else words[letters]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.frombuffer(x, "<u4") for x in self._encode(texts)]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        memo, cut, new = self.memo, [], {}
        for text in texts:
            pieces = _PIECE.findall(text) if any(c in text for c in _NOT_SPACE) else text.split()
            ids = list(map(memo.get, pieces))
            unknown = [i for i, x in enumerate(ids) if x is None]
            new.update(dict.fromkeys([pieces[i] for i in unknown]))
            cut.append((pieces, ids, unknown))
        if new:
            self._learn(list(new))
        for pieces, ids, unknown in cut:
            for i in unknown:
                ids[i] = memo[pieces[i]]
        return [np.frombuffer(b"".join(ids), "<u4") for _, ids, _ in cut]


def _drops_space(path: str) -> bool:
    """Whether encoding can be done between spaces: the split drops white space, what comes before works
    on single characters or composes them, and no special token has a space or strips what is beside it."""
    import json

    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    steps = (kept.get("normalizer") or {}).get("normalizers") or ([kept["normalizer"]] if kept.get("normalizer") else [])
    cuts = (kept.get("pre_tokenizer") or {}).get("pretokenizers") or ([kept["pre_tokenizer"]] if kept.get("pre_tokenizer") else [])
    return (
        all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
        and bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and "\\s\\p{L}\\p{N}]+" in cuts[0]["pattern"].get("Regex", "")
        and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in kept["added_tokens"])
    )


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text, appends end_id, and writes wavelet shards to path in ascending order of the document ids.

    One range shuffle by document id; each task then writes its range as shards of about
    shard_ids ids. Returns the shard table: shard, first_doc, n_docs, n_tokens, image.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=256, mb=8)
    rows = with_columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("words", tokenizer), lambda: WordEncoder(tokenizer))
        shard = TaskContext.get().partitionId() << 32
        end, ids, doc_ids, ends, size = np.array([end_id], "<u4"), [], [], [], 0

        def closed():
            image = WaveletMatrix.build(np.concatenate(ids), doc_ids, ends).to_bytes()
            first = None if doc_ids[0] == _NO_ID else doc_ids[0]
            return pa.RecordBatch.from_pydict({"shard": [shard], "first_doc": pa.array([first], pa.int64()), "n_docs": [len(doc_ids)], "n_tokens": [size], "image": pa.array([image], pa.binary())})

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += [own, end]
                size += len(own) + 1
                doc_ids.append(_NO_ID if doc_id is None else doc_id)
                ends.append(size)
                if size >= shard_ids:
                    yield closed()
                    shard, ids, doc_ids, ends, size = shard + 1, [], [], [], 0
        if doc_ids:
            yield closed()

    return materialize(ordered.mapInArrow(run, "shard bigint, first_doc bigint, n_docs bigint, n_tokens bigint, image binary"), path, partition_bytes=16 << 20)


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document back from the shards' images: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts come from the prefix sums of the shards' own totals, a row per shard.
    """
    small_batches(shards.sparkSession, rows=256, mb=8)

    def run(batches):
        for batch in batches:
            for shard, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = WaveletMatrix.from_bytes(image.as_py())
                data, ends = matrix.to_array().astype("<u4"), matrix.ends.astype(np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(data[a:b]) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(ends), pa.int64()), "doc_id": pa.array(matrix.doc_ids, pa.int64(), mask=matrix.doc_ids == _NO_ID), "local": pa.array(begins), "n_tokens": pa.array(ends - begins), "ids_crc32": pa.array(crcs, pa.int64())})

    docs = shards.select("shard", "image").mapInArrow(run, "shard bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    return docs.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """How often each shard has a token, from the planes alone: shard, n."""
    small_batches(shards.sparkSession, rows=256, mb=8)

    def run(batches):
        for batch in batches:
            n = [WaveletMatrix.from_bytes(image.as_py()).count(token) for image in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"shard": batch.column(0), "n": pa.array(n, pa.int64())})

    return shards.select("shard", "image").mapInArrow(run, "shard bigint, n bigint")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Every place of a token: doc_id and its offset in the document, by select."""
    small_batches(shards.sparkSession, rows=256, mb=8)

    def run(batches):
        for batch in batches:
            for image in batch.column(0):
                matrix = WaveletMatrix.from_bytes(image.as_py())
                at = np.array(matrix.occurrences(token), np.int64)
                ends = matrix.ends.astype(np.int64)
                doc = np.searchsorted(ends, at, side="right")
                begins = np.concatenate(([0], ends))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(matrix.doc_ids[doc], pa.int64(), mask=matrix.doc_ids[doc] == _NO_ID), "offset": pa.array(at - begins[doc])})

    return shards.select("image").mapInArrow(run, "doc_id bigint, offset bigint")


def shard_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """write_shards() into a new folder of the shared place."""
    return write_shards(docs, f"{shared_dir(spark)}/shards", tokenizer, end_id, **options)
