"""Language ID by words first, then character n-grams.

The model keeps, per language, the log frequency of its words and of
the n-grams (n from MAX_N down to 1, with word ends) of those words. A known
word of a text adds its log frequencies. A word that no language knows falls
back to its n-grams of MAX_N characters, and if none of those is known, to the
next shorter ones, down to single characters.

The model is fitted on a sample of TRAIN_ROWS labelled rows (chosen by a hash of
the document's id, as many of each language), which bounds its size whatever the corpus; of the
sample, it keeps the words that occur twice or more, or all words of a language where those that do are less than
half of what its texts hold (as in languages that are written without spaces).

Edge cases: a null text, or one without a letter, is "und" with score 0, and so
is every text if no row is labelled; ties go to the smaller language name; rows
with a null document id count as not held out; texts are read whole; repeated rows are
judged each for itself, and learned from as often as they stand there; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, with_columns_of, worker_cache

TRAIN_ROWS = 20_000
MAX_N = 4
MEMO_ENTRIES = 300_000
#: Labels are broadcast if they are counted to be no more.
BROADCAST_LABELS = 10_000
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """The lower-case words of a text: runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """A word's n-grams, its ends marked; the marks alone are none."""
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Logs:
    """Log frequencies by language of words or n-grams: a place for each, and a matrix."""

    def __init__(self, counts: dict[tuple[str, int], int], n_langs: int):
        names = sorted({name for name, _ in counts})
        self.at = dict(zip(names, range(len(names)), strict=True))
        seen = np.zeros((len(names), n_langs))
        for (name, lang), n in counts.items():
            seen[self.at[name], lang] = n
        self.rows = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * len(names))).astype(np.float32)

    def get(self, name: str) -> np.ndarray | None:
        at = self.at.get(name)
        return None if at is None else self.rows[at]


class Model:
    """Log frequencies of words, and of n-grams by length, from rows of (language, word, n)."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.words = Logs({(word, at[lang]): n for lang, word, n in counts}, len(at))
        self.grams = {}
        for n in range(1, MAX_N + 1):
            seen: Counter = Counter()
            for lang, word, many in counts:
                for g in grams(word, n):
                    seen[g, at[lang]] += many
            self.grams[n] = Logs(seen, len(at))

    def of_word(self, word: str) -> np.ndarray | None:
        """A word's log frequencies; None if even its characters are unknown."""
        known = self.words.get(word)
        if known is not None:
            return known
        for n in range(MAX_N, 0, -1):
            found = [x for g in grams(word, n) if (x := self.grams[n].get(g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return None


class Predictor:
    """A model with a memo of words, whose rows are summed by index."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((4096, len(self.model.languages)), np.float32)  # row 0: says nothing
        self.known: dict[str, int] = {"": 0}
        self.used = 1

    def _learn(self, word: str) -> int:
        logs = self.model.of_word(word)
        at = 0
        if logs is not None:
            if self.used == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            at = self.used
            self.rows[at] = logs
            self.used += 1
        self.known[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letters(text)
        if not self.model.languages or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        if len(self.known) > MEMO_ENTRIES:
            self.clear()
        for word in set(found).difference(self.known):
            self._learn(word)
        at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        total = self.rows[at].sum(axis=0, dtype=np.float64) / math.sqrt(len(found))
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n over all rows of docs, counted in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in letters(text))
            langs, words = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.string()), "n": pa.array(counts.values(), pa.int64())})

    rows = with_columns_of(docs, lang_col, text_col)
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of labelled rows (null texts and labels are left out). What comes to the driver is
    bounded by the words of train_rows rows."""
    rows = with_columns_of(labelled, id_col, text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    spark = rows.sparkSession
    folder = shared_dir(spark)
    labels = materialize(rows.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__rows")), f"{folder}/labels")
    n_labels = labels.count()
    quota = train_rows / max(1, n_labels)  # each language has as many rows, so that rare ones are learned at every size
    place = F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).cast("double") / float(1 << 64) + 0.5
    few = F.broadcast(labels) if n_labels <= BROADCAST_LABELS else labels
    rows = rows.join(few, F.col(lang_col) == F.col("__lang")).where(place * F.col("__rows") < quota).select(*rows.columns)
    counts = materialize(word_counts(rows, lang_col, text_col), f"{folder}/words")
    repeats = F.col("n") >= 2
    kinds = counts.groupBy(F.col("lang").alias("__lang")).agg((2 * F.coalesce(F.sum(F.when(repeats, F.col("n"))), F.lit(0)) >= F.sum("n")).alias("__some"))
    kept = counts.join(F.broadcast(kinds) if n_labels <= BROADCAST_LABELS else kinds, F.col("lang") == F.col("__lang")).where(repeats | ~F.col("__some"))
    return Model([(r.lang, r.word, r.n) for r in kept.select("lang", "word", "n").orderBy("lang", "word").collect()])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row of docs: from the text alone. No shuffle; the model is broadcast, and bounded as fit() says."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    rows = with_columns_of(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = worker_cache(("languages",), dict)
        if predictor.get("of") != key:  # one model at a time stays in a worker
            predictor.update(of=key, predictor=Predictor(sent.value))
        for batch in batches:
            found = [predictor["predictor"].predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_column) -> F.Column:
    """The fold that is kept from training: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def select_certain(docs: DataFrame, model: Model, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least this score. No shuffle:
    each task judges its own rows and keeps or drops them."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    key, at = uuid.uuid4().hex, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = worker_cache(("languages",), dict)
        if predictor.get("of") != key:
            predictor.update(of=key, predictor=Predictor(sent.value))
        for batch in batches:
            found = [predictor["predictor"].predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
