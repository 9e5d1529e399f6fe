"""Stored postings in blocks, of which a question reads those that can hold one of its best answers.

Documents are dealt to buckets of about BUCKET_DOCS by length, as short ones score higher. A block holds a term's
postings of one bucket, with the greatest score part among them; all terms share the buckets. A question reads the
blocks' greatest parts of its terms, which bounds what each bucket can score. The best buckets give the k-th score so far,
and of the others those are read whose bound reaches it: the answer is exact. Terms are stored with their
df and idf, the mean of all idf included, so that no question passes over the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import K1, B, document_terms, idf, postings, top

BUCKET_DOCS = 256
#: Buckets that are named in a filter, which the scan of the blocks uses; more are joined.
NAMED_BUCKETS = 2_000


@dataclass
class Read:
    """Postings of a question's terms in all buckets, and in those that were read."""

    there: int
    read: int


def build(corpus: DataFrame, id_col: str = "id", text_col: str = "text", bucket_docs: int = BUCKET_DOCS) -> dict[str, DataFrame]:
    """blocks (term, bucket, most, n, ids, parts) and terms (term, df, idf), to be stored. corpus: id, text."""
    tokens = corpus.select(F.size(T.whitespace_tokens(F.col(text_col))).alias("length"))
    size = tokens.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length"))
    # classes of lengths are fewer than 200, as a length is an int
    kind = F.floor(F.log(F.col("length") + 1.0) * 8).cast("int")
    kinds = tokens.groupBy(kind.alias("of")).agg(F.ceil(F.count(F.lit(1)) / bucket_docs).alias("slices"))
    counted = postings(corpus, id_col, text_col)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    placed = counted.crossJoin(F.broadcast(size)).join(F.broadcast(kinds), kind == F.col("of"))
    placed = placed.select("term", F.concat_ws(".", "of", F.pmod(F.xxhash64("id"), F.col("slices"))).alias("bucket"), F.struct(part.alias("part"), "id").alias("p"))
    blocks = placed.groupBy("term", "bucket").agg(F.array_sort(F.collect_list("p")).alias("p"))
    blocks = blocks.select("term", "bucket", F.array_max("p.part").alias("most"), F.size("p").alias("n"), F.col("p.id").alias("ids"), F.col("p.part").alias("parts"))
    terms = idf(document_terms(corpus, text_col).crossJoin(F.broadcast(size.select("documents"))), F.col("documents"))
    return {"blocks": blocks.sortWithinPartitions("term", "bucket"), "terms": terms.sortWithinPartitions("term")}


def _scores(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    rows = blocks.join(F.broadcast(weights), "term").select("weight", F.explode(F.arrays_zip("ids", "parts")).alias("p"))
    return rows.groupBy(F.col("p.ids").alias("id")).agg(F.sum(F.col("p.parts") * F.col("weight")).alias("score"))


def search(blocks: DataFrame, terms: DataFrame, query: str, k: int) -> tuple[DataFrame, Read]:
    """(id, score of the k best with a score above 0, what was read). Repeated words count each time."""
    words = [w for w in query.lower().split() if w]
    times = {w: words.count(w) for w in words}
    asked = {r.term: r.idf * times[r.term] for r in terms.where(F.col("term").isin(*(times or [""]))).select("term", "idf").collect()}
    spark = blocks.sparkSession
    weights = spark.createDataFrame(list(asked.items()), "term string, weight double")
    own = blocks.where(F.col("term").isin(*(asked or [""])))
    if not asked or k < 1 or min(asked.values()) < 0:  # a negative weight bounds nothing
        n = own.agg(F.sum("n")).first()[0] or 0
        return top(_scores(own, weights).where("score > 0"), k), Read(n, n)
    bounds = own.join(F.broadcast(weights), "term").groupBy("bucket").agg(F.sum(F.col("most") * F.col("weight")).alias("bound"), F.sum("n").alias("n"), F.max("n").alias("docs"))
    first = bounds.orderBy(F.desc("bound"), "bucket").limit(max(8, 2 * k)).collect()  # some best answers come from these few
    need, chosen = 0, []
    for r in first:
        chosen.append(r.bucket)
        need += r.docs
        if need >= 4 * k:
            break
    part = lambda names: own.where(F.col("bucket").isin(*names))
    so_far = top(_scores(part(chosen), weights), k).collect()
    limit = so_far[-1].score if len(so_far) == k else 0.0
    # sums come in any order, so that a bound may be a rounding below what it bounds
    rest = bounds.where(F.col("bound") * (1 + 1e-9) >= limit).select("bucket", "n")
    names = [r.bucket for r in rest.select("bucket").limit(NAMED_BUCKETS + 1).collect()]
    kept = part(names or [""]) if len(names) <= NAMED_BUCKETS else own.join(rest.select("bucket"), "bucket", "left_semi")
    there, read = bounds.agg(F.sum("n"), F.sum(F.when(F.col("bound") * (1 + 1e-9) >= limit, F.col("n")))).first()
    return top(_scores(kept, weights).where("score > 0"), k), Read(there or 0, read or 0)
