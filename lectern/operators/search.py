"""Full-text search: a stored inverted index, kept by difference, and BM25 with corpus-wide statistics.

The index is four tables of a Store: postings and document lengths by job, document counts by term, and one row of corpus
totals. When jobs are replaced, what they counted is taken out of the last two and what they count now is put in; neither
is made anew. A search opens the buckets of its job and of its terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..sources import shared
from .tables import Store

#: Key columns of the index's tables.
INDEX = {"postings": "job_id", "doc_stats": "job_id", "term_stats": "term", "corpus_stats": None}


def postings(docs: DataFrame) -> DataFrame:
    """(job_id, doc, term, tf) from docs (job_id, doc, text)."""
    found = docs.select("job_id", "doc", F.explode(tokens.terms(F.col("text"))).alias("term"))
    return found.groupBy("job_id", "doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def index_changes(store: Store, seen, gone: DataFrame, docs: DataFrame) -> tuple[dict, dict]:
    """What Store.replace takes when documents (job_id, doc, text) come in place of all those of the jobs in `gone`."""
    own = shared.stash(postings(docs), "postings")
    lengths = docs.select("job_id", "doc").join(own.groupBy("job_id", "doc").agg(F.sum("tf").alias("dl")), ["job_id", "doc"], "left")
    lengths = shared.stash(lengths.select("job_id", "doc", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")), "doc-stats")
    more = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_terms"))
    if seen.has("postings"):
        jobs = gone.select(F.col(gone.columns[0]).alias("job_id")).unionByName(docs.select("job_id")).distinct()
        buckets = store.buckets_of("postings", jobs)
        out = {t: seen.read(t, buckets=buckets).join(jobs, "job_id", "left_semi") for t in ("postings", "doc_stats")}
        more = more.unionByName(out["postings"].groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        totals = totals.unionByName(out["doc_stats"].agg((-F.count(F.lit(1))).alias("n_docs"), F.coalesce(-F.sum("dl"), F.lit(0)).alias("n_terms")))
        totals = totals.unionByName(seen.read("corpus_stats"))
    change = shared.stash(more.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "term-changes")
    touched = store.buckets_of("term_stats", change) if seen.has("term_stats") else list(range(store.buckets))
    terms = change.unionByName(seen.read("term_stats", buckets=touched)) if seen.has("term_stats") else change
    terms = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = totals.agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_terms")])
    return {"postings": own, "doc_stats": lengths}, {"term_stats": (terms, touched), "corpus_stats": (totals, [0])}


def replace_documents(store: Store, gone: DataFrame, docs: DataFrame) -> None:
    """Documents in place of those of the jobs in `gone` (one column) and of their own jobs."""
    docs = shared.stash(docs.select("job_id", "doc", "text"), "documents")
    gone = shared.stash(gone.select(F.col(gone.columns[0]).alias("job_id")).distinct(), "replaced")
    seen = store.snapshot()
    new, also = index_changes(store, seen, gone, docs)
    store.replace(gone, new, also, seen)


def build(spark: SparkSession, docs: DataFrame, root: str | None = None, buckets: int = 16) -> Store:
    """A new index of docs (job_id, doc, text), in the shared folder if no place is named."""
    store = Store(spark, root or shared.fresh(spark, "index"), INDEX, buckets)
    replace_documents(store, docs.select("job_id").where("false"), docs)
    return store


def query_terms(query: str) -> list[str]:
    """Words of letters and digits only; others are dropped whole; repeats stay."""
    return [w for w in query.split() if w.isalnum()]


def search_index(store: Store, query: str, job_id, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, rank) of the job's documents with any term; lower is better. Statistics span all jobs; a repeated term counts again,
    and words that fold alike are one term."""
    spark, seen = store.spark, store.snapshot()
    words = spark.createDataFrame([(w,) for w in query_terms(query)], "word string")  # as many as a query has words
    times: dict[str, int] = {}
    for (term,) in words.select(F.explode(tokens.terms(F.col("word")))).collect() if query_terms(query) else []:
        times[term] = times.get(term, 0) + 1
    own = seen.read("postings", job_id)
    if not times:  # nothing is asked for
        return own.select("doc", F.lit(0.0).alias("rank")).where("false")
    hits = own.where(F.col("term").isin(*times)).select("doc", "term", "tf")
    df = seen.read("term_stats", *times)
    length = seen.read("doc_stats", job_id).select("doc", "dl")
    scored = hits.join(F.broadcast(df), "term").join(length, "doc").crossJoin(F.broadcast(seen.read("corpus_stats")))  # df: a row a term
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("term"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    mean = F.col("n_terms") / F.col("n_docs")
    gain = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    return scored.groupBy("doc").agg((-F.sum(gain)).alias("rank"))


def bm25(spark: SparkSession, docs: DataFrame, query: str, job_id, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """search_index over an index made of docs just now."""
    return search_index(build(spark, docs, buckets=4), query, job_id, k1, b)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, terms, distinct terms and mean length, of all jobs."""
    index = postings(docs)
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(index.agg(F.sum("tf").alias("n_terms"), F.countDistinct("term").alias("n_distinct"))).withColumn("mean", F.col("n_terms") / F.col("n_docs"))
