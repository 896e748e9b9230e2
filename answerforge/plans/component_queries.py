"""Components, pipelines and index arithmetic as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerforge import components
from answerforge.functions.text import space_tokens, to_number
from answerforge.models.calibration import train_centroids
from answerforge.operators.passages import prefix_offsets
from answerforge.operators.prepare import index_sample_size, partition_count
from answerforge.plans.registry import query
from answerforge.plans.retrieval_queries import bm25_sql
from answerforge.session import own_folder, table


@query(f"with {bm25_sql(0.9, 3)}, h as (select qid, rank, substr(text, 1, 200) as t from bm join documents using (doc_id)) select q.id as qid, array_to_string(list(t order by rank), ' ## ') as previews from retrieval_triples q join h on h.qid = q.id group by 1")
def pipeline_previews(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of the three best documents of each query, through the pipeline's retriever."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    queries = table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), "query")
    found = components.Pipeline(components.SparseRetriever(k=3), components.SentenceReader()).preview(queries, docs)
    return found.select("qid", F.array_join("previews", " ## ").alias("previews"))


@query(f"with {bm25_sql(0.9, 10)}, l as (select qid, list(doc_id order by rank) as ids from bm group by 1) select id as qid, coalesce(array_to_string(ids, ','), '') as docs from retrieval_triples left join l on qid = id")
def searchable_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents added to a corpus in two parts, then searched; queries without a hit stay."""
    corpus = components.SearchableCorpus(spark, f"{own_folder(spark)}/corpus-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit("").alias("title"), "text")
    corpus.add(docs.where("doc_id % 2 = 0"))
    corpus.add(docs.where("doc_id % 2 <> 0"))
    found = corpus.search(table(spark, d, "retrieval_triples").select(F.col("id").alias("qid"), "query"))
    return found.select("qid", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("docs"))


@query("select unnest(['SparseRetriever.b=0.4', 'SparseRetriever.k=10', 'SparseRetriever.k1=0.9', 'VectorRetriever.k=10', 'VectorRetriever.metric=cosine']) as parameter")
def component_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of the registered retrievers with their defaults."""
    out = None
    for name in ("SparseRetriever", "VectorRetriever"):
        rows = components.resolve(name).parameters(spark).where("name in ('k', 'k1', 'b', 'metric')")
        part = rows.select(F.concat(F.lit(f"{name}."), "name", F.lit("="), "default").alias("parameter"))
        out = part if out is None else out.unionByName(part)
    return out


@query("select doc_id, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as first_token from (select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) as n from documents where text is not null)")
def embedding_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's token vectors begin in the index: lengths to offsets."""
    sizes = table(spark, d, "documents").where("text is not null").select("doc_id", F.size(space_tokens(F.col("text"))).alias("n"))
    return prefix_offsets(sizes, "doc_id", "n", "first_token").select("doc_id", "first_token")


@query("select count(*) as vectors, (2 ** floor(log2(8 * sqrt(count(*)))))::bigint as centroids, least(count(*), 1 + floor(16 * sqrt(120 * count(*))))::bigint as sample from embeddings where embedding is not null")
def kmeans_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of a k-means index, as many as its size asks for."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    n = e.count()
    made = train_centroids(e, partition_count(n)).count()
    return spark.createDataFrame([(n, made, index_sample_size(n))], "vectors bigint, centroids bigint, sample bigint")


@query("select event_type, case when sum(case when value > 100 then 1 else 0 end) = 0 then 0.0 else round(sum(value) / sum(case when value > 100 then 1 else 0 end), 4) end::double as share, count(try_cast(event_id::varchar as double)) as numbers from events group by 1")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios whose divisor may be 0, and texts as numbers."""
    big = F.sum(F.when(F.col("value") > 100, 1).otherwise(0))
    share = F.coalesce(F.round(F.try_divide(F.sum("value"), big), 4), F.lit(0.0))
    return table(spark, d, "events").groupBy("event_type").agg(share.alias("share"), F.count(to_number(F.col("event_id").cast("string"))).alias("numbers"))
