"""Search by vectors: exact nearest rows of one query, and fusion of rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.lang.compile import Mailbox, select
from postloom.lang.query import QueryError, free_text, operators_only


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalise(v: Column) -> Column:
    """The vector with length one; all zero stays so."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "message_id", vec: str = "vec", among: DataFrame | None = None) -> DataFrame:
    """key, score: the k rows most similar to ``query`` by cosine; rows of another length or with gaps are skipped.

    ``among`` (key): only these rows count, before the k are chosen.  Each task scores its batches by one product of
    matrices and passes on the best k of them only.
    """
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    sound = vectors.filter(F.col(vec).isNotNull() & (F.size(vec) == len(query)) & ~F.exists(vec, lambda x: x.isNull()))
    if among is not None:
        sound = sound.join(among.select(key).distinct(), key, "left_semi")
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(q)).astype(np.float64)
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            score = np.round((x @ q) / np.where(length > 0, length, 1.0), 6)
            ids = b.column(0)
            if b.num_rows > k:  # all that tie with the k-th stay, so that the smaller key can win
                keep = np.flatnonzero(score >= np.partition(score, b.num_rows - k)[b.num_rows - k])
                ids, score = ids.take(pa.array(keep)), score[keep]
            yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=[key, "score"])

    return sound.select(key, vec).mapInArrow(run, f"`{key}` {kind}, score double").orderBy(F.col("score").desc(), key).limit(k)


def fuse(*rankings: DataFrame, key: str = "id", constant: int = 60) -> DataFrame:
    """key, score: reciprocal-rank fusion of rankings (key, place), places from 0."""
    every = rankings[0].select(key, (F.lit(1.0) / (F.lit(constant) + F.col("place"))).alias("s"))
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, (F.lit(1.0) / (F.lit(constant) + F.col("place"))).alias("s")))
    return every.groupBy(key).agg(F.round(F.sum("s"), 8).alias("score"))


def ranked(df: DataFrame, *order: Column, key: str = "id") -> DataFrame:
    """key, place of a short list in its order (the list is a page, so one task ranks it)."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1).select(key, "place")


def document_text(longest: int = 2000) -> Column:
    """What of a mail is embedded: subject, sender, body, names of attachments (_files), cut to ``longest`` characters."""
    parts = [F.col("subject"), F.when(F.coalesce("from_name", F.lit("")) != "", F.col("from_name")).otherwise(F.col("from_addr")), F.col("body"), F.col("_files")]
    return F.substring(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n"), 1, longest)


def hashed_words(text: Column, dim: int = 64) -> Column:
    """A vector of length one from the words of a text, by hashing; the default where no model is at hand."""
    from postloom.functions.text import tokens

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            counts = [np.bincount(np.asarray(p, np.int64), minlength=dim).astype(np.float64) for p in places]
            yield pd.Series([c / (np.linalg.norm(c) or 1.0) for c in counts])

    return run(F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")))


def pending_texts(messages: DataFrame, vectors: DataFrame | None, model: str, attachments: DataFrame | None = None, longest: int = 2000) -> DataFrame:
    """(id, text) of one row for each mail whose content was read and that has no vector of this model yet."""
    one = messages.filter(F.col("content_state").isin("full", "parts")) if "content_state" in messages.columns else messages.filter("body is not null")
    first = one.groupBy("mid").agg(F.min("id").alias("id")).select("id")
    if vectors is not None:
        first = first.join(vectors.filter(F.col("model") == model).select(F.col("message_id").alias("id")), "id", "left_anti")
    rows = messages.join(first, "id", "left_semi")
    if attachments is None:
        return rows.withColumn("_files", F.lit(None).cast("string")).select("id", document_text(longest).alias("text"))
    files = attachments.filter("filename is not null").groupBy(F.col("message_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "filename"))), lambda x: x["filename"]), ", ").alias("_files"))
    return rows.join(files, "id", "left").select("id", document_text(longest).alias("text"))


def drop_other_models(vectors: DataFrame, model: str) -> DataFrame:
    """After a change of the model vectors of the one before can not be compared with new ones."""
    return vectors.filter(F.col("model") == model)


def embed_new(messages: DataFrame, vectors: DataFrame | None, model: str, embed=hashed_words, dim: int = 64, attachments: DataFrame | None = None) -> DataFrame:
    """message_id, model, dim, vec of one row for each mail that has no vector of this model yet."""
    texts = pending_texts(messages, vectors, model, attachments)
    return texts.select(F.col("id").alias("message_id"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), embed(F.col("text"), dim).alias("vec"))


def by_meaning(box: Mailbox, vectors: DataFrame, query: str, embed: Callable[[str], list[float]], model: str, k: int = 50, **filters) -> DataFrame:
    """(id, score): the k mails most similar to the words of a query, among those that its operators let through."""
    words = free_text(query)
    if not words:
        raise QueryError("A search by meaning needs some words")
    rest = operators_only(query)
    among = select(box, rest, **filters)[0].select(F.col("id").alias("message_id")) if rest or filters else None
    return nearest(vectors.filter(F.col("model") == model), embed(words), k, among=among).withColumnRenamed("message_id", "id")


def hybrid(box: Mailbox, vectors: DataFrame, query: str, embed: Callable[[str], list[float]], model: str, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """(id, score): search by words and by meaning fused, each with max(2 (limit + offset), 50) candidates."""
    from postloom.operators.search import search

    n = max(2 * (limit + offset), 50)
    near = ranked(by_meaning(box, vectors, query, embed, model, n, **filters), F.col("score").desc(), "id")
    found = search(box, query, limit=n, **filters)
    order = (F.round(F.col("score") * 2).desc(), F.col("date").desc_nulls_last(), F.col("id").desc())
    return fuse(near, ranked(found, *order)).orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)
