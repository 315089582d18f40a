"""BM25 retrieval and rank fusion over several corpora.

``search_index`` answers from a persisted index and reads the postings of the query's terms only. ``search`` answers
without one: each document keeps the counts of the terms, taken from its own token array in one pass, so no token is
shuffled; corpus statistics are one row a corpus."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.text import STOP_WORDS, tokens
from ..work import spread
from .index import Index

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """The query's tokens in order; a term given twice counts twice."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if len(t) > 1 and t not in STOP_WORDS]


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def term_counts(documents: DataFrame, terms: list[str], words: Column, keys: list[str], extra: list[str] = ()) -> DataFrame:
    """``keys, n_tokens, tf_0 ..``: a document's length and its count of each distinct term."""
    # the tokens are bound once inside one expression: as a column of their own, a filter on the counts that is pushed below
    # it would make them again for every term
    counts = lambda w: [occurrences(w, t).alias(f"tf_{i}") for i, t in enumerate(terms)]
    own = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n_tokens"), *counts(w)))
    return spread(documents.select("*")).select(*keys, *extra, F.inline(own))


def search(documents: DataFrame, query: str, words: Column | None = None, key: str = "doc_id", corpus: str | None = None) -> DataFrame:
    """All matching documents with ``score`` (unrounded) and ``first_term``, the place of the first query term met.

    With ``corpus``, statistics and scores are those of the document's own corpus."""
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    keys = [key] + ([corpus] if corpus else [])
    if not distinct:
        return documents.select(*keys).limit(0).withColumns({"score": F.lit(0.0), "first_term": F.lit(0)})
    counted = term_counts(documents, distinct, tokens("text") if words is None else words, keys)
    by = [corpus] if corpus else []
    stats = counted.groupBy(*by).agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(distinct))))
    hits = counted.filter(" OR ".join(f"tf_{i} > 0" for i in range(len(distinct))))
    # a row a corpus: broadcast while there are few corpora, joined by the planner's choice otherwise
    joined = hits.join(stats, corpus) if corpus else hits.crossJoin(F.broadcast(stats))
    score, first = F.lit(0.0), F.lit(len(terms))
    for place, term in reversed(list(enumerate(terms))):
        first = F.when(F.col(f"tf_{distinct.index(term)}") > 0, place).otherwise(first)
    for term in terms:
        i = distinct.index(term)
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    return joined.select(*keys, score.alias("score"), first.alias("first_term"))


def search_index(index: Index, query: str) -> DataFrame:
    """What ``search`` gives, from an index; with the corpus as a column ``corpus`` where the index has several."""
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    keys = [F.col("key").alias(index.key)] + ([F.col("corpus").alias(index.corpus)] if index.corpus else [])
    rows = index.postings(distinct)
    known = index.frequencies(distinct)
    # a term's document frequency in each corpus, as literals where there is one corpus and else joined
    if index.corpus:
        rows = rows.join(known, ["corpus", "term"]).join(index.corpora(), "corpus")
    else:
        df = F.lit(0)
        for r in known.collect():  # a row for each term asked
            df = F.when(F.col("term") == r["term"], r["df"]).otherwise(df)
        n, mean = index.statistics()
        rows = rows.withColumns({"df": df, "n": F.lit(n), "mean": F.lit(mean)})
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    times = first = F.lit(0)
    for x in distinct:
        times = F.when(F.col("term") == x, terms.count(x)).otherwise(times)
        first = F.when(F.col("term") == x, terms.index(x)).otherwise(first)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean"))) * times
    return rows.groupBy("corpus", "key").agg(F.sum(part).alias("score"), F.min(first).alias("first_term")).select(*keys, "score", "first_term")


def top(found: DataFrame, limit: int, offset: int = 0, key: str = "doc_id") -> DataFrame:
    """One page by the unrounded score; ties in order of the first query term met, then of the documents."""
    page = found.orderBy(F.desc("score"), "first_term", key).offset(offset).limit(limit)
    return page.withColumn("score", F.round("score", 3)).drop("first_term")


def fused(found: DataFrame, corpus: str, per_corpus: int, limit: int, key: str = "doc_id") -> DataFrame:
    """The best of several corpora interleaved: by rank within the corpus, then by score, then by corpus."""
    by = W.partitionBy(corpus).orderBy(F.desc("score"), "first_term", key)
    ranked = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= per_corpus)
    return ranked.orderBy("rank", F.desc("score"), corpus).limit(limit).withColumn("score", F.round("score", 3)).drop("first_term")


#: Corpora that one question may go to.
MOST_CORPORA = 20


def asked_corpora(asked: DataFrame, key: str = "channel_id", order: str = "ord") -> DataFrame:
    """The corpora of a question, each once: the last row of an id, in the place of its first."""
    others = [c for c in asked.columns if c not in (key, order)]
    out = asked.groupBy(key).agg(F.min(order).alias(order), *(F.max_by(c, order).alias(c) for c in others))
    return out.select(asked.columns).orderBy(order)


def matches(found: DataFrame, corpora: DataFrame, corpus: str) -> DataFrame:
    """How many documents of each corpus match, none included."""
    n = found.groupBy(corpus).agg(F.count("*").alias("matches"))
    return corpora.select(corpus).distinct().join(n, corpus, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
