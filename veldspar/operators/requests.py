"""Search requests: what a caller asks for, as values, compiled to the vector, lexical and fusion operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion, lexical, predicates, vector


@dataclass(frozen=True)
class Terms:
    """Any of the terms; one given twice weighs twice."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class Phrase:
    """The terms in order, with displacements of `slop` in all."""

    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Prefix:
    """Every indexed term that begins so."""

    prefix: str


@dataclass(frozen=True)
class TermsWithPrefix:
    """Whole terms and what the last, unfinished word may become."""

    terms: tuple[str, ...]
    prefix: str


@dataclass(frozen=True)
class Fuzzy:
    """Terms within `most` edits (by the term's length, if None)."""

    term: str
    most: int | None = None
    same_first: bool = False


@dataclass(frozen=True)
class Phonetic:
    """Terms that sound alike."""

    term: str


LexicalRequest = Terms | Phrase | Prefix | TermsWithPrefix | Fuzzy | Phonetic


def lexical_scores(index: lexical.Index, request: LexicalRequest, eligible: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of all documents that match."""
    if isinstance(request, Phrase):
        if not request.terms:
            raise ValueError("an empty phrase")
        gate = lexical.phrase_documents(index, request.terms, request.slop)
        if eligible is not None:
            gate = gate.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
        return lexical.scores(index, lexical.weights(list(request.terms)), gate)
    if isinstance(request, Terms):
        terms = lexical.weights(list(request.terms))
    elif isinstance(request, Prefix):
        terms = lexical.prefix_terms(index, request.prefix)
    elif isinstance(request, TermsWithPrefix):
        terms = lexical.typeahead_terms(index, request.terms, request.prefix)
    elif isinstance(request, Fuzzy):
        terms = lexical.fuzzy_terms(index, request.term, request.most, request.same_first)
    elif isinstance(request, Phonetic):
        terms = lexical.phonetic_terms(index, request.term)
    else:
        raise ValueError(f"not a lexical request: {request!r}")
    return lexical.scores(index, terms, eligible)


def search(
    live: DataFrame,
    k: int = 10,
    query: Sequence[float] | None = None,
    text: LexicalRequest | None = None,
    index: lexical.Index | None = None,
    predicate=None,
    ts_range: tuple | None = None,
    eligible: DataFrame | None = None,
    alpha: float | None = None,
    rules: bool = False,
    tier: str = "unset",
    key: str = "doc_id",
    analyze: Callable[[Column], Column] = lexical.ascii_tokens,
) -> DataFrame:
    """(doc_id, score, vector_squared_l2, lexical_bm25), the k best: by vector, by text, or fused where both are given.

    Without an alpha the default holds, or with `rules` the one that the request's shape asks for.
    Filters come before either leg's ranks; the statistics of BM25 and the vector ceiling stay those of all live rows.
    """
    if query is None and text is None:
        raise ValueError("a search needs a vector or a text")
    if k < 1:
        raise ValueError("k is at least 1")
    if tier not in vector.TIERS:
        raise ValueError(f"unknown tier {tier}")
    filtered = predicate is not None or ts_range is not None or eligible is not None
    rows = predicates.where(live, predicate, ts_range, eligible=eligible)
    allowed = rows.select(F.col(key).alias("doc_id")) if filtered else None
    none = F.lit(None).cast("double")
    if text is not None:
        index = index or lexical.build(live, key=key, analyze=analyze)
        lex = lexical_scores(index, text, allowed)
        if query is None:
            return lexical.top_k(lex, k).select("doc_id", "score", none.alias("vector_squared_l2"), F.col("score").alias("lexical_bm25"))
    q = vector.check_query(query)
    vec = vector.scored(rows.where(F.col("vector").isNotNull()).withColumnRenamed(key, "doc_id"), vector.literal(q)).select("doc_id", "score")
    if text is None:
        return vec.orderBy(F.desc("score"), F.asc("doc_id")).limit(k).select("doc_id", "score", (-F.col("score")).alias("vector_squared_l2"), none.alias("lexical_bm25"))
    alpha, _ = fusion.effective_alpha(alpha, signals(text, index) if rules and alpha is None else None)
    return fusion.top_k(fusion.fuse_store(vec, lex, vector.ceiling(live, q), alpha), k)


def signals(request: LexicalRequest, index: lexical.Index) -> fusion.Signals:
    """The request's shape: a phrase, the least document frequency of its exact terms (0 for one that no document has), a term with letters and digits or joiners."""
    terms = request.terms if isinstance(request, Terms | Phrase | TermsWithPrefix) else ()
    rarest = None
    if terms:
        found = {r.term: r.df for r in index.vocabulary().where(F.col("term").isin(*terms)).collect()}  # as many rows as the request has terms
        rarest = min(found.get(t, 0) for t in terms)
    return fusion.Signals(isinstance(request, Phrase), rarest, any(fusion.is_identifier(t) for t in terms))
