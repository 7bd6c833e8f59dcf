"""Lexical retrieval as a postings table: BM25, phrases, prefixes, fuzzy and phonetic terms.

Postings are (term, doc_id, tf, positions) with document lengths and one row of store-wide statistics.
A query names its terms with their weights, which filter the postings; stored by term (sources.lexicon), only those of its
terms are read. Terms that come from the vocabulary are a table that is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
EXPANSIONS = 32
#: Terms from the vocabulary that may become a filter, as a request's own terms are; more are joined.
NAMED_TERMS = 1000


def ascii_tokens(text: Column) -> Column:
    """The plain analyzer: runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass
class Index:
    """postings (term, doc_id, tf, positions, and len where they are stored), lengths (doc_id, len), stats (n, tokens, avgdl), words (term, df) and counts (postings without positions) where they are stored."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    words: DataFrame | None = None
    counts: DataFrame | None = None

    def hits(self) -> DataFrame:
        return self.counts if self.counts is not None else self.postings.drop("positions")

    def vocabulary(self) -> DataFrame:
        return self.words if self.words is not None else self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build(docs: DataFrame, text: str = "text", key: str = "doc_id", analyze: Callable[[Column], Column] = ascii_tokens) -> Index:
    """Index the live rows of docs. Positions count from 0; a null text has no terms but counts as a document."""
    rows = tokenized(docs, text, key, analyze)
    lengths = lengths_of(rows)
    return Index(postings_of(rows), lengths, stats_of(lengths))


def tokenized(docs: DataFrame, text: str, key: str, analyze: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(analyze(F.col(text)), F.array().cast("array<string>")).alias("tokens"))


def postings_of(rows: DataFrame) -> DataFrame:
    spread = rows.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    return spread.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.size("tokens").cast("long").alias("len"))


def stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("tokens")).withColumn("avgdl", F.col("tokens") / F.col("n"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avgdl: Column, n: Column, df: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def weights(terms: Sequence[str] | Sequence[tuple[str, float]]) -> dict[str, float]:
    """Each occurrence of a term counts, so a term given twice weighs twice."""
    total: dict[str, float] = {}
    for t in terms:
        term, boost = t if isinstance(t, tuple) else (t, 1.0)
        total[term] = total.get(term, 0.0) + boost
    return total


def query_terms(spark, terms: Sequence[str] | Sequence[tuple[str, float]]) -> DataFrame:
    """(term, weight), as one literal."""
    rows = sorted(weights(terms).items())
    if not rows:
        return spark.createDataFrame([], "term string, weight double")
    pairs = F.create_map(*(F.lit(x) for term, weight in rows for x in (term, float(weight))))
    return spark.range(0, 1, 1, 1).select(F.explode(pairs).alias("term", "weight"))


def scores(index: Index, terms: DataFrame | dict[str, float], eligible: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of the documents with any of the terms; statistics stay store-wide under a filter.

    Terms that the request names, {term: weight}, are a filter on the postings and prune their files. Terms that the
    vocabulary of a stored index names, (term, weight), are so too, up to NAMED_TERMS; where they are more, Spark chooses the join.
    """
    hits, words = index.hits(), index.words
    if words is not None and not isinstance(terms, dict):
        found = terms.select("term", "weight").limit(NAMED_TERMS + 1).collect()
        if len(found) <= NAMED_TERMS:
            terms = weights([tuple(r) for r in found])
    if isinstance(terms, dict):
        if not terms:
            return hits.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        hits = hits.where(F.col("term").isin(*terms))
        words = words.where(F.col("term").isin(*terms)) if words is not None else None
        table = F.broadcast(query_terms(hits.sparkSession, list(terms.items())))  # as many rows as the request has terms
    else:
        table = terms
    if words is None:
        words = hits.join(table.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    table = table.join(words, "term")
    rows = hits.join(F.broadcast(table) if isinstance(terms, dict) else table, "term")
    if eligible is not None:
        rows = rows.join(eligible.select("doc_id").distinct(), "doc_id", "left_semi")
    if "len" not in rows.columns:
        rows = rows.join(index.lengths, "doc_id")
    rows = rows.join(F.broadcast(index.stats))  # one row
    one = bm25(F.col("tf"), F.col("len"), F.col("avgdl"), F.col("n"), F.col("df"), k1, b)
    return rows.groupBy("doc_id").agg(F.sum(F.col("weight") * one).alias("score"))


def top_k(ranked: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    if digits is not None:
        ranked = ranked.withColumn("score", F.round("score", digits))
    return ranked.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


def field_scores(indexes: dict[str, tuple[Index, float]], terms: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """BM25 over weighted fields: term counts and lengths are summed with their field's weight before saturation."""
    postings = lengths = None
    for index, weight in indexes.values():
        asked = F.broadcast(query_terms(index.postings.sparkSession, list(terms.items())))  # as many rows as the request has terms
        p = index.hits().where(F.col("term").isin(*terms)).join(asked, "term").select("term", "weight", "doc_id", (F.col("tf") * weight).alias("tf"))
        n = index.lengths.select("doc_id", (F.col("len") * weight).alias("len"))
        postings = p if postings is None else postings.unionByName(p)
        lengths = n if lengths is None else lengths.unionByName(n)
    postings = postings.groupBy("term", "weight", "doc_id").agg(F.sum("tf").alias("tf"))
    lengths = lengths.groupBy("doc_id").agg(F.sum("len").alias("len"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    found = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = postings.join(F.broadcast(found), "term").join(lengths, "doc_id").join(F.broadcast(stats))
    return rows.groupBy("doc_id").agg(F.sum(F.col("weight") * bm25(F.col("tf"), F.col("len"), F.col("avgdl"), F.col("n"), F.col("df"), k1, b)).alias("score"))


def phrase_documents(index: Index, phrase: Sequence[str], slop: int = 0) -> DataFrame:
    """(doc_id) of the documents that hold the phrase: positions q0 <= q1 <= ... whose displacements from q0 + i sum to at most slop.

    The terms' position lists of a document meet in one row, and a fold over the terms keeps, for every start,
    the reachable (position, slop spent) pairs; nothing is joined per position.
    """
    places = index.postings.where(F.col("term").isin(*set(phrase)))
    lists = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p"))
    lists = lists.where(F.size("p") == len(set(phrase)))
    if slop == 0:
        first = F.col("p")[phrase[0]]
        return lists.where(F.exists(first, lambda q: _all(F.array_contains(F.col("p")[t], q + i) for i, t in enumerate(phrase)))).select("doc_id")
    state = F.transform(F.col("p")[phrase[0]], lambda q: F.struct(q.alias("first"), q.alias("last"), F.lit(0).alias("spent")))
    for i, t in enumerate(phrase[1:], 1):
        places = F.col("p")[t]

        def step(s, places=places, i=i):
            spent = lambda q: s["spent"] + F.abs(q - s["first"] - i)
            near = F.filter(places, lambda q: (q >= s["last"]) & (spent(q) <= slop))
            return F.transform(near, lambda q: F.struct(s["first"].alias("first"), q.alias("last"), spent(q).alias("spent")))

        state = F.array_distinct(F.flatten(F.transform(state, step_of(step))))
    return lists.where(F.size(state) > 0).select("doc_id")


def step_of(step):
    return lambda s: step(s)


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def phrase_scores(index: Index, phrase: Sequence[str], slop: int = 0) -> DataFrame:
    """A gate, then BM25 once for each of the phrase's terms."""
    return scores(index, weights(list(phrase)), phrase_documents(index, phrase, slop))


def prefix_terms(index: Index, prefix: str) -> DataFrame:
    """(term, weight) of every indexed term that begins with the prefix."""
    if not prefix:
        raise ValueError("an empty prefix")
    return index.vocabulary().where(F.col("term").startswith(prefix)).select("term").withColumn("weight", F.lit(1.0))


def typeahead_terms(index: Index, terms: Sequence[str], prefix: str) -> DataFrame:
    """Whole terms, and what their last word may become: the EXPANSIONS most frequent terms under the prefix and the
    vocabulary's own proper prefixes of it of 3 letters or more; each weighs 1000 div n thousandths."""
    if not prefix:
        raise ValueError("an empty prefix")
    spark = index.postings.sparkSession
    shorter = [prefix[:i] for i in range(3, len(prefix))]
    words = index.vocabulary().where(F.col("term").startswith(prefix) | (F.col("term").isin(*shorter) if shorter else F.lit(False)))
    kept = words.orderBy(F.desc("df"), F.asc("term")).limit(EXPANSIONS)
    n = kept.agg(F.count(F.lit(1)).alias("n"))
    share = F.floor(F.lit(1000) / F.col("n")) / 1000.0
    grown = kept.join(F.broadcast(n)).select("term", share.alias("weight"))
    return query_terms(spark, list(terms)).union(grown).groupBy("term").agg(F.sum("weight").alias("weight"))


FUZZY_BOOST = (1.0, 0.5, 0.25)


def fuzzy_distance(term: str) -> int:
    """How many edits a term may have: none with a digit or under 5 letters, 1 from 5, 2 from 9."""
    if any(c.isdigit() for c in term):
        return 0
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


def fuzzy_terms(index: Index, term: str, most: int | None = None, same_first: bool = False) -> DataFrame:
    """(term, weight) of the indexed terms within `most` edits (at most 2)."""
    most = fuzzy_distance(term) if most is None else most
    if not 0 <= most <= 2:
        raise ValueError("at most 2 edits")
    d = F.levenshtein(F.col("term"), F.lit(term), most)
    words = index.vocabulary().where(F.length("term").between(len(term) - most, len(term) + most)).select("term").withColumn("d", d).where("d >= 0")
    if same_first:
        words = words.where(F.substring("term", 1, 1) == term[:1])
    weight = F.element_at(F.array(*map(F.lit, FUZZY_BOOST)), F.col("d") + 1)
    return words.select("term", weight.alias("weight"))


def phonetic_terms(index: Index, term: str) -> DataFrame:
    """(term, weight 0.25) of the indexed terms that sound like the term."""
    from ..functions.phonetic import code, code_udf

    words = index.vocabulary().select("term")
    return words.where(code_udf()("term") == code(term)).select("term", F.lit(0.25).alias("weight")) if code(term) else words.where(F.lit(False)).select("term", F.lit(0.25).alias("weight"))
