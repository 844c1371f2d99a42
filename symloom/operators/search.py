"""Prefix search over names, ranked by BM25, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.session import cut

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
KEY = 4


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ranked_matches(rows: DataFrame, key: str, columns: list[str], queries: DataFrame, top: int | None, listed: Column | None = None) -> DataFrame:
    """(query, key, score, place) of the rows in which every term of a query begins a token.

    The score is BM25 over the tokens of all ``columns``, negated, so that the least is the best;
    terms with a frequency of more than half of the rows weigh next to nothing. ``place`` counts
    from the best, ties by key; ``top`` is the report's length. A query without terms finds nothing.
    Only rows for which ``listed`` holds are found; the others count in the frequencies.

    Terms meet the dictionary of distinct tokens by their first characters, not the rows. Queries of
    the same terms are one search. A search begins with the rows of its rarest term, and only these
    meet the other terms, so common terms cost a search nothing unless it has no other.
    """
    counted = F.concat(*[F.coalesce(tokens(c), F.array().cast("array<string>")) for c in columns])
    documents = rows.select(F.col(key).alias("doc"), counted.alias("tokens"), (F.lit(True) if listed is None else F.coalesce(listed, F.lit(False))).alias("listed"))
    (n, mean), = documents.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).collect()
    postings = cut(documents.select("doc", "listed", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("token", "doc", "length", "listed").agg(F.count(F.lit(1)).alias("tf")))
    heads = postings.select("token").distinct().select("token", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("token"))), lambda i: F.substring("token", F.lit(1), i))).alias("head"))
    asked = queries.select("query").where("query IS NOT NULL").distinct().select("query", F.array_sort(F.array_distinct(tokens("query"))).alias("terms"))
    searches = asked.select("terms").where(F.size("terms") > 0).distinct()
    terms = searches.select("terms", F.explode("terms").alias("term"))
    known = terms.select("term", F.substring("term", 1, KEY).alias("head")).distinct().join(heads, "head").where(F.startswith("token", "term")).select("term", "token")
    by_term = cut(known.join(postings, "token").groupBy("term", "doc", "length", "listed").agg(F.sum("tf").alias("tf")))
    frequency = by_term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    # A term that no token has makes its search empty, so it counts as the rarest.
    weighed = terms.join(frequency, "term", "left").groupBy("terms").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rarest"), F.collect_list(F.struct("term", idf.alias("idf"))).alias("each"))
    found = weighed.where("rarest.df > 0").select("terms", "each", F.col("rarest.term").alias("term"))
    score = lambda idf: idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    begun = found.join(by_term.where("listed"), "term")
    alone = begun.where(F.size("terms") == 1).select("terms", "doc", score(F.col("each")[0]["idf"]).alias("sum"))
    met = begun.where(F.size("terms") > 1).select("terms", "doc", F.explode("each").alias("t")).select("terms", "doc", "t.term", "t.idf").join(by_term.select("term", "doc", "length", "tf"), ["term", "doc"])
    several = met.groupBy("terms", "doc").agg(F.count(F.lit(1)).alias("hits"), F.sum(score(F.col("idf"))).alias("sum")).where(F.col("hits") == F.size("terms")).select("terms", "doc", "sum")
    scored = alone.unionByName(several).select("terms", F.col("doc").alias(key), F.round(-F.col("sum"), 9).alias("score"))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("terms").orderBy("score", key)))
    best = placed.where(F.col("place") <= top) if top else placed
    return asked.join(best, "terms").select("query", key, "score", "place")
