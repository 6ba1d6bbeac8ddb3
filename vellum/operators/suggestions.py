"""Title and author suggestions: building, candidates, scoring, top-n."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.constants import (
    AUTHOR_RANK, SIMILARITY_MIN, SUGGEST_LIMIT, TITLE_RANK, WORD_SIMILARITY_MIN,
)
from vellum.functions.text import normalize_suggestion, strip
from vellum.functions.trigram import (
    is_prefix, is_word_prefix, like_pattern, ordered_trigrams, similarity, suggestion_score, with_word_similarity,
)
from vellum.operators.merges import keep_first, replace_set
from vellum.operators.retrieval import top_k
from vellum.session import has_at_most, union_all

#: LIKE-only queries of less than two letters that are copied to the values.
SHORT_QUERIES = 10_000


def distinct_authors(books: DataFrame) -> DataFrame:
    """(book_id, pos, value, normalized_value): first spelling of each author."""
    spread = books.select("book_id", F.posexplode("authors").alias("pos", "_name"))
    named = spread.select(
        "book_id", "pos", strip(F.col("_name")).alias("value"),
        normalize_suggestion(strip(F.col("_name"))).alias("normalized_value"),
    ).filter(F.length("normalized_value") > 0)
    return keep_first(named, ["book_id", "normalized_value"], [F.col("pos")])


def suggestion_rows(books: DataFrame) -> DataFrame:
    """One row per title and author, unique by (book_id, source_key)."""
    titles = (
        books.select("book_id", strip(F.col("title")).alias("value"), normalize_suggestion(F.col("title")).alias("normalized_value"))
        .filter(F.length("normalized_value") > 0)
        .select("book_id", F.lit("BOOK_TITLE").alias("kind"), F.lit("book:title").alias("source_key"), "value",
                "normalized_value", F.lit(TITLE_RANK).alias("rank"))
    )
    authors = distinct_authors(books).select(
        "book_id", F.lit("AUTHOR").alias("kind"), F.concat(F.lit("book:author:"), F.col("normalized_value")).alias("source_key"),
        "value", "normalized_value", F.lit(AUTHOR_RANK).alias("rank"),
    )
    return union_all(titles, authors)


def sync_suggestions(existing: DataFrame, books: DataFrame) -> DataFrame:
    """Replace the title and author rows of the given books."""
    managed = existing.filter(F.col("kind").isin("BOOK_TITLE", "AUTHOR"))
    other = existing.filter(~F.col("kind").isin("BOOK_TITLE", "AUTHOR"))
    return union_all(replace_set(managed, suggestion_rows(books), books, ["book_id"]), other)


def not_deleted(books: DataFrame) -> DataFrame:
    return books.filter(F.col("status") != "DELETED")


def live_suggestions(suggestions: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of books that are not deleted."""
    return suggestions.join(not_deleted(books).select("book_id"), "book_id")


def pool_size(limit: int) -> int:
    return max(8 * limit, 24)


def value_pool(live: DataFrame, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """Rows that can reach a candidate pool.

    All rows of one normalised value score alike for any query, so only the
    first `pool_size` of them can ever enter the pool. This is exact and keeps
    a value shared by a third of all books from multiplying later joins.
    """
    order = [F.desc("rank"), F.length("value").asc(), F.asc("book_id"), F.asc("source_key")]
    return top_k(live, ["normalized_value"], order, pool_size(limit), "_r").drop("_r")


def value_grams(values: DataFrame) -> DataFrame:
    """Distinct values with their trigram lists, ordered and distinct."""
    return values.select("normalized_value").distinct().withColumn(
        "ordered", ordered_trigrams(F.col("normalized_value"))
    ).withColumn("grams", F.array_distinct("ordered"))


def prepare_queries(queries: DataFrame, escape: bool = False) -> DataFrame:
    """Adds the normalised query `q`, its trigrams and how candidates are found."""
    normal = queries.withColumn("q", normalize_suggestion(F.col("query"))).filter(F.length("q") > 0)
    listed = normal.withColumn("q_grams", F.array_distinct(ordered_trigrams(F.col("q"))))
    wild = F.lit(False) if escape else F.col("q").rlike(r"[%_\\]")
    return listed.withColumns(
        {
            # too short for similarity: only the LIKE rules apply
            "by_grams": (F.length("q") >= 3) & (F.size("q_grams") > 0),
            # trigrams cannot find every LIKE match of these
            "by_start": (F.length("q") < 3) | wild | (F.size("q_grams") == 0),
        }
    )


def gram_candidates(prepared: DataFrame, grams: DataFrame) -> DataFrame:
    """(query_id, normalized_value) pairs that may reach a similarity threshold.

    A match shares at least t = ceil(0.18 n) of the query's n trigrams, so it
    holds one of any n - t + 1 of them. Taking the rarest ones keeps the
    longest posting lists out of the join and loses nothing.
    """
    postings = grams.select("normalized_value", F.explode("grams").alias("gram"))
    asked = prepared.filter("by_grams").select("query_id", F.size("q_grams").alias("n"), F.explode("q_grams").alias("gram"))
    wanted = postings.join(asked.select("gram").distinct(), "gram", "left_semi")
    frequency = wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    least = min(SIMILARITY_MIN, WORD_SIMILARITY_MIN)
    w = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)).asc(), F.asc("gram"))
    rare = (
        asked.join(frequency, "gram", "left")
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= F.col("n") - F.ceil(F.round(F.col("n") * least, 9)) + 1)
        .filter(F.col("df") > 0)
        .select("query_id", "gram")
    )
    return rare.join(postings, "gram").select("query_id", "normalized_value").distinct()


def start_candidates(prepared: DataFrame, grams: DataFrame, escape: bool = False) -> DataFrame:
    """Pairs for LIKE-only queries: equal first two letters at a word start.

    The key is the literal part of the pattern before its first wildcard. A
    pattern with less than two literal letters can match values of any key:
    these queries, if few, are copied to where the values are and compared in
    place, so no letter becomes a hot key; many are dealt over salts with the
    values. Only matches leave either way.
    """
    plain = F.col("q") if escape else F.regexp_extract(F.col("q"), r"^[^%_\\]*", 0)
    asked = prepared.filter("by_start").select("query_id", "q", F.substring(plain, 1, 2).alias("key"))
    value = F.col("normalized_value")
    rests = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))),
            lambda i: (i == 1) | (F.substring(value, i - 1, F.lit(1)) == " "),
        ),
        lambda i: F.substring(value, i, F.lit(2)),
    )
    starts = grams.select("normalized_value", F.explode(F.array_distinct(rests)).alias("key"))
    keyed = asked.filter(F.length("key") == 2).join(starts, "key").select("query_id", "normalized_value")
    short = asked.filter(F.length("key") < 2).select("query_id", "q")
    matches = is_prefix(value, F.col("q"), escape) | is_word_prefix(value, F.col("q"), escape)
    values = grams.select("normalized_value")
    if has_at_most(short, SHORT_QUERIES):
        pairs = values.join(F.broadcast(short), matches)
    else:
        salts = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copied = short.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = values.withColumn("_salt", F.pmod(F.xxhash64("normalized_value"), F.lit(salts)).cast("int")).join(copied, "_salt").filter(matches)
    return union_all(keyed, pairs.select("query_id", "normalized_value")).distinct()


def scored_values(prepared: DataFrame, grams: DataFrame, escape: bool = False) -> DataFrame:
    """(query_id, normalized_value, score) of all values that match a query."""
    pairs = union_all(gram_candidates(prepared, grams), start_candidates(prepared, grams, escape)).distinct()
    rows = pairs.join(prepared.select("query_id", "q", "q_grams"), "query_id").join(grams, "normalized_value")
    value, q = F.col("normalized_value"), F.col("q")
    fuzzy = F.length(q) >= 3
    sim = F.when(fuzzy, similarity(F.col("grams"), F.col("q_grams"))).otherwise(0.0)
    shared = F.size(F.array_intersect("grams", "q_grams")) / F.size("q_grams")
    liked = is_prefix(value, q, escape) | is_word_prefix(value, q, escape)
    # no run of trigrams can score above the share of the query's trigrams it may hold,
    # so the costly measure is left to the pairs that can still match
    possible = rows.withColumns({"sim": sim, "liked": liked}).filter(
        F.col("liked") | (fuzzy & ((F.col("sim").cast("float") >= SIMILARITY_MIN) | (shared.cast("float") >= WORD_SIMILARITY_MIN)))
    )
    measured = with_word_similarity(possible, "q_grams", "ordered").withColumn("word_sim", F.when(fuzzy, F.col("word_sim")).otherwise(0.0))
    matches = F.col("liked") | (
        fuzzy & ((F.col("sim").cast("float") >= SIMILARITY_MIN) | (F.col("word_sim").cast("float") >= WORD_SIMILARITY_MIN))
    )
    return measured.filter(matches).select(
        "query_id", "normalized_value",
        suggestion_score(value, q, F.col("sim"), F.col("word_sim"), escape).alias("score"),
    )


def top_suggestions(scored: DataFrame, pool: DataFrame, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """Candidate pool by score, rank and length; one row per value; first `limit`."""
    rows = scored.join(pool, "normalized_value")
    order = [F.desc("score"), F.desc("rank"), F.length("value").asc(), F.asc("book_id"), F.asc("source_key")]
    candidates = top_k(rows, ["query_id"], order, pool_size(limit), "pool_rank")
    single = keep_first(candidates, ["query_id", "normalized_value"], [F.col("pool_rank")])
    return top_k(single, ["query_id"], [F.desc("score"), F.asc("pool_rank")], limit, "position")
