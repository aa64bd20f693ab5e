"""Record text search, for one query and for a table of queries."""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from carelattice.functions.ordered import null_safe_join
from carelattice.functions.text import contains_pattern, contains_pattern_of
from carelattice.schemas import SEARCH_HIT
from carelattice.session import cut_lineage

# Queries without a whole word that are looked for in one pass over the texts.
QUERIES_PER_PASS = 100
# Share of the records that says which of a query's words are rare. It only orders them.
SAMPLED = 0.02

_WORD = "[\\p{L}\\p{N}]+"
# A word with something else on both sides stands in a matching text as the same whole word.
_WHOLE_WORD = "(?<=[^\\p{L}\\p{N}])[\\p{L}\\p{N}]+(?=[^\\p{L}\\p{N}])"


def record_search(records: DataFrame, q: str, columns: list[str] | None = None) -> DataFrame:
    """Records whose body contains `q`, any case; wildcards in `q` stay live. Without `columns`, those of
    a search hit that the records have."""
    if len(q) < 1:
        raise ValueError("q must have at least one character")
    hits = records.where(F.col("body").ilike(contains_pattern(q)))
    return hits.select(*(columns or [c for c in SEARCH_HIT if c in records.columns]))


def _pairs(words: Column) -> Column:
    """Hashes of each two words that follow each other."""
    rest = F.size(words) - 1
    both = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.xxhash64(a, b))
    return F.when(rest > 0, both).otherwise(F.array().cast("array<bigint>"))


def _singles(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_anchors(queries: DataFrame) -> DataFrame:
    """Each valid query with its pattern and the hashes of its pairs of whole words, or else of its
    whole words: a text that matches the pattern holds them all."""
    pieces = F.split(F.lower("q"), "[%_\\\\]")
    words = F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(_WHOLE_WORD), F.lit(0)))
    pairs = F.flatten(F.transform("_words", _pairs))
    anchors = F.when(F.size(pairs) > 0, pairs).otherwise(_singles(F.flatten("_words")))
    return (
        queries.where(F.length("q") >= 1)
        .select(
            "query_id", contains_pattern_of(F.col("q")).alias("pattern"), words.alias("_words"),
            F.array_distinct(F.filter(pieces, lambda p: p != "")).alias("pieces"),
            F.monotonically_increasing_id().alias("_number"),
        )
        .withColumn("anchors", F.array_distinct(anchors))
        .drop("_words")
    )


def _held_anchors(records: DataFrame, key: list[str]) -> DataFrame:
    """The hashes that a query can be found by, for every record."""
    words = F.regexp_extract_all(F.lower("body"), F.lit(_WORD), F.lit(0))
    split = records.select(*key, words.alias("_words"))
    held = F.array_distinct(F.concat(_pairs(F.col("_words")), _singles(F.col("_words"))))
    return split.select(*key, F.explode(held).alias("_anchor"))


def record_search_many(records: DataFrame, queries: DataFrame) -> DataFrame:
    """All (query, record) hits for a table of queries (`query_id`, `q`): the records' columns and query_id.

    A query is found by the rarest of its pairs of whole words: an equi-join with the words of the records
    that carries hashes and the records' other columns, never their bodies. Bodies join back for the
    candidates, and ILIKE decides. Queries without a whole word are tested on every body, QUERIES_PER_PASS
    at a time. Records that share all columns but the body are told apart by the last test.
    """
    key = [c for c in records.columns if c != "body"]
    numbered = cut_lineage(_with_anchors(queries), "queries")
    wanted = numbered.select("_number", F.explode("anchors").alias("_anchor"))
    often = (
        _held_anchors(records.sample(SAMPLED, 7), key[:0])
        .join(wanted.select("_anchor").distinct(), "_anchor", "left_semi")
        .groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
    )
    rank = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_anchor").alias("anchor"))
    rarest = cut_lineage(
        wanted.join(often, "_anchor", "left").groupBy("_number").agg(F.min(rank).alias("_rarest"))
        .select("_number", F.col("_rarest.anchor").alias("_anchor")),
        "anchors",
    )
    candidates = _held_anchors(records, key).join(rarest, "_anchor").select(*key, "_number").distinct()
    patterns = numbered.select("_number", "query_id", "pattern")
    found = (
        null_safe_join(records, candidates, key, "inner")
        .join(patterns, "_number")
        .where(F.expr("body ilike pattern"))
        .drop("_number", "pattern")
    )
    short = numbered.where(F.size("anchors") == 0).select("_number", "pattern", "pieces")
    passes = [_one_pass(records, part).join(patterns.drop("pattern"), "_number").drop("_number") for part in _parts(short)]
    return reduce(DataFrame.unionByName, passes, found)


def _parts(queries: DataFrame) -> Iterator[list[Row]]:
    part: list[Row] = []
    for row in queries.toLocalIterator():
        part.append(row)
        if len(part) == QUERIES_PER_PASS:
            yield part
            part = []
    if part:
        yield part


def _one_pass(records: DataFrame, queries: list[Row]) -> DataFrame:
    """The records with the number of each of the queries that they match. A text that lacks a literal
    piece of a query is not tested any further."""
    def test(query: Row) -> Column:
        held = F.col("body").isNotNull()
        for piece in query["pieces"]:
            held = held & F.contains(F.lower("body"), F.lit(piece))
        return F.when(held & F.col("body").ilike(query["pattern"]), F.lit(query["_number"]).cast("long"))

    tests = [test(query) for query in queries]
    return records.withColumn("_number", F.explode(F.array_compact(F.array(*tests))))
