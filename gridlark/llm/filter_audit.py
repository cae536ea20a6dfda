"""Filter interaction audit: what each filter removes in every order of five filters, from the edges of the subset lattice.

A step of an order is an edge of the lattice of filter subsets: (filters already applied, next filter). There are 5 * 2**4 = 80
edges, and the 600 steps of the 120 orders share them. Every document adds to all 80 edges of its part; documents that fail the
same filters add the same, so they are counted by (part, failed filters) where they are read and at most 32 rows a part go on.
The edges' sums are then joined to the steps, each order being a path from the empty set to the full one.

Filters, by the condition that fails a text (a null text counts as empty; words: maximal runs without ASCII white space):

    A  fewer than 200 words
    B  100 * different words < 50 * words (a text without words passes)
    C  100 * letters A-Z > 2 * code points
    D  a character out of #$%&*|
    E  the same text as a row with a smaller id, anywhere in the table

Cases: null and empty texts are the same text; a row with a null id has no smaller id and isn't one, so it never fails E; rows that
repeat an id are documents of their own, and the same text twice under one id fails E for neither; a null part is the empty
string; labels that repeat an id count as good (toxic) if any of them says so, other and missing labels as neither; extra
columns of both inputs are ignored; an empty table gives no part and so no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, text_of, written

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2


def text_failures(text: str, words: str) -> Column:
    """Bits of the filters A to D that a text column fails; words: the column of its words."""
    n, chars = F.size(words), F.char_length(text)
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * chars,
        F.col(text).rlike(r"[#$%&*|]"),
    )
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row: bit k of the mask is set if filter k fails. Texts are read once and never shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    # Two hashes tell texts apart.
    rows = written(rows.select("id", "part", text_failures("t", "w").alias("mask"), F.xxhash64("t").alias("t1"), F.xxhash64(F.lit(1), "t").alias("t2")), "filter-failures")
    # Only texts with several ids have a row that fails E; min and max are merged where rows are read, however many copies there are.
    firsts = rows.groupBy("t1", "t2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    joined = rows.join(bounded(written(firsts, "filter-copies")), ["t1", "t2"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return joined.select("id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def counted(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    says = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).where("good + toxic > 0")
    both = failures.join(marks, "id", "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def lattice_edges() -> list[tuple[int, int]]:
    """The 80 pairs (applied filters as bits, next filter)."""
    return [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]


def edge_sums(counts: DataFrame) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part's 80 edges."""
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in lattice_edges()])
    rows = counts.select("*", F.inline(edges))
    fails = F.expr("mask & shiftleft(1, filter)") != 0
    gone = F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda of, when, name: F.sum(F.when(when, F.col(of)).otherwise(0)).alias(name)
    sums = rows.groupBy("part", "applied", "filter").agg(
        total("n", ~gone & ~fails, "kept"),
        total("n", ~gone & fails, "removed"),
        total("n", gone & fails, "redundant"),
        total("n", F.expr("mask = shiftleft(1, filter)"), "unique_fails"),
        total("good", ~gone & fails, "good_lost"),
        total("toxic", ~gone & fails, "toxic_lost"),
    )
    # So many orders pass along an edge: those of the filters before it times those of the filters after it.
    before = F.bit_count("applied").cast("int")
    paths = F.factorial(before) * F.factorial(F.lit(len(FILTERS) - 1) - before)
    shares = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * paths).alias("shapley"))
    return sums.join(shares, ["part", "filter"])


def path_steps(spark) -> DataFrame:
    """(filter_order, step, applied, filter): the 600 steps of all orders as lattice edges."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, applied = "".join(FILTERS[f] for f in order), 0
        for k, f in enumerate(order):
            steps.append((name, k + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", part_as: str = "part",
) -> DataFrame:
    """One row for each part, order of the filters and step, with that step's counts within the part."""
    edges = edge_sums(counted(document_failures(docs, id_col, text_col, part_col), labels, id_col))
    out = edges.join(F.broadcast(path_steps(docs.sparkSession)), ["applied", "filter"])  # 600 rows
    return out.select(
        F.col("part").alias(part_as), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), mark AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS smallest FROM doc GROUP BY t),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > smallest THEN 16 ELSE 0 END AS mask
  FROM doc JOIN least USING (t) LEFT JOIN mark USING (doc_id)
), tally AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS name, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT array_to_string(name, '') AS filter_order, CAST(k AS INT) AS step, bits[k] AS f, coalesce(list_sum(bits[:k - 1]), 0)::INT AS applied
  FROM o, (SELECT unnest(range(1, 6)) AS k)
), stepped AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, mask & f <> 0 AS bad, mask & applied <> 0 AS gone, mask = f AS only_this FROM tally, s
), summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND bad), 0) AS redundant, coalesce(sum(n) FILTER (only_this), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (NOT gone AND bad), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND bad), 0) AS toxic_lost
  FROM stepped GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
