"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items and documents become sets of five-word shingles (words: runs of letters and digits, lower-cased); an item of fewer
words is one shingle of all its words. Items are partitioned by the size of their sets; in the partition up to size u each
item keeps its floor((1 - t) u) + 1 smallest MinHash values. A document that contains at least the share t of an item lacks at
most floor((1 - t) u) of its shingles, so it must hold one of the kept ones: the search loses nothing. Documents too small for
an item's partition are left out of its comparisons. Candidate pairs are verified on the shingles themselves.

Only DataFrame operations run. A document's shingles are hashed and probed where they are read, so neither they nor the
texts are shuffled; only candidate pairs and the shingles of candidate documents are.

Cases: null and empty texts and items without words contain nothing and are contained in nothing; rows that share an id
(a null one too) count as one document; items with equal ids count as one if their texts are equal, else as several with one
id, of which the best contained is returned; extra columns of the input are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, text_of, written

WIDTH = 5
SHARE = 0.8


def words(col: str) -> Column:
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(words_col: str, width: int) -> Column:
    """array<long>: the hash of each run of `width` words, in text order; none in shorter texts."""
    parts = ", ".join(f"get({words_col}, i + {k})" for k in range(width))
    return F.expr(f"if(size({words_col}) >= {width}, transform(sequence(0, size({words_col}) - {width}), i -> xxhash64({parts})), cast(array() as array<bigint>))")


def shingle_strings(words_col: str, width: int) -> Column:
    return F.expr(
        f"if(size({words_col}) >= {width}, array_distinct(transform(sequence(0, size({words_col}) - {width}), "
        f"i -> array_join(slice({words_col}, i + 1, {width}), ' '))), cast(array() as array<string>))"
    )


def item_sets(items: DataFrame, width: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, width, size, shingles, part) of each item that has words; item: the text's hash and id."""
    sets = (
        items.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("_t"))
        .distinct()
        .select("item_id", F.xxhash64("item_id", "_t").alias("item"), words("_t").alias("_w"))
        .where(F.size("_w") > 0)
        .withColumn("width", F.least(F.size("_w"), F.lit(width)))
        .withColumn("shingles", F.when(F.size("_w") >= width, shingle_strings("_w", width)).otherwise(F.array(F.array_join("_w", " "))))
        .withColumn("size", F.size("shingles"))
    )
    part = F.floor(F.log2("size")).cast("int")
    return sets.select("item", "item_id", "width", "size", "shingles", part.alias("part"))


def sketches(sets: DataFrame, share: float) -> DataFrame:
    """The kept MinHash values of every item: (width, h, item, need, part)."""
    upper = F.pow(F.lit(2), F.col("part") + 1) - 1
    kept = (F.floor((1 - share) * upper + 1e-9) + 1).cast("int")
    hashed = sets.withColumn(
        "_m", F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(F.lit("minhash"), s).alias("v"), s.alias("s"))))
    )
    low = F.ceil(share * F.pow(F.lit(2), F.col("part")) - 1e-9).cast("int")
    return hashed.select("item", "width", "part", low.alias("need"), F.explode(F.slice("_m", F.lit(1), kept)).alias("_k")).select(
        "width", _hash_of_string("_k.s").alias("h"), "item", "need", "part"
    )


def _hash_of_string(col: str) -> Column:
    """The hash that shingle_hashes gives for the words of a space-joined shingle."""
    split = f"split({col}, ' ')"
    cases = " ".join(f"when {n} then xxhash64({', '.join(f'get({split}, {k})' for k in range(n))})" for n in range(1, WIDTH + 1))
    return F.expr(f"case size({split}) {cases} end")


def search(docs: DataFrame, sketch: DataFrame, widths: list[int]) -> DataFrame:
    """Candidate pairs (_id, item): the document holds a kept value and is large enough for the item's partition."""
    found = None
    for width in widths:
        probes = docs.select("_id", F.explode(shingle_hashes("_w", width)).alias("h"), F.size("_w").alias("_n"))
        side = sketch.where(F.col("width") == width).select("h", "item", "need")
        pairs = probes.join(bounded(side), "h").where(F.col("_n") - (width - 1) >= F.col("need")).select("_id", "item")
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def contained(
    docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair with at least the given share."""
    if width > WIDTH:
        raise ValueError(f"shingles of more than {WIDTH} words aren't supported")
    sets = written(item_sets(items, width, share, item_id, item_text), "items")
    widths = sorted(r.width for r in sets.select("width").distinct().collect())  # at most `width` numbers
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, n_shingles long, n_shared long, containment double"
    if not widths:
        return docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col(id_col).alias("_id"), words(text_col).alias("_w"))
    pairs = written(search(rows, written(sketches(sets, share), "item-sketches"), widths), "pairs")
    # Only candidate documents are read again as shingles, and only against their own items.
    ids = bounded(pairs.select(F.col("_id").alias("_c")).distinct())
    again = rows.join(ids, rows["_id"].eqNullSafe(ids["_c"]), "left_semi")
    shingles = None
    for w in widths:
        part = again.select("_id", F.lit(w).alias("width"), F.explode(shingle_strings("_w", w)).alias("s"))
        shingles = part if shingles is None else shingles.union(part)
    asked = sets.select("item", "item_id", "width", "size", F.explode("shingles").alias("s"))
    hits = shingles.join(bounded(asked), ["width", "s"])
    wanted = pairs.withColumnsRenamed({"_id": "_pid", "item": "_pitem"})
    counted = hits.groupBy("_id", "item", "item_id", "size").agg(F.count_distinct("s").alias("n_shared"))
    out = (
        counted.join(wanted, counted["_id"].eqNullSafe(wanted["_pid"]) & (counted["item"] == wanted["_pitem"]), "left_semi")
        .where(F.col("n_shared") >= share * F.col("size") - 1e-9)
        .groupBy("_id", "item_id")
        .agg(F.max(F.struct((F.col("n_shared") / F.col("size")).alias("c"), F.col("n_shared").alias("k"), F.col("size").alias("n"))).alias("_b"))
    )
    return out.select(
        F.col("_id").alias(id_col), "item_id", F.col("_b.n").cast("long").alias("n_shingles"), F.col("_b.k").alias("n_shared"), F.col("_b.c").alias("containment")
    )


ORACLE = r"""
WITH item AS (
  SELECT DISTINCT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), sized AS (SELECT item_id, text, w, least(len(w), 5) AS width FROM item WHERE len(w) > 0),
want AS (
  SELECT DISTINCT item_id, text, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT item_id, text, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM sized)
), total AS (SELECT item_id, text, count(*) AS n FROM want GROUP BY ALL),
doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
have AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc, (SELECT DISTINCT width FROM sized) WHERE len(w) >= width)
), shared AS (SELECT doc_id, item_id, text, count(*) AS k FROM have JOIN want USING (width, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / n AS containment
FROM shared JOIN total USING (item_id, text) WHERE k >= 0.8 * n - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(k AS DOUBLE) / n DESC, k DESC) = 1
"""
