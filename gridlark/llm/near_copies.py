"""Near copies by the exact Jaccard similarity of word shingles, with SimHash's words and hashes.

A text is the set of its word shingles' 64-bit hashes (simhash.py's words and hashes). Texts are linked if their sets' Jaccard
similarity is at least `SHARE`, and components of links are the groups.

SimHash comes first (simhash.py): sets whose fingerprints of the same shingles chain by at most four differing places, found
through its pivot tables, are verified against the first of their chain. That finds the close copies only: at a similarity of
0.8 fingerprints differ in about ten places. An exact search finds the rest.

That search loses no link. Under one order of all shingles, a set of n keeps the first n - ceil(SHARE n) + 1 as its keys; two
linked sets share at least ceil(SHARE n) shingles of either, so they have a key in common (prefix filter). Any order will do;
shingles in crowded buckets of a count of all shingles come last, so that common passages are seldom keys.

Sets that share a key are compared by their sketches first: of `BITS` parts of the shingle space, those in which a set has an
odd number of shingles. Two sketches differ in at most as many places as there are shingles that only one of the sets has.
Pairs that differ in more than the similarity allows are discarded inside the join; long sets have a second, longer sketch, by
which their pairs are sifted next. Survivors are verified on the two sets, made anew from the texts, so that no set is kept on disk.

Groups of copies cost no pairs: equal sets count once; each set is first compared with one leader only, out of those of its
keys' buckets the one that meets most others; after that, only sets outside the bucket's largest component are compared, with
those of other components.

Cases: a null text counts as empty; texts without words are copies of one another; repeats of an id are rows of their own; rows
with a null id join components but never name one; extra columns of the input are ignored; an empty table gives an empty table;
long texts count whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, components, dropped, text_of, written
from gridlark.llm.simhash import fingerprint_of, linked, shingle_hashes, signed

WIDTH = 5
SHARE = 0.8
#: Bits of a sketch.
BITS = 1024
#: Buckets of the count of all shingles, which orders them.
BUCKETS = 1 << 18


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted different shingle hashes, as signed longs."""
    return different(shingle_hashes(text, width))


def different(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, dtype="<u8").view("<i8"))


def crowded(docs: DataFrame, text_col: str, width: int, set_of: Callable[[str, int], np.ndarray] = shingle_set, least: float = 2) -> np.ndarray:
    """For each bucket, the number of all texts' shingles in it if that is more than `least` times the average, else 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                h = set_of(t, width) & (BUCKETS - 1)
                seen += np.bincount(h, minlength=BUCKETS) if len(h) > BUCKETS // 16 else 0
                if len(h) <= BUCKETS // 16:
                    np.add.at(seen, h, 1)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"b": some.astype(np.int32), "n": seen[some]})

    counts = written(docs.select(text_of(text_col).alias("t")).mapInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")), "shingle-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(BUCKETS, dtype=np.int64)
    some = counts.where(F.col("n") > least * total / BUCKETS).toArrow()  # BUCKETS at most, as columns: rows of Python objects take ten times the memory
    out[some["b"].to_numpy()] = some["n"].to_numpy()
    dropped(counts)
    return out


def keys_of(h: np.ndarray, crowds: np.ndarray, share: float) -> np.ndarray:
    """The keys of a set."""
    n = len(h)
    return h[np.lexsort((h, crowds[h & (BUCKETS - 1)]))[: n - math.ceil(share * n - 1e-9) + 1]] if n else h


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """A sketch: `bits` bits, a power of two, as signed longs; half as many bits come from one by an exclusive or of its halves."""
    odd = np.bincount(h >> 24 & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def described(docs: DataFrame, crowds: np.ndarray, text_col: str, width: int, share: float) -> Column:
    """Column expression: struct of a text's set: its size, two hashes of it, its fingerprint, its sketches, its keys."""
    import xxhash

    shipped = docs.sparkSession.sparkContext.broadcast(crowds)

    @F.pandas_udf("n int, s1 long, s2 long, fp long, sketch array<long>, wide array<long>, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t, width)
            h = different(hashes)
            s = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype="<i8")
            wide = parities(h, 1 << (2 * len(h) - 1).bit_length()) if len(h) > BITS // 2 else None
            rows.append((len(h), s[0], s[1], signed(fingerprint_of(hashes)), parities(h, BITS), wide, keys_of(h, shipped.value, share)))
        return pd.DataFrame(rows, columns=["n", "s1", "s2", "fp", "sketch", "wide", "keys"])

    return of(text_of(text_col))


def _allowed(n: Column, m: Column, share: float) -> Column:
    """So many shingles, at most, has only one of two sets of these sizes and at least this similarity."""
    return (n + m) * ((1 - share) / (1 + share)) + 1e-9


def _possible(x: str, y: str, share: float) -> Column:
    """Sizes and sketches that allow the similarity."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(BITS // 64)), F.lit(0))
    return (F.least(n, m) >= share * F.greatest(n, m) - 1e-9) & (apart <= _allowed(n, m, share))


def sifted(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) without those of two long sets whose longer sketches rule them out; written to the shared folder."""
    long_sets = sets.where("wide is not null").select("at", F.struct("n", "wide").alias("s"))
    both = pairs.join(long_sets.withColumnsRenamed({"at": "a", "s": "x"}), "a", "left").join(long_sets.withColumnsRenamed({"at": "b", "s": "y"}), "b", "left")
    # Sizes that allow the similarity differ by less than half, so one sketch has twice the other's bits at most.
    folded = "if(size({0}.wide) > size({1}.wide), zip_with(slice({0}.wide, 1, size({1}.wide)), slice({0}.wide, size({1}.wide) + 1, size({1}.wide)), (p, q) -> p ^ q), {0}.wide)"
    apart = F.expr(f"aggregate(zip_with({folded.format('x', 'y')}, {folded.format('y', 'x')}, (p, q) -> bit_count(p ^ q)), 0, (c, d) -> c + d)")
    fits = F.coalesce(apart <= _allowed(F.col("x.n"), F.col("y.n"), share), F.lit(True))
    return written(both.where(fits).select("a", "b"), "copy-sifted")


def verified(
    pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, width: int, share: float, set_of: Callable[[str, int], np.ndarray] = shingle_set
) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is at least `share`; written to the shared folder.

    The sets of these pairs are made again from their texts, each once.
    """

    pairs = sifted(pairs, sets, share)

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([set_of(t, width) for t in texts], dtype=object)

    asked = bounded(written(sets.join(bounded(pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct()), "at", "left_semi").select("at", "t1", "t2"), "copy-asked"))
    texts = docs.select(text_of(text_col).alias("t")).select("t", *_text_hashes("t")).join(asked, ["t1", "t2"]).groupBy("at").agg(F.any_value("t").alias("t"))
    of = written(texts.select("at", hashes("t").alias("h")), "copy-sets")
    both = pairs.join(of.select(F.col("at").alias("a"), F.col("h").alias("x")), "a").join(of.select(F.col("at").alias("b"), F.col("h").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    out = written(both.where(shared >= share * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "copy-links")
    for done in (pairs, asked, of):
        dropped(done)
    return out


def _text_hashes(col: str) -> list[Column]:
    return [F.xxhash64(col).alias("t1"), F.xxhash64(F.lit(1), F.col(col)).alias("t2")]


def alike(sets: DataFrame) -> DataFrame:
    """(a, b): each set of a chain of fingerprints with the chain's first set."""
    prints = written(sets.select("at", "fp"), "copy-prints")
    placed = written(linked(prints.groupBy("fp").agg(F.min("at").alias("first"))), "copy-chains")
    first = placed.groupBy("root").agg(F.min("first").alias("b"))
    out = prints.join(placed.select("fp", "root"), "fp").join(first, "root").where("at <> b").select(F.col("at").alias("a"), "b")
    return written(out, "copy-alike")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(id, component_id) of every row."""
    crowds = crowded(docs, text_col, width)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).select("_id", *_text_hashes("t"), described(docs, crowds, "t", width, share).alias("_s"))
    # A row number tells rows apart, so that one row stands for all of an equal set whatever their ids.
    rows = written(rows.select(F.monotonically_increasing_id().alias("_at"), "_id", "t1", "t2", "_s.*"), "shingle-sets")
    known = written(rows.groupBy("s1", "s2").agg(F.min("_id").alias("first"), F.min("_at").alias("at")), "sets")
    sets = rows.withColumnRenamed("_at", "at").join(bounded(known.select("at")), "at", "left_semi")
    sketches = bounded(written(sets.select("at", "n", "sketch"), "copy-sketches"), 100_000)
    keys = sets.select("at", F.explode("keys").alias("key"))
    often = bounded(written(keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "copy-keys"))
    meet = written(keys.join(often, "key"), "copy-buckets")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that sizes and sketches allow."""
        x, y = (sketches.select(F.col("at").alias(c), F.struct("n", "sketch").alias(p)) for c, p in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").where(_possible("x", "y", share))

    # Those that meet most others lead: an original before its copies, which meet each other less.
    weight = bounded(written(meet.groupBy("at").agg(F.sum("times").alias("weight")), "copy-weights"))
    ranked = meet.join(weight, "at").join(sketches.select("at", F.floor(F.log("n") / -math.log(share)).cast("int").alias("band")), "at")
    lead = bounded(written(ranked.groupBy("key", "band").agg(F.max(F.struct("weight", "at")).alias("top")), "copy-leads"))
    asked = ranked.join(lead, ["key", "band"]).where(F.col("at") != F.col("top.at")).select(F.col("at").alias("a"), F.col("top.weight").alias("weight"), F.col("top.at").alias("b")).distinct()
    asked = written(asked, "copy-chances")
    best = possible(asked).groupBy("a").agg(F.max(F.struct("weight", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    close = alike(sets)
    best = written(best.union(possible(close).select("a", "b")).distinct(), "copy-pairs")
    near = verified(best, sets, docs, text_col, width, share)
    for done in (often, weight, lead, asked, close, best):
        dropped(done)
    roots = components(near)
    placed = written(known.join(roots.withColumnRenamed("node", "at"), "at", "left").select("s1", "s2", "at", "first", F.coalesce("root", "at").alias("root")), "copy-roots")

    tagged = meet.select("key", "at").join(bounded(placed.select("at", "root")), "at")
    mixed = tagged.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top"))
    mixed = bounded(written(mixed.where("roots > 1").select("key", F.col("top.root").alias("top")), "copy-mixed"))
    tagged = written(tagged.join(mixed, "key").join(sketches, "at").withColumn("in_top", F.col("root") == F.col("top")).drop("top"), "copy-tagged")
    x, y = tagged.where("not in_top").alias("x"), tagged.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.in_top") | (F.col("x.at") < F.col("y.at")))
    pairs = x.join(y, apart & _possible("x", "y", share)).select(F.col("x.at").alias("a"), F.col("y.at").alias("b")).distinct()
    pairs = written(pairs, "copy-pairs")
    far = verified(pairs, sets, docs, text_col, width, share)
    at = placed.select("at", "root")
    joined = far.join(at.withColumnsRenamed({"at": "a", "root": "ra"}), "a").join(at.withColumnsRenamed({"at": "b", "root": "rb"}), "b")
    more = components(joined.select("ra", "rb"), "ra", "rb")

    named = placed.join(more.select(F.col("node").alias("root"), F.col("root").alias("_far")), "root", "left").select("s1", "s2", "first", F.coalesce("_far", "root").alias("root"))
    for done in (meet, mixed, tagged, pairs, sketches):
        dropped(done)
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "copy-first")
    named = written(named.join(bounded(least), "root").select("s1", "s2", "component_id"), "copy-named")
    return rows.select("_id", "s1", "s2").join(bounded(named), ["s1", "s2"]).select(F.col("_id").alias(id_col), "component_id")
