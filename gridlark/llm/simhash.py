"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit for each of 64 places, set if more than half of its word shingles' hashes have it; texts whose
fingerprints differ in at most `BITS` places are linked, and components of links are the groups.

Every distinct fingerprint gets its Hamming distances to `PIVOTS` reference fingerprints once. Distances to one reference
differ by no more than the distance of the two fingerprints (triangle inequality), so a pair whose largest coordinate
difference exceeds BITS is discarded without looking at it; survivors are verified on the fingerprints. Distances from random
references crowd around 32, so they cannot say by themselves which rows must meet: blocks of bits bring rows together, and the
tables sift them. Of BITS + r blocks at least r are equal in every pair with at most BITS differing places; r grows with the
logarithm of the number of fingerprints, so that a bucket holds a few rows at any size.

Groups of copies cost no pairs: equal fingerprints count once; fingerprints alike outside one hexadecimal digit, at most 16 to
a group, are compared with the smallest of them first, through the same tables; rows already in one component are never compared with each other, because in each bucket
only the rows outside its largest component are compared, with those of other components.

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other; repeats of an id
are rows of their own; rows with a null id join components but never name one (a component of null ids only has a null id);
extra columns of the input are ignored; an empty table gives an empty table; long texts count whole.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import components, dropped, text_of, written

BITS = 4
PIVOTS = 16
WIDTH = 4
SEED = 42
_MASK = (1 << 64) - 1
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the first values of the splitmix64 sequence, as signed 64-bit numbers."""
    out, state = [], 0
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _MASK
        out.append(signed(z ^ z >> 31))
    return out


def shingle_hashes(text: str, width: int = WIDTH) -> list[int]:
    """The unsigned hash of every run of `width` words of a whole text, of all its words if it has fewer; none without words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z is lowered, and only ASCII blanks part words
    if not words:
        return []
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(whole, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - width + 1].tolist()
    return [digest(whole[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The unsigned fingerprint of a whole text."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: list[int]) -> int:
    """The unsigned fingerprint of a text with these shingle hashes."""
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    seen = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits(2 * seen.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = WIDTH) -> Column:
    """Column expression: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, width)) for t in texts], dtype="int64")

    return of(text_of(text_col))


def hex_of(col: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))


def pivot_table(fp: str) -> Column:
    return F.array(*[F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])


def _near(a: str, b: str, bits: int) -> Column:
    """Largest coordinate difference of two pivot tables at most `bits`, then the fingerprints themselves."""
    out = None
    for k in range(PIVOTS):
        one = F.abs(F.col(f"{a}.p")[k].cast("int") - F.col(f"{b}.p")[k].cast("int")) <= bits
        out = one if out is None else out & one
    return out & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)


def sure_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): of fingerprints that are alike outside one hexadecimal digit, at most 16 to a group, each with the smallest of them."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(_MASK ^ 15 << 4 * k))).alias("rest")) for k in range(16)])
    groups = fps.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    pairs = groups.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct()
    both = pairs.select(*[F.struct(F.col(c).alias("fp"), pivot_table(c).alias("p")).alias(n) for c, n in (("a", "x"), ("b", "y"))])
    return both.where(_near("x", "y", bits)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def equal_blocks(n: int, bits: int = BITS) -> int:
    """How many equal blocks make a key: the fewest whose bits tell about n fingerprints apart, at most half of all blocks' bits."""
    r = 2
    while r < bits and 64 * r // (bits + r) < math.log2(max(n, 2)) - 2:
        r += 1
    return r


def block_keys(fp: str, equal: int, bits: int = BITS) -> Column:
    """Bucket keys: for each choice of `equal` of the bits + equal blocks, those blocks' bits and which they are."""
    n = bits + equal
    edges = [64 * k // n for k in range(n + 1)]
    keys = []
    for k, some in enumerate(combinations(range(n), equal)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in some)
        keys.append(F.xxhash64(F.lit(k), F.col(fp).bitwiseAND(F.lit(signed(mask)))))
    return F.array(*keys)


def far_links(known: DataFrame, bits: int = BITS, equal: int | None = None) -> DataFrame:
    """(a, b): components, out of the column root, that hold fingerprints of at most `bits` differing places."""
    keys = block_keys("fp", equal or equal_blocks(known.count(), bits), bits)
    rows = known.select("fp", "root", pivot_table("fp").alias("p"), F.explode(keys).alias("key"))
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top"))
        .where("roots > 1")
        .select("key", F.col("top.root").alias("top"))
    )
    tagged = rows.join(mixed, "key").withColumn("in_top", F.col("root") == F.col("top"))
    few, all_ = tagged.where("not in_top").alias("x"), tagged.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.in_top") | (F.col("x.fp") < F.col("y.fp")))
    return few.join(all_, meet & _near("x", "y", bits)).select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()


def linked(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, first, root) of distinct fingerprints (fp, first): root is the same for all that chains of links connect."""
    sure = components(sure_links(fps.select("fp"), bits)) if bits >= 4 else None
    known = fps.select("fp", "first", F.col("fp").alias("root"))
    if sure is not None:
        known = fps.join(sure.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    known = written(known, "known")  # so that counting it reads no data
    far = components(far_links(known, bits))
    return known.join(far.select(F.col("node").alias("root"), F.col("root").alias("_far")), "root", "left").select(
        "fp", "first", F.coalesce("_far", "root").alias("root")
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = written(docs.select(F.col(id_col).alias("_id"), fingerprints(docs, text_col, width).alias("fp")), "fingerprints")
    placed = linked(rows.groupBy("fp").agg(F.min("_id").alias("first")), bits)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), hex_of("fp").alias("fingerprint"), "component_id")
