"""N-gram Jaccard join by a token-group matrix: groups of similar documents, each with its tokens' union, opened only where needed.

A document is the set of its word shingles' 64-bit hashes (words: maximal runs without ASCII white space, A-Z lowered; fewer
words than a shingle make one shingle; a document without words has none and is linked with nothing). Two documents link at a
Jaccard similarity of at least `SHARE`; components of links are returned. Equal sets count once.

Groups. Every set joins the group of one leader: of the sets that share a key with it (keys: see below), the one that meets most
others. Any partition gives the same links; a good one opens fewer groups. The links of members with their leaders come first,
and the components that they make spare all later comparisons inside a component.

Matrix. Token by group: a group has a token if any member has it. A query set Q that links with a member shares at least
ceil(SHARE |Q|) tokens with it, so with the group's union too. The matrix is kept in two forms, each of which may only
discard groups without any such member:

1. its rows of keys. Under one order of all tokens, rare ones first (by a count of all tokens in buckets), a set of n keeps the first n - ceil(SHARE n) + 1 as its
   keys; two linked sets have keys in common, the more the nearer their sizes are (`least_keys`). So Q meets only groups that
   have enough of its keys, counting those whose members with that key have sizes that allow the similarity and of which one is
   in a larger component than Q (of equal ones, the one with the greater name), so that of two sets only one asks;
2. its columns, each group's token union, folded to `CLASSES` bits for each token of a set. A bit of Q that the group lacks
   is at least one token of Q outside the union, which bounds their overlap. (The unions as rows of tokens gave the exact
   overlap, but at 0.5 GB of texts 25,000 pairs of query and group asked for 75 million of them.)

Qualifying groups are opened: Q meets the members that share a key with it, are not in its component and whose sizes and sketches
allow the similarity, and these pairs are verified on the sets themselves, made again from the texts. A group of one member has met
Q by its keys already.

Whatever grows with the corpus is dealt out by its key at any size (windows instead of a table of counts that is broadcast while
it is short), so that small runs tell how large ones grow.

A hot group of copies costs no pairs: equal sets are one set, near copies meet their leader only, and groups that are wholly in
the query's component aren't asked.

Cases: a null text counts as empty; documents without words are their own component; rows that repeat an id are rows of their
own and share what they are linked with only through their texts; rows with a null id join components but never name one (a
component of such rows alone has a null name); extra columns of the input are ignored; an empty table gives an empty table; long
texts count whole.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, components, dropped, text_of, written
from gridlark.llm.near_copies import BITS, _allowed, _possible, _text_hashes, crowded, keys_of, parities, verified
from gridlark.llm.simhash import SEED

WIDTH = 5
SHARE = 0.8
#: Bits of a folded column for each token of a set, at least.
CLASSES = 8
#: Longer words are hashed one by one.
LONG_WORD = 64
_FACTOR = 0x9E3779B97F4A7C15
_BLANKS = bytes([9, 10, 11, 12, 13, 32])


def _byte_values() -> np.ndarray:
    """A number for each byte: none for blanks, the same for both cases of A-Z."""
    import xxhash

    return np.array([0 if b in _BLANKS else xxhash.xxh64_intdigest(bytes([b]).lower(), SEED) for b in range(256)], dtype="<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ x >> np.uint64(32)) * np.uint64(_FACTOR)


def word_hashes(text: str, values: np.ndarray = _byte_values()) -> np.ndarray:
    """The 64-bit hashes of a text's words in order, A-Z lowered.

    A word's hash is a polynomial in its bytes' numbers, as a difference of sums over the text; such polynomials know long words
    of some patterns badly, so long words get a digest each.
    """
    import xxhash

    data = text.encode()
    numbers = values[np.frombuffer(data, dtype=np.uint8)]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = numbers != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype="<u8")
    powers, inverse = (np.multiply.accumulate(np.full(len(data), f, dtype="<u8")) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
    sums = np.zeros(len(data) + 1, dtype="<u8")
    np.cumsum(numbers * powers, out=sums[1:])
    out = (sums[ends] - sums[starts]) * inverse[starts]
    out = _mixed(out)
    out ^= out >> np.uint64(29)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].lower(), SEED)
    return out


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted different hashes of a whole text's shingles, as signed longs; none without words."""
    words = word_hashes(text)
    n = max(1, len(words) - width + 1)
    out = words[:n]
    for k in range(1, min(width, len(words))):
        out = _mixed(out) + words[k : k + n]
    out = np.sort(out.view("<i8"))
    first = np.ones(len(out), dtype=bool)
    first[1:] = out[1:] != out[:-1]
    return out[first]


def band_of(n: int, share: float = SHARE) -> int:
    """Sets link only if their bands are the same or next to each other; the sizes of a band differ by less than a factor 1 / share."""
    return math.floor(math.log(n) / -math.log(share) + 1e-9)


def folded(hashes: np.ndarray, share: float = SHARE) -> np.ndarray:
    """A set's column of the matrix folded: one bit for each class of tokens, as many classes for all sets of a band."""
    bits = max(256, 1 << (CLASSES * math.ceil(share ** -(band_of(len(hashes), share) + 1))).bit_length())
    seen = np.zeros(bits, dtype=np.uint8)
    seen[hashes >> 9 & (bits - 1)] = 1
    return np.packbits(seen).view("<i8")


def described(docs: DataFrame, crowds: np.ndarray, text_col: str, width: int, share: float) -> Column:
    """Column expression: struct of a text's set: size, band, two hashes of it, sketches, folded column, keys."""
    import xxhash

    shipped = docs.sparkSession.sparkContext.broadcast(crowds)

    @F.pandas_udf("n int, band int, s1 long, s2 long, sketch array<long>, wide array<long>, bits array<long>, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingle_set(t, width)
            n = len(h)
            s = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype="<i8")
            wide = parities(h, 1 << (2 * n - 1).bit_length()) if n > BITS // 2 else None
            rows.append((n, band_of(n, share) if n else -1, s[0], s[1], parities(h, BITS), wide, folded(h, share) if n else None, keys_of(h, shipped.value, share)))
        return pd.DataFrame(rows, columns=["n", "band", "s1", "s2", "sketch", "wide", "bits", "keys"])

    return of(text_of(text_col))


def token_groups(sets: DataFrame, meet: DataFrame, share: float) -> DataFrame:
    """(a, b): each set with the leader whose group it joins; sets without a leader that they can link with aren't listed.

    meet: (key, at, band, times), the keys that several sets have.
    """
    weight = bounded(written(meet.groupBy("at").agg(F.sum("times").alias("weight")), "join-weights"))
    top = F.max(F.struct("weight", "at")).over(Window.partitionBy("key", "band"))
    ranked = meet.select("key", "at", "band").join(weight, "at").withColumn("top", top)
    asked = written(ranked.where(F.col("at") != F.col("top.at")).select(F.col("at").alias("a"), F.col("top.weight").alias("weight"), F.col("top.at").alias("b")).distinct(), "join-asked")
    out = written(possible(asked, sets, share).groupBy("a").agg(F.max(F.struct("weight", "b")).alias("top")).select("a", F.col("top.b").alias("b")), "join-groups")
    for done in (weight, asked):
        dropped(done)
    return out


def only(sets: DataFrame, *ats: DataFrame) -> DataFrame:
    """The sets that these columns of pairs name."""
    named = ats[0]
    for more in ats[1:]:
        named = named.union(more)
    return sets.join(bounded(written(named.toDF("at").distinct(), "join-asked")), "at", "left_semi")


def possible(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Of the pairs (a, b, ...), those that sizes and sketches allow."""
    some = sets.select("at", "n", "sketch")
    x, y = (some.select(F.col("at").alias(c), F.struct("n", "sketch").alias(p)) for c, p in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_possible("x", "y", share)).drop("x", "y")


def group_columns(members: DataFrame) -> DataFrame:
    """(group, band, least_n, most_n, bits) from (group, n, band, bits): each group's sizes and the folded union of its members' tokens.

    Members of a group are of one band, so their columns are equally long. Words of the unions are merged where members are read.
    """
    sizes = members.groupBy("group").agg(F.first("band").alias("band"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    words = members.select("group", F.posexplode("bits").alias("k", "word")).groupBy("group", "k").agg(F.bit_or("word").alias("word"))
    whole = words.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w")).select("group", F.col("w.word").alias("bits"))
    return sizes.join(whole, "group")


#: Folds the longer of two columns to the length of the other: a class of the fold has a token if either of its halves has.
_FOLD = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p | q), {0})"


def may_hold(q: str, g: str, share: float) -> Column:
    """A group g whose sizes and folded union allow a member that the set q links with."""
    n, lacking = F.col(f"{q}.n"), F.expr(
        f"aggregate(zip_with({_FOLD.format(f'{q}.bits', f'{g}.bits')}, {_FOLD.format(f'{g}.bits', f'{q}.bits')}, (p, q) -> bit_count(p & ~q)), 0, (c, d) -> c + d)"
    )
    sizes = (F.abs(F.col(f"{q}.band") - F.col(f"{g}.band")) <= 1) & (F.col(f"{g}.most_n") >= share * n - 1e-9) & (share * F.col(f"{g}.least_n") <= n + 1e-9)
    return sizes & (lacking <= n - F.ceil(share * n - 1e-9))


def least_keys(n: str, least: str, most: str, share: float) -> Column:
    """So many keys at least a set of n shares with any set of least to most tokens that it links with.

    They share a = ceil(share / (1 + share) (n + m)) tokens or more, of which the first a - ceil(share n) + 1 in the order of all
    tokens are keys of the one and the first a - ceil(share m) + 1 keys of the other; the former grows with m, the latter falls.
    """
    up = lambda c: F.ceil(share * c - 1e-9)
    all_ = lambda m: F.ceil(share / (1 + share) * (F.col(n) + m) - 1e-9)
    low, high = F.greatest(F.col(least), up(F.col(n))), F.least(F.col(most), F.floor(F.col(n) / share + 1e-9))
    return F.greatest(F.lit(1), F.least(all_(low) - up(F.col(n)) + 1, all_(high) - up(high) + 1))


def _halved(col: str, k: int) -> Column:
    """Word k of a sketch halved to two words, each the exclusive or of every other word of the whole sketch."""
    return reduce(Column.bitwiseXOR, [F.col(col)[j] for j in range(k, BITS // 64, 2)])


def links_outside(placed: DataFrame, sets: DataFrame, meet: DataFrame, docs: DataFrame, text_col: str, width: int, share: float) -> DataFrame:
    """(a, b): roots of components that hold linked sets; placed: (at, group, root) of every set."""
    # Of two components the smaller one asks: `order` is a component's size, then its name.
    order = placed.groupBy("root").agg(F.count("*").alias("c"))
    short = [_halved("sketch", k).alias(f"s{k}") for k in range(2)]
    known = bounded(written(placed.join(order, "root").join(sets.select("at", "n", *short), "at").select("at", "group", "n", "s0", "s1", F.struct("c", "root").alias("order")), "join-placed"))
    by_key = Window.partitionBy("key")
    tagged = meet.select("key", "at", "band").join(known, "at")
    tagged = tagged.withColumns({"r": F.min("order.root").over(by_key), "s": F.max("order.root").over(by_key)}).where("r <> s").drop("r", "s")
    tagged = written(tagged, "join-tagged")
    # Rows of the matrix for these keys, (key, group), each with what its members there are like.
    inside = tagged.groupBy("key", F.col("group").alias("g")).agg(F.max("order").alias("top"), F.first("band").alias("gb"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.count("*").alias("members"), F.first("s0").alias("g0"), F.first("s1").alias("g1"))
    n = F.col("n")
    fits = (F.abs(F.col("band") - F.col("gb")) <= 1) & (F.col("most_n") >= share * n - 1e-9) & (share * F.col("least_n") <= n + 1e-9)
    # Where one member has the key, no other can link with the query by it, so short sketches of the two may discard the row.
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("g1")))
    fits &= (F.col("members") > 1) | (apart <= _allowed(n, F.col("most_n"), share))
    met = tagged.join(inside, "key").where((F.col("top") > F.col("order")) & fits).groupBy(F.col("at").alias("q"), "n", "g").agg(F.count("*").alias("keys"), F.min("least_n").alias("l"), F.max("most_n").alias("m"))
    pairs = written(met.where(F.col("keys") >= least_keys("n", "l", "m", share)).select("q", "g"), "join-met")
    asked = bounded(written(pairs.select(F.col("g").alias("group")).distinct(), "join-asked"))
    members = written(placed.select("at", "group").join(asked, "group", "left_semi"), "join-members")
    many = bounded(written(members.groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group"), "join-many"))
    described = only(sets, members.select("at")).select("at", "n", "band", "bits").join(bounded(members), "at").select("group", "band", "n", "bits")
    columns = group_columns(described.join(many, "group", "left_semi"))
    columns = columns.union(described.join(many, "group", "left_anti").select("group", "band", F.col("n").alias("least_n"), F.col("n").alias("most_n"), "bits"))
    groups = columns.select(F.col("group").alias("g"), F.struct("band", "least_n", "most_n", "bits").alias("y"))
    queries = only(sets, pairs.select("q")).select(F.col("at").alias("q"), F.struct("n", "band", "bits").alias("x"))
    chances = written(pairs.join(groups, "g").join(queries, "q").where(may_hold("x", "y", share)).select("q", "g"), "join-chances")
    # Opened groups: the query meets the members that have one of its keys, of which either asks the other once.
    opened = bounded(written(chances.join(many.withColumnRenamed("group", "g"), "g", "left_semi").select("q", "g"), "join-opened"))
    sketch = sets.select("at", F.struct("n", "sketch").alias("s"))
    x = tagged.join(bounded(opened.select(F.col("q").alias("at")).distinct()), "at", "left_semi").join(sketch, "at").select("key", F.col("at").alias("q"), F.col("order").alias("ox"), F.col("s").alias("x"))
    y = tagged.join(bounded(opened.select(F.col("g").alias("group")).distinct()), "group", "left_semi").join(sketch, "at")
    y = y.select("key", F.col("at").alias("b"), F.col("group").alias("g"), F.col("order").alias("oy"), F.col("s").alias("y"))
    inner = x.join(y, "key").where((F.col("oy") > F.col("ox")) & _possible("x", "y", share)).join(opened, ["q", "g"], "left_semi").select(F.col("q").alias("a"), "b").distinct()
    alone = chances.join(many.withColumnRenamed("group", "g"), "g", "left_anti").select(F.col("q").alias("a"), F.col("g").alias("b"))
    both = written(inner.union(alone), "join-both")
    near = written(possible(both, only(sets, both.select("a"), both.select("b")), share), "join-pairs")
    found = verified(near, only(sets, near.select("a"), near.select("b")), docs, text_col, width, share, shingle_set)
    at = bounded(placed.select("at", "root"))
    out = written(found.join(at.withColumnsRenamed({"at": "a", "root": "ra"}), "a").join(at.withColumnsRenamed({"at": "b", "root": "rb"}), "b").select("ra", "rb"), "join-far")
    for done in (known, tagged, pairs, asked, members, many, chances, opened, both, near, found):
        dropped(done)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    crowds = crowded(docs, text_col, width, shingle_set, 0)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).select("_id", *_text_hashes("t"), described(docs, crowds, "t", width, share).alias("_s"))
    # A number tells rows apart, so that one row stands for all of an equal set whatever their ids.
    rows = written(rows.select(F.monotonically_increasing_id().alias("_at"), "_id", "t1", "t2", "_s.*"), "join-rows")
    known = written(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("_id").alias("first"), F.min("_at").alias("at")), "join-known")
    sets = rows.withColumnRenamed("_at", "at").join(bounded(known.select("at")), "at", "left_semi")
    keys = sets.select("at", "band", F.explode("keys").alias("key"))
    meet = written(keys.withColumn("times", F.count("*").over(Window.partitionBy("key"))).where("times > 1"), "join-meet")
    led = token_groups(sets, meet, share)
    roots = components(verified(led, only(sets, led.select("a"), led.select("b")), docs, text_col, width, share, shingle_set))
    placed = known.select("at", "first").join(led.select(F.col("a").alias("at"), "b"), "at", "left").join(roots.withColumnRenamed("node", "at"), "at", "left")
    placed = written(placed.select("at", "first", F.coalesce("b", "at").alias("group"), F.coalesce("root", "at").alias("root")), "join-roots")
    far = components(links_outside(placed.select("at", "group", "root"), sets, meet, docs, text_col, width, share), "ra", "rb")
    named = placed.join(far.select(F.col("node").alias("root"), F.col("root").alias("_far")), "root", "left").select("at", "first", F.coalesce("_far", "root").alias("root"))
    least = bounded(written(named.groupBy("root").agg(F.min("first").alias("component_id")), "join-first"))
    named = written(known.select("s1", "s2", "at").join(named.join(least, "root").select("at", "component_id"), "at").select("s1", "s2", "component_id"), "join-named")
    out = rows.select("_id", "s1", "s2", "n").join(bounded(named), ["s1", "s2"], "left")
    for done in (meet, led, least):
        dropped(done)
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
