"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines (blank ones aside) are equal if their trimmed texts are, and linked if they are at most `EDITS` edits apart and both
have at least `MIN_CHARS` characters. Every long distinct line is split into EDITS + 1 segments of even length; two lines
within EDITS edits must share one of the shorter line's segments at nearly its place. The index holds (length, segment
number, segment) of each line; a line probes it, for each length up to EDITS below its own, with the substrings whose place is
possible (multi-match-aware selection). Lines of a segment that many lines share meet only if one of several parts of their
neighbouring characters agrees as well. Candidate pairs of which too few pieces agree are dropped; the rest are verified by the
edit distance within a band (the built-in one) on what is left between their common start and end. Classes are
connected components of links, and the first line of a class, by document and place, stays.

Only 64-bit hashes travel in the join; a pair's texts are fetched for verification by reading the documents again. Lines count
as equal if two such hashes are.

Cases: null and empty texts have no lines; blank lines belong to no class and always stay; rows that share an id (a null one
too) are told apart, so of each class exactly one line of one row stays, of equal ids that of any one row; extra columns of the
input are ignored; an empty table gives an empty table; very long lines are split and compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, components, dropped, text_of, written

EDITS = 2
MIN_CHARS = 20
#: Pieces of a line in the test that precedes verification.
PIECES = 16
#: Lines of one segment from which on they must agree in a part of their characters as well.
CROWD = 16


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _no, _line): every line that isn't blank, without blanks at its ends, with its place in the text."""
    split = docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("_no", "_raw"))
    return split.select("_id", F.col("_no").cast("long").alias("_no"), F.btrim("_raw", F.lit(" \t\r\f\v")).alias("_line")).where("_line <> ''")


def _segment_bounds(k: int, edits: int) -> tuple[str, str]:
    """SQL for start (from 0) and length of segment k of a line of l characters: the last ones are longer by one."""
    short = f"(l div {edits + 1})"
    n_long = f"(l % {edits + 1})"
    start = f"({k} * {short} + greatest(0, {k} - ({edits + 1} - {n_long})))"
    size = f"({short} + if({k} >= {edits + 1} - {n_long}, 1, 0))"
    return start, size


def index_keys(edits: int) -> list[str]:
    """SQL for the hashes of (length, segment number, segment) of column _line; n is its length."""
    keys = []
    for k in range(edits + 1):
        start, size = (x.replace("l ", "n ") for x in _segment_bounds(k, edits))
        keys.append(f"xxhash64(n, {k}, substring(_line, {start} + 1, {size}))")
    return keys


def probe_keys(edits: int, min_chars: int) -> list[str]:
    """SQL for the hashes of every other substring that may be a segment of a line that is shorter by 0 to `edits` characters, or null.

    Segment k (from 0) of the shorter line may move by at most k places to the left view and by edits - k to the right
    view; both views must hold. A line's own segments are left out: they are its index keys, which probe too.
    """
    keys = []
    for less in range(edits + 1):
        for k in range(edits + 1):
            start, size = (x.replace("l ", f"(n - {less}) ") for x in _segment_bounds(k, edits))
            low, high = max(-k, less - (edits - k)), min(k, less + (edits - k))
            for move in range(low, high + 1):
                if less == move == 0:
                    continue
                at = f"({start} + {move})"
                keys.append(
                    f"if(n - {less} >= {min_chars} and {at} >= 0 and {at} + {size} <= n, xxhash64(n - {less}, {k}, substring(_line, {at} + 1, {size})), null)"
                )
    return keys


def keyed(long_lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(h, own, other): one row for each distinct line, with its index keys and its further probes, written to the shared folder.

    Keys are made where lines are read, so that hashes are shuffled and no texts.
    """
    own, other = index_keys(edits), probe_keys(edits, min_chars)
    columns = [F.expr(sql).alias(f"k{i}") for i, sql in enumerate(own + other)]
    rows = long_lines.select(F.xxhash64("_line").alias("h"), "_line", F.char_length("_line").alias("n")).select("h", *columns)
    distinct = rows.groupBy("h").agg(*[F.max(f"k{i}").alias(f"k{i}") for i in range(len(columns))])
    names = [f"k{i}" for i in range(len(columns))]
    return written(distinct.select("h", F.array(*names[: len(own)]).alias("own"), F.array(*names[len(own) :]).alias("other")), "line-keys")


def sketched(lines_of: DataFrame, edits: int) -> DataFrame:
    """(h, letters, pairs, parts) for each distinct line.

    letters and pairs: which characters and which pairs of neighbouring ones it has an odd number of times, each as 64 hashed
    bits. parts: the pairs are dealt to 4 edits + 1 parts by their hash; each part is the exclusive or of its pairs' hashes.
    """
    parity = "aggregate({}, 0L, (s, c) -> s ^ shiftleft(1L, cast(pmod(xxhash64(c), 64) as int)))"
    letters = F.expr(parity.format("split(_line, '')"))
    two = "transform(sequence(1, greatest(1, char_length(_line) - 1)), i -> xxhash64(substring(_line, i, 2)))"
    pairs = "aggregate(_two, 0L, (s, c) -> s ^ shiftleft(1L, cast(pmod(c, 64) as int)))"
    parts = f"transform(sequence(0, {4 * edits}), k -> aggregate(filter(_two, c -> pmod(shiftright(c, 8), {4 * edits + 1}) = k), 0L, (s, c) -> s ^ c))"
    one = lines_of.groupBy("h").agg(F.any_value("_line").alias("_line")).withColumn("_two", F.expr(two))
    return one.select("h", letters.alias("letters"), F.expr(pairs).alias("pairs"), F.expr(parts).alias("parts"))


def candidates(long_lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b) with a < b: hashes of distinct lines that share a segment; written to the shared folder.

    Where more than CROWD lines have one segment, two of them meet only if one of their 4 edits + 1 parts is equal, and they must
    have nearly the same characters: an edit changes the parity of at most two characters and of at most four neighbouring
    pairs, and so at most four parts. No pair within `edits` edits is lost.
    """
    keys = keyed(long_lines, edits, min_chars)
    index = keys.select(F.explode("own").alias("key"), "h")
    probes = keys.select(F.explode(F.array_compact(F.concat("own", "other"))).alias("key"), F.col("h").alias("g"))
    crowds = bounded(written(index.groupBy("key").count().where(f"count > {CROWD}").select("key"), "line-crowds"))
    pair = [F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")]
    plain = index.join(crowds, "key", "left_anti").join(probes.join(crowds, "key", "left_anti"), "key").where("h <> g").select(*pair)
    crowd_index = written(index.join(crowds, "key", "left_semi"), "line-crowd-index")
    crowd_probes = written(probes.join(crowds, "key", "left_semi"), "line-crowd-probes")
    members = bounded(written(crowd_index.select("h").union(crowd_probes.select("g")).distinct(), "line-crowd-members"))
    seen = written(sketched(long_lines.select("_line", F.xxhash64("_line").alias("h")).join(members, "h", "left_semi"), edits), "line-sketches")
    parts = F.posexplode("parts").alias("part", "value")
    x = crowd_index.join(bounded(seen, 100_000), "h").select("key", "h", "letters", "pairs", parts)
    y = crowd_probes.join(bounded(seen, 100_000).withColumnRenamed("h", "g"), "g").select("key", "g", F.col("letters").alias("letters_"), F.col("pairs").alias("pairs_"), parts)
    alike = (F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_"))) <= 2 * edits) & (F.bit_count(F.col("pairs").bitwiseXOR(F.col("pairs_"))) <= 4 * edits)
    same = (x["key"] == y["key"]) & (x["part"] == y["part"]) & (x["value"] == y["value"])
    close = x.join(y, same & (F.col("h") != F.col("g")) & alike).select(*pair)
    out = written(plain.union(close).distinct(), "line-pairs")
    for done in (keys, crowd_index, crowd_probes, seen):
        dropped(done)
    return out


def within(a: str, b: str, edits: int) -> Column:
    """The edit distance of two strings if it is at most `edits`, else a larger number: Hyyro's banded bit-vectors.

    A word has one bit for each of the 2 edits + 1 rows of the band; its highest bit is row j + edits in column j of the
    table. The longer string gives the rows. Down the diagonal the lowest row's cost is counted, and along the last row the
    horizontal differences. Strings shorter than the band are compared by the built-in function.
    """
    rows, cols = f"if(char_length({a}) >= char_length({b}), {a}, {b})", f"if(char_length({a}) >= char_length({b}), {b}, {a})"
    top, ones = 1 << 2 * edits, (1 << 2 * edits + 1) - 1
    match = " | ".join(f"if(coalesce(get(s.x, p.j + {i}) = p.c, false), {1 << edits + i}L, 0L)" for i in range(-edits, edits + 1))
    last = f"(size(s.x) - {edits})"
    at = f"cast({2 * edits - 1} - (p.j - {last}) as int)"
    return F.expr(f"""
      if(abs(char_length({a}) - char_length({b})) > {edits}, {edits + 1}, if(greatest(char_length({a}), char_length({b})) < {2 * edits}, levenshtein({a}, {b}), aggregate(
        transform(split({cols}, ''), (c, j) -> named_struct('c', c, 'j', j)),
        named_struct('x', split({rows}, ''), 'vp', {ones & -(1 << edits)}L, 'vn', 0L, 'd', {edits}),
        (s, p) -> transform(transform(transform(array({match}),
          e -> named_struct('d0', {ones}L & ((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn))),
          t -> named_struct('d0', t.d0, 'hp', {ones}L & (s.vn | ~(t.d0 | s.vp)), 'hn', t.d0 & s.vp)),
          r -> named_struct(
            'x', s.x,
            'vp', {ones}L & (r.hn | ~(shiftright(r.d0, 1) | r.hp)),
            'vn', shiftright(r.d0, 1) & r.hp,
            'd', s.d + if(p.j < {last},
              if((r.d0 & {top}L) = 0, 1, 0),
              cast((shiftright(r.hp, {at}) & 1) - (shiftright(r.hn, {at}) & 1) as int))))[0],
        s -> s.d)))
    """)


def plausible(a: str, b: str, edits: int, pieces: int = PIECES) -> Column:
    """True for all pairs within `edits` edits, and for few others: all but `edits` of a's pieces are in b, nearly at their place.

    An edit spoils one piece at most and moves the others by one character at most.
    """
    found = []
    for k in range(pieces):
        start = f"(char_length({a}) * {k} div {pieces})"
        size = f"(char_length({a}) * {k + 1} div {pieces} - {start})"
        low = f"greatest(0, {start} - {edits})"
        found.append(f"if(contains(substring({b}, cast({low} + 1 as int), cast({start} + {size} + {edits} - {low} as int)), substring({a}, cast({start} + 1 as int), cast({size} as int))), 1, 0)")
    return F.expr(" + ".join(found)) >= pieces - edits


def core(a: str, b: str, pieces: int = PIECES) -> tuple[Column, Column, Column, Column]:
    """(head, tail, a's rest, b's rest): both strings without a common start and a common end, whole pieces of the shorter one; their edit distance is the same."""
    n = f"least(char_length({a}), char_length({b}))"
    step = lambda k: f"cast({n} * {k} div {pieces} as int)"
    head = f"greatest(0, {', '.join(f'if(left({a}, {step(k)}) = left({b}, {step(k)}), {step(k)}, 0)' for k in range(1, pieces))})"
    tail = f"greatest(0, {', '.join(f'if(right({a}, {step(k)}) = right({b}, {step(k)}), {step(k)}, 0)' for k in range(1, pieces))})"
    cut = lambda s: F.expr(f"substring({s}, head + 1, char_length({s}) - head - least(tail, {n} - head))")
    return F.expr(head).alias("head"), F.expr(tail).alias("tail"), cut(a), cut(b)


def links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, a2, b2): the two hashes of distinct lines at most `edits` edits apart, a < b; written to the shared folder."""
    long_lines = lines(docs, id_col, text_col).where(F.char_length("_line") >= min_chars).select("_line")
    pairs = candidates(long_lines, edits, min_chars)
    ids = bounded(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    texts = written(long_lines.select("_line", F.xxhash64("_line").alias("h")).join(ids, "h", "left_semi").distinct(), "line-texts")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("_line").alias("_a")), "a").join(texts.select(F.col("h").alias("b"), F.col("_line").alias("_b")), "b")
    head, tail, core_a, core_b = core("_a", "_b")
    likely = both.where(plausible("_a", "_b", edits)).select("a", "b", _second("_a").alias("a2"), _second("_b").alias("b2"), "_a", "_b", head, tail)
    cores = written(likely.select("a", "b", "a2", "b2", core_a.alias("_a"), core_b.alias("_b")), "line-cores")
    out = written(cores.repartition("a", "b").where(F.levenshtein("_a", "_b", edits) >= 0).select("a", "b", "a2", "b2"), "line-links")
    dropped(cores)
    dropped(pairs)
    dropped(texts)
    return out


def _second(line: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(line))


def classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, n_links, keep) of every line that isn't blank.

    class_doc and class_line name the first line of the class, n_links counts the different lines that this one is linked
    to, and keep is true for the first line of each class only.
    """
    found = links(docs, edits, min_chars, id_col, text_col)
    member = components(found)
    degree = found.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("a2").alias("h2")), F.struct(F.col("b").alias("h"), F.col("b2").alias("h2")))).alias("n"))
    degree = degree.groupBy("n.h", "n.h2").agg(F.count("*").alias("n_links"))
    linked = bounded(written(degree.join(member.withColumnRenamed("node", "h"), "h").select(F.col("h").alias("_h"), F.col("h2").alias("_h2"), "root", "n_links"), "line-classes"))
    # A row number tells rows of one id apart; the lines' hashes are written with it, so that every later step has the same numbers.
    numbered = docs.select(F.struct(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row")).alias("_id"), text_col)
    every = written(lines(numbered, "_id", text_col).select("_id", "_no", F.xxhash64("_line").alias("_h"), _second("_line").alias("_h2")), "line-hashes")
    every = every.join(linked, ["_h", "_h2"], "left").select(
        "_id", "_no", F.coalesce("root", "_h").alias("_class"), F.when(F.col("root").isNull(), F.col("_h2")).otherwise(F.lit(0)).alias("_class2"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    first = every.groupBy("_class", "_class2").agg(F.min(F.struct("_id", "_no")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    # Written, so that beyond the broadcast bound the adaptive skew join can split a class that a large share of all lines is in.
    first = bounded(written(first, "line-firsts"))
    at = F.struct("_id", "_no")
    return every.join(first, ["_class", "_class2"], "left").select(
        F.col("_id._id").alias(id_col),
        F.col("_no").alias("line_no"),
        F.coalesce(F.col("_first"), at)["_id"]["_id"].alias("class_doc"),
        F.coalesce("_first._no", "_no").alias("class_line"),
        "n_links",
        F.coalesce(F.col("_first") == at, F.lit(True)).alias("keep"),
    )
