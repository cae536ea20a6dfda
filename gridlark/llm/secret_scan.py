"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regex comes a Boolean query over trigrams: an OR of ANDs, one AND for each literal the match must hold.
The index has a posting (trigram, document) for every trigram that any rule asks for; the postings of a clause are
intersected by counting them for each document, and only documents of a satisfied clause are searched with the rule's
regex. Rules without a mandatory literal of three characters scan all documents. Long texts are searched whole.

Span positions come from splitting a text at the matches: a match starts after all pieces and matches before it.

Cases: a null text counts as empty and has no spans; rows that share an id are scanned each by itself; equal texts give equal
rows; extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import bounded, text_of, written


@dataclass(frozen=True)
class Rule:
    """kind: its name in a span; regex: Java syntax; group and least: this group has at least so many characters, or the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Published formats of other credentials; their spans are added to the base ones.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", 0, 20, True),
)
RULES = BASE + EXTRA


def _expand(regex: str) -> list[str]:
    """Strings that stand for a regex: literals as they are, and a NUL wherever a match may hold something else.

    Every match of the regex matches one of them, taking NUL as any text; alternatives multiply, optional parts appear with
    and without, small classes count as each of their characters and wider ones as NUL.
    """

    def sequence(at: int) -> tuple[list[str], int]:
        branches: list[str] = []
        parts: list[list[str]] = []
        while at < len(regex) and regex[at] != ")":
            c = regex[at]
            if c == "|":
                branches += ["".join(x) for x in product(*parts)]
                parts, at = [], at + 1
                continue
            if c == "(":
                at += 3 if regex.startswith("(?:", at) else 1
                item, at = sequence(at)
                at += 1
            elif c == "[":
                end = regex.index("]", at + 2)
                inner = regex[at + 1 : end]
                item = list(inner) if len(inner) <= 5 and not re.search(r"[\\^]|.-.", inner) else ["\0"]
                at = end + 1
            elif c == "\\":
                item, at = ([chr(int(regex[at + 2 : at + 4], 16))], at + 4) if regex[at + 1] == "x" else ([regex[at + 1]], at + 2)
            elif c in ".^$":
                item, at = ["\0"], at + 1
            else:
                item, at = [c], at + 1
            if at < len(regex) and regex[at] in "?*+{":
                q, least = regex[at], 1
                if q == "{":
                    least = int(re.match(r"\{(\d*)", regex[at:])[1] or 0)
                    at = regex.index("}", at)
                at += 1
                if q == "?":
                    item = ["", *item]
                elif q == "*" or least == 0:
                    item = ["\0"]
                else:  # at least one time: what follows the first need not follow at once
                    item = [x if x == "\0" else x + "\0" + x if least > 1 or q == "+" else x for x in item]
            parts.append(item)
        branches += ["".join(x) for x in product(*parts)]
        return branches, at

    return sequence(0)[0]


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """An OR of ANDs of trigrams that every match's text satisfies; None where a match need not hold any trigram."""
    clauses = []
    for s in _expand(rule.regex):
        s = s.lower() if rule.ignore_case else s
        clause = sorted({run[k : k + 3] for run in s.split("\0") for k in range(len(run) - 2)})
        if not clause:
            return None
        if clause not in clauses:
            clauses.append(clause)
    # A clause with all trigrams of another one adds nothing.
    return [c for c in clauses if not any(set(o) < set(c) for o in clauses)]


def trigram_index(docs: DataFrame, trigrams: list[str], folded: list[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id): for each text its trigrams out of those given, and out of its lower-cased form those of `folded`."""
    low = F.lower(text_col)
    asked = [(F.contains(F.col(text_col), F.lit(t)), "=" + t) for t in trigrams] + [(F.contains(low, F.lit(t)), "~" + t) for t in folded]
    found = F.array_compact(F.array(*[F.when(has, F.lit(name)) for has, name in asked]))
    return docs.select(F.col(id_col), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, kinds): the rules, out of those with a trigram query, of which a clause has all its postings in the document."""
    plain, folded, clauses = set(), set(), []
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule) or []):
            (folded if rule.ignore_case else plain).update(clause)
            mark = "~" if rule.ignore_case else "="
            clauses += [(mark + t, rule.kind, n, len(clause)) for t in clause]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(clauses, "trigram string, kind string, clause int, need int")
    postings = trigram_index(docs, sorted(plain), sorted(folded), id_col, text_col)
    return (
        postings.join(F.broadcast(wanted), "trigram")  # the rules' own clauses: some dozens of rows
        .groupBy(id_col, "kind", "clause", "need")
        .agg(F.count_distinct("trigram").alias("have"))
        .where("have = need")
        .groupBy(id_col)
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (s, e): code-point places of the rule's matches, leftmost first and not overlapping."""
    regex = F.lit(("(?i)" if rule.ignore_case else "") + rule.regex)
    whole, pieces = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    asked = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    sizes = F.transform(F.arrays_zip(whole.alias("m"), asked.alias("g"), F.slice(pieces, 1, F.size(whole)).alias("p")), lambda x: F.struct(
        F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("n"), F.char_length(x["g"]).alias("g")
    ))
    empty = F.expr("cast(array() as array<struct<s:int,e:int,ok:boolean>>)")
    placed = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["n"]).alias("e"), (x["g"] >= rule.least).alias("ok")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans: array of (s, ord, e, kind) by start, then by the rules' order."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    index_rules = tuple(r for r in rules if trigram_query(r))
    found = candidates(rows, index_rules, "_id", "_text")
    # Rows of one id share their postings: each is searched with the regexes, so sharing only costs time.
    # The ids found are few and short: while they can be broadcast, no text is shuffled.
    few = rows.where(F.col("_id").isNotNull()).join(bounded(written(found, "secret-candidates")), "_id")
    loose = rows.where(F.col("_id").isNull()).withColumn("kinds", F.array(*[F.lit(r.kind) for r in index_rules]))
    tagged = {r.kind: k for k, r in enumerate(rules)}
    empty = F.expr("cast(array() as array<struct<s:int,ord:int,e:int,kind:string>>)")

    def tag(rule: Rule) -> Column:
        return F.transform(spans_of(F.col("_text"), rule), lambda x: F.struct(x["s"].alias("s"), F.lit(tagged[rule.kind]).alias("ord"), x["e"].alias("e"), F.lit(rule.kind).alias("kind")))

    def when(rule: Rule) -> Column:
        return F.when(F.array_contains("kinds", rule.kind), tag(rule)).otherwise(empty)

    searched = few.unionByName(loose).select("_id", *_hashes(), F.flatten(F.array(*[when(r) for r in index_rules])).alias("_found")).where(F.size("_found") > 0)
    by_id = bounded(written(searched.groupBy("_id", "_h", "_h2").agg(F.first("_found").alias("_found")), "secret-spans"), 100_000)
    full = [r for r in rules if r not in index_rules]
    direct = rows.select("*", *_hashes()).withColumn(
        "_full", F.flatten(F.array(*[F.when(F.col("_text").rlike(r.regex), tag(r)).otherwise(empty) for r in full])) if full else empty
    ).select("_id", "_h", "_h2", "_full")
    keys = [direct["_id"].eqNullSafe(by_id["_id"]), direct["_h"] == by_id["_h"], direct["_h2"] == by_id["_h2"]]
    both = direct.join(by_id, reduce(lambda a, b: a & b, keys), "left").select(
        direct["_id"].alias(id_col), F.array_sort(F.concat(direct["_full"], F.coalesce(by_id["_found"], empty))).alias("spans")
    )
    return both


def _hashes() -> list[Column]:
    """Two hashes of a text, by which rows that share an id are told apart."""
    return [F.xxhash64("_text").alias("_h"), F.xxhash64(F.lit(1), F.col("_text")).alias("_h2")]


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts, digest and spans for every row."""
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.ord = {k})) as long)").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return scan(docs, RULES, id_col, text_col).select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_of(k: int, rule: Rule) -> str:
    regex = (("(?i)" if rule.ignore_case else "") + rule.regex).replace("'", "''")
    return (
        f"SELECT doc_id, {k} AS ord, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{regex}', 0) AS m, "
        f"regexp_extract_all(t, '{regex}', {rule.group}) AS g, string_split_regex(t, '{regex}') AS p FROM d WHERE regexp_matches(t, '{regex}')"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({" UNION ALL ".join(_sql_of(k, r) for k, r in enumerate(RULES))}),
y AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (SELECT doc_id, ord, kind, m[i] AS m, coalesce(list_sum(list_transform(p[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS s FROM y WHERE length(g[i]) >= least),
w AS (SELECT doc_id, ord, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS span FROM z),
a AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, ord) FILTER (ord < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""
