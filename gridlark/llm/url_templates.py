"""URL filters: host and path rules first, then a path-template tree for each host.

Path segments are first generalised by their form (numbers, hexadecimal strings, dates). Then the tree is grown level by
level: at each node the segments that are too rare to be names become a wildcard, and so do branches whose share of labelled
rejections doesn't differ from the rest of the node's by a two-proportion test; neither a node's number of segments nor its
depth matters. Labels are the verdicts of the
rules. A template is rejected if its smoothed share of rejected labels is at least `REJECT`; the share is smoothed towards
that of the same template on all hosts, and that one towards the share of all labelled urls.

Cases: a null url, or one without "://", has an empty host and path and no segments; repeated urls count each time; paths
of any depth count whole, one round a level until each is alone in its node; without any label the method allows; extra
columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import written

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RARE = 3  # a segment seen fewer times isn't a name
Z = 1.96
WEIGHT = 8.0  # pseudo-counts of each smoothing step
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    found = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.col(url).contains("://"), found).otherwise(F.lit(""))


def path_of(url: str) -> Column:
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.col(url).contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def ruled(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict): of the rules that fit, the one with the longest text; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: str) -> Column:
    """array<string>: the path's segments by form."""
    parts = F.filter(F.split(F.lower(F.col(path)), "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("{date}"))
        .when(s.rlike(r"^\d+(\.[a-z]{2,5})?$"), F.lit("{n}"))
        .when(s.rlike(r"^[0-9a-f-]{12,}(\.[a-z]{2,5})?$"), F.lit("{hex}"))
        .otherwise(F.regexp_replace(s, r"\d+", "{n}")),
    )


def templates(labelled: DataFrame) -> DataFrame:
    """(host, segs, template) of every different pair of host and segments; labelled: (host, segs, verdict or null)."""
    base = labelled.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"), F.count_if(F.col("verdict") == "allow").alias("good")
    )
    size = F.size("segs")
    base = written(base.withColumn("template", F.lit("")).withColumn("final", size == 0), "url-paths")
    levels, level = [base.written_to], 0
    active = base.where("not final")
    while not active.isEmpty():
        seg = F.get("segs", F.lit(level))
        kids = active.groupBy("host", "template", seg.alias("seg")).agg(F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        node = kids.groupBy("host", "template").agg(
            F.count("*").alias("names"), F.sum("paths").alias("all_paths"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")
        )
        at = kids.join(node, ["host", "template"])
        mine, others = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
        pooled = (F.col("all_bad") + 1) / (F.col("all_bad") + F.col("all_good") + 2)
        gap = F.col("bad") / F.nullif(mine, F.lit(0)) - (F.col("all_bad") - F.col("bad")) / F.nullif(others, F.lit(0))
        z = F.abs(gap) / F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(mine, F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
        apart = F.coalesce(z >= Z, F.lit(False))
        unlabelled = (F.col("all_bad") + F.col("all_good")) == 0
        literal = (F.col("n") >= RARE) & (apart | unlabelled | (F.col("names") == 1))
        choice = at.select("host", "template", "seg", F.when(literal, F.col("seg")).otherwise(F.lit("*")).alias("name"), (F.col("all_paths") == 1).alias("alone"))
        grown = active.drop("final").withColumn("seg", seg).join(choice, ["host", "template", "seg"])
        # A path alone in its node is the only name of every node below: the rest is all literal or all wildcards.
        rest = F.when(F.col("n") >= RARE, F.array_join(F.slice("segs", F.lit(level + 1), size), "/")).otherwise(F.array_join(F.array_repeat(F.lit("*"), size - level), "/"))
        name = F.concat("template", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("name")))
        final = F.col("alone") | (size == level + 1)
        grown = written(grown.select("host", "segs", "n", "bad", "good", name.alias("template"), final.alias("final")), "url-paths")
        levels.append(grown.written_to)
        active, level = grown.where("not final"), level + 1
    return labelled.sparkSession.read.schema(base.schema).parquet(*levels).where("final").drop("final")


def verdicts(base: DataFrame) -> DataFrame:
    """(host, segs, verdict) by the smoothed share of rejected labels of each path's template."""
    total = base.agg(F.sum("bad").alias("tb"), F.sum("good").alias("tg"))
    everywhere = base.groupBy("template").agg(F.sum("bad").alias("eb"), F.sum("good").alias("eg"))
    # The first literal of a path is a template of its own on all hosts: it stands in where no host has the whole template.
    heads = base.groupBy(F.get("segs", F.lit(0)).alias("head")).agg(F.sum("bad").alias("hb"), F.sum("good").alias("hg"))
    own = base.groupBy("host", "template").agg(F.sum("bad").alias("ob"), F.sum("good").alias("og"))
    known = base.withColumn("head", F.get("segs", F.lit(0))).alias("p").crossJoin(F.broadcast(total))  # one row
    joined = (
        known.join(heads, F.col("p.head").eqNullSafe(heads["head"]), "left").drop(heads["head"])
        .join(everywhere, "template", "left")
        .join(own, ["host", "template"], "left")
    )
    prior = F.coalesce((F.col("tb") + 0.0) / F.nullif(F.col("tb") + F.col("tg"), F.lit(0)), F.lit(0.0))

    def smooth(bad: str, good: str, towards: Column) -> Column:
        b, g = F.coalesce(F.col(bad), F.lit(0)), F.coalesce(F.col(good), F.lit(0))
        return (b + WEIGHT * towards) / (b + g + WEIGHT)

    share = reduce(lambda towards, names: smooth(*names, towards), (("hb", "hg"), ("eb", "eg"), ("ob", "og")), prior)
    return joined.select("host", "segs", "template", share.alias("share"), F.when(share >= REJECT, "block").otherwise("allow").alias("method"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template, share) of every row."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select("_id", F.coalesce(host_of("_url"), F.lit("")).alias("host"), F.coalesce(path_of("_url"), F.lit("")).alias("path"))
    rule, verdict = ruled("host", "path", rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("segs", segments("path"))
    judged = verdicts(templates(rows.select("host", "segs", F.col("ruled").alias("verdict"))))
    return rows.join(judged, ["host", "segs"], "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"), "template", "share"
    )
