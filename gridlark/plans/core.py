"""Plans of the observation path: quality words, collapse, sums, ratios, versions, names, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.functions import columns as C
from gridlark.operators import daily as D
from gridlark.operators import tables as T
from gridlark.plans.inputs import OBS, as_text, daily, observations, r6, rounded, table, words, words_sql

SUMS = ("a", "b", "c", "d")
COLLAPSE = """px AS (SELECT pixel, cell, day, coalesce(avg(CASE WHEN valid THEN obs END), 0) AS a, max(CASE WHEN valid THEN 1.0 ELSE 0 END) AS b,
  coalesce(avg(CASE WHEN flagged THEN obs END), 0) AS c, max(CASE WHEN flagged THEN 1.0 ELSE 0 END) AS d FROM obs GROUP BY ALL)"""
RATIOS = """round(sum(a) / nullif(sum(b), 0), 6) AS mean_value, round(sum(c) / nullif(sum(d), 0), 6) AS mean_flagged,
  round(sum(c) / nullif(sum(b), 0), 6) AS flag_index, CAST(round(CAST(sum(d) AS DOUBLE) / nullif(sum(b), 0), 6) AS DOUBLE) AS flag_fraction,
  CAST(sum(b) AS DOUBLE) AS valid_weight, CAST(sum(d) AS DOUBLE) AS flag_weight"""


def qa_decode(spark, sf_dir):
    w = words(spark, sf_dir)
    f = [C.bits(F.col("word"), x).alias(n) for n, x in (("surface", C.SURFACE), ("quality", C.QUALITY), ("model", C.MODEL))]
    return w.select(*f).groupBy("surface", "quality", "model").agg(F.count("*").alias("n"))


def _valid(quality):
    def q(spark, sf_dir):
        return words(spark, sf_dir, quality).groupBy("day").agg(F.count_if("valid").alias("n_valid"), F.count_if("flagged").alias("n_flagged"), r6(F.sum(F.when(F.col("valid"), F.col("obs")))).alias("total"))

    return q


def _valid_sql(quality):
    return f"WITH {words_sql(quality)} SELECT day, count(*) FILTER (valid) AS n_valid, count(*) FILTER (flagged) AS n_flagged, round(sum(CASE WHEN valid THEN obs END), 6) AS total FROM words GROUP BY day"


def pixels(spark, sf_dir):
    return D.collapse(observations(spark, sf_dir), ["pixel", "cell", "day"], "obs", "valid", "flagged")


def pixel_day_collapse(spark, sf_dir):
    return rounded(pixels(spark, sf_dir), *SUMS)


def pixel_day_words(spark, sf_dir):
    return rounded(D.collapse(words(spark, sf_dir, C.PERMISSIVE), ["pixel", "day"], "obs", "valid", "flagged"), *SUMS)


def cell_accumulate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lookup = e.select(F.col("user_id").alias("pixel"), (F.col("user_id") % 40).cast("int").alias("cell")).distinct().where("cell < 35")  # the last cells lie outside
    return rounded(D.accumulate(D.located(pixels(spark, sf_dir).drop("cell"), lookup, ["pixel"]), ["cell"]), *SUMS)


def cell_ratios(spark, sf_dir):
    got = D.ratios(D.accumulate(pixels(spark, sf_dir), ["cell"]), ["cell"])
    return rounded(got, "mean_value", "mean_flagged", "flag_index", "flag_fraction")


def incremental_partials(spark, sf_dir):
    """Daily partials added up from three parts, the last one twice the days of the others."""
    px = pixels(spark, sf_dir)
    by_day = D.accumulate(px, ["day", "cell"])
    parts = [by_day.where(F.dayofmonth("day") % 4 == 0), by_day.where(F.dayofmonth("day") % 4 == 1), by_day.where(F.dayofmonth("day") % 4 > 1)]
    return rounded(D.merged(parts, ["cell"]), *SUMS)


def day_counts(spark, sf_dir):
    return D.day_counts(observations(spark, sf_dir), ["cell"], "day", F.col("flagged"))


def useful_parts(spark, sf_dir):
    lookup = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select((F.col("c_custkey") % 50).alias("tile"))
    return D.useful(lookup, "tile")


def pruned_scan(spark, sf_dir):
    """Orders of useful tiles only: a semi join in front of the sums."""
    keep = useful_parts(spark, sf_dir).select("tile")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tile"), "o_totalprice")
    return o.join(keep, "tile", "left_semi").groupBy("tile").agg(r6(F.sum("o_totalprice")).alias("total"))


def thinned(spark, sf_dir):
    sums = D.accumulate(pixels(spark, sf_dir), ["cell"])
    got = D.thin_out(D.ratios(sums, ["cell"]), "valid_weight", 90, ["mean_value", "flag_index"])
    return rounded(got.select("cell", "mean_value", "flag_index", "valid_weight"), "mean_value", "flag_index")


def version_dedup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seq = (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") + F.col("l_linenumber") * 7).alias("seq")
    df = li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("version"), seq, "l_partkey", "l_suppkey", "l_quantity")
    df = df.groupBy("l_orderkey", "l_linenumber", "version", "seq").agg(F.min("l_quantity").alias("quantity"))
    return T.latest(df, ["l_orderkey", "l_linenumber"], "version", "seq")


VERSION = """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS version,
  l_orderkey * 1000000000 + l_partkey * 1000 + l_suppkey + l_linenumber * 7 AS seq, min(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
m AS (SELECT *, min(seq) OVER (PARTITION BY l_orderkey, l_linenumber) AS place,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY version DESC, seq) AS k FROM v)
SELECT l_orderkey, l_linenumber, version, seq, quantity, place FROM m WHERE k = 1"""


def exact_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"))
    return T.first_of_name(e, "name", "seq")


def _names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.format_string("MCD19A2.A%04d%03d.h%02dv%02d.061.%013d", F.lit(2020) + (F.col("event_id") % 4).cast("int"), (F.col("event_id") % 365 + 1).cast("int"), (F.col("event_id") % 36).cast("int"), (F.col("user_id") % 18).cast("int"), F.lit(2024000000000) + F.col("event_id"))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://host/path/"), name, F.lit(".hdf"))).when(F.col("event_id") % 3 == 1, F.concat(name, F.lit(".hdf"))).otherwise(name).alias("name"))


def name_parse(spark, sf_dir):
    return _names(spark, sf_dir).select("event_id", C.parsed_name("name").alias("p")).select("event_id", "p.*")


NAMES = """SELECT event_id, CAST(2020 + event_id % 4 AS INT) AS year, CAST(event_id % 365 + 1 AS INT) AS doy, CAST(event_id % 36 AS INT) AS h,
  CAST(user_id % 18 AS INT) AS v, '061' AS collection, 2024000000000 + event_id AS production,
  'h' || lpad(CAST(event_id % 36 AS VARCHAR), 2, '0') || 'v' || lpad(CAST(user_id % 18 AS VARCHAR), 2, '0') AS tile,
  make_date(2020 + event_id % 4, 1, 1) + CAST(event_id % 365 AS INT) AS day FROM events"""


def month_range(spark, sf_dir):
    """All months from the first to the last order, with the months in between that have none."""
    span = table(spark, sf_dir, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("b")).first()
    return C.months(spark, span["a"], span["b"])


def doy_date(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.lit(1996) + (F.col("event_id") % 30).cast("int")).alias("year"), (F.col("event_id") % 365 + 1).cast("int").alias("doy"))
    return e.distinct().select("year", "doy", C.date_of_day(F.col("year"), F.col("doy")).alias("day"))


def stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(F.date_format("ts", "yyyyDDD HHmm"))
    return e.select("event_id", F.to_date(C.stamp(text)).alias("day"), F.coalesce(F.hour(C.stamp(text)), F.lit(-1)).alias("hour"))


def json_metadata_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    unit = F.when(F.col("k") % 3 == 0, "KB").when(F.col("k") % 3 == 1, "MB").otherwise("gb")
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").cast("long").alias("total"), r6(F.sum(C.size_mb(F.col("k").cast("double"), unit))).alias("megabytes"))


def labels_normalised(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(C.titled(F.concat(F.lit("  "), F.lower(F.substring_index("o_orderpriority", "-", -1)), F.lit(" "))).alias("label"))
    return p.groupBy("label").agg(F.count("*").alias("n"))


def days_grouped(spark, sf_dir):
    e = observations(spark, sf_dir).where("flagged")
    return e.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("pixel")).cast("array<string>"), ",").alias("pixels"))


def rejects(spark, sf_dir):
    """Counts of what the scan leaves out, by reason."""
    o = table(spark, sf_dir, "orders")
    why = F.when(F.col("o_totalprice") < 1000, "no geometry").when(F.year("o_orderdate") != 1998, "other year").otherwise("kept")
    return o.groupBy(why.alias("state")).agg(F.count("*").alias("n"))


def resume(spark, sf_dir):
    """Months without a finished member."""
    months = C.months(spark, "1995-01", "1996-12").select("label")
    done = daily(spark, sf_dir).where("total > 100 and month(day) % 3 = 0").select(F.date_format("day", "yyyy-MM").alias("label")).distinct()
    return T.unfinished(months, done, ["label"])


QUERIES = {
    "qa_decode": qa_decode, "qa_valid_primary": _valid((0,)), "qa_valid_permissive": _valid((0, 11)), "pixel_day_collapse": pixel_day_collapse, "pixel_day_words": pixel_day_words,
    "cell_accumulate": cell_accumulate, "cell_ratios": cell_ratios, "incremental_partials": incremental_partials, "day_counts_per_cell": day_counts, "useful_parts": useful_parts,
    "pruned_scan": pruned_scan, "thinned": thinned, "version_dedup": version_dedup, "exact_dedup": exact_dedup, "name_parse": name_parse, "month_range": month_range, "doy_date": doy_date,
    "stamps": stamps, "json_metadata_sum": json_metadata_sum, "labels_normalised": labels_normalised, "days_grouped": days_grouped, "rejects": rejects, "resume": resume,
}

_DBL = "CAST(round({0}, 6) AS DOUBLE) AS {0}"
_ABCD = ", ".join(_DBL.format(c) for c in SUMS)
_SUM = ", ".join(f"CAST(round(sum({c}), 6) AS DOUBLE) AS {c}" for c in SUMS)

ORACLES = {
    "qa_decode": f"WITH {words_sql()} SELECT surface, quality, model, count(*) AS n FROM words GROUP BY ALL",
    "qa_valid_primary": _valid_sql("0"),
    "qa_valid_permissive": _valid_sql("0, 11"),
    "pixel_day_collapse": f"WITH {OBS}, {COLLAPSE} SELECT pixel, cell, day, {_ABCD} FROM px",
    "pixel_day_words": f"WITH {words_sql('0, 11')}, {COLLAPSE.replace('pixel, cell, day', 'pixel, day').replace('FROM obs', 'FROM words')} SELECT pixel, day, {_ABCD} FROM px",
    "cell_accumulate": f"WITH {OBS}, {COLLAPSE} SELECT cell, {_SUM} FROM px WHERE cell < 35 GROUP BY cell",
    "cell_ratios": f"WITH {OBS}, {COLLAPSE} SELECT cell, {RATIOS} FROM px GROUP BY cell",
    "incremental_partials": f"WITH {OBS}, {COLLAPSE} SELECT cell, {_SUM} FROM px GROUP BY cell",
    "day_counts_per_cell": f"WITH {OBS} SELECT cell, count(DISTINCT day) AS days FROM obs WHERE flagged GROUP BY cell",
    "useful_parts": "SELECT c_custkey % 50 AS tile, count(*) AS pixels FROM customer WHERE c_acctbal > 9000 GROUP BY ALL",
    "pruned_scan": "SELECT o_custkey % 50 AS tile, round(sum(o_totalprice), 6) AS total FROM orders WHERE o_custkey % 50 IN (SELECT c_custkey % 50 FROM customer WHERE c_acctbal > 9000) GROUP BY ALL",
    "thinned": f"WITH {OBS}, {COLLAPSE}, r AS (SELECT cell, {RATIOS} FROM px GROUP BY cell) SELECT cell, CASE WHEN valid_weight >= 90 THEN mean_value END AS mean_value, CASE WHEN valid_weight >= 90 THEN flag_index END AS flag_index, valid_weight FROM r",
    "version_dedup": VERSION,
    "exact_dedup": "SELECT event_type || '-' || user_id AS name, min(event_id) AS seq FROM events GROUP BY ALL",
    "name_parse": NAMES,
    "month_range": "SELECT CAST(m AS DATE) AS month, last_day(m) AS last_day, strftime(m, '%Y-%m') AS label FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)",
    "doy_date": "SELECT DISTINCT CAST(1996 + event_id % 30 AS INT) AS year, CAST(event_id % 365 + 1 AS INT) AS doy, make_date(1996 + event_id % 30, 1, 1) + CAST(event_id % 365 AS INT) AS day FROM events",
    "stamps": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS day, CAST(CASE WHEN event_id % 7 <> 0 THEN hour(ts) ELSE -1 END AS INT) AS hour FROM events",
    "json_metadata_sum": """WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, round(sum(k * CAST(CASE k % 3 WHEN 0 THEN 1.0 / 1024 WHEN 1 THEN 1 ELSE 1024 END AS DOUBLE)), 6) AS megabytes FROM k GROUP BY ALL""",
    "labels_normalised": """WITH l AS (SELECT trim(lower(split_part(o_orderpriority, '-', -1))) AS s FROM orders)
SELECT array_to_string(list_transform(string_split(s, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label, count(*) AS n FROM l GROUP BY ALL""",
    "days_grouped": f"WITH {OBS} SELECT day, array_to_string(list_sort(list(DISTINCT pixel)), ',') AS pixels FROM obs WHERE flagged GROUP BY day",
    "rejects": "SELECT CASE WHEN o_totalprice < 1000 THEN 'no geometry' WHEN year(o_orderdate) <> 1998 THEN 'other year' ELSE 'kept' END AS state, count(*) AS n FROM orders GROUP BY ALL",
    "resume": """WITH m AS (SELECT strftime(unnest(generate_series(DATE '1995-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS label),
d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS total FROM orders GROUP BY ALL)
SELECT label FROM m WHERE label NOT IN (SELECT strftime(day, '%Y-%m') FROM d WHERE total > 100 AND month(day) % 3 = 0)""",
}

as_text(QUERIES, ORACLES, {
    "qa_valid_primary": ("day",), "qa_valid_permissive": ("day",), "pixel_day_collapse": ("day",), "pixel_day_words": ("day",), "version_dedup": ("version",),
    "name_parse": ("day",), "month_range": ("month", "last_day"), "doy_date": ("day",), "stamps": ("day",), "days_grouped": ("day",),
})
