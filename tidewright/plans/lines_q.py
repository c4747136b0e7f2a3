"""Lines with times over the tables: occurrences of many files, nearby events, merged timelines, fills, shared indices, roles, sets, CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import lines
from tidewright.operators.ranking import numbered
from tidewright.plans.intervals_q import EV
from tidewright.plans.sources_q import LINE, _line
from tidewright.sources import cues
from tidewright.sources.tables import events_us, table


def a9_occurrences(spark, d):
    """All timed lines of many files, numbered over all files and within each."""
    c = table(spark, d, "conversations").where(_line() != "")
    line = F.concat(F.format_string("[%02d:%02d.50]", (F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int")), _line())
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))
    got = cues.parse_lrc(files.select(F.format_string("%012d", "conv_id").alias("path"), "value")).withColumnRenamed("ordinal", "source_ordinal")
    got = numbered(got, [F.col("path"), F.col("source_ordinal")], "ordinal")
    return got.select(F.col("path").cast("long").alias("conv_id"), "source_ordinal", (F.col("ordinal") - 1).cast("long").alias("ordinal"), "time_ms", F.sha2("text", 256).alias("text_sha"))


A9 = """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS source_ordinal, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal, turn * 1000 + 500 AS time_ms, sha256(LINE) AS text_sha
FROM conversations WHERE LINE <> ''""".replace("LINE", LINE)


def c35_best_nearby(spark, d):
    """For each signup the purchase within six hours that is likest in value, less for its distance."""
    e, hour = events_us(spark, d), 3_600_000_000
    rows = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), F.col("t_us").alias("start"), F.col("t_us").alias("end"), F.col("value").alias("want"))
    events = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t_us").alias("at"), F.col("value").alias("got"))
    score = F.least("want", "got") / F.greatest("want", "got", F.lit(1.0))
    best = lines.best_nearby(rows, events, ["user_id"], 6 * hour, score, unit=float(hour))
    return best.select("id", "event_id", F.round("score", 6).alias("score"), F.round("objective", 6).alias("objective"))


C35 = f"""WITH {EV}, p AS (SELECT s.event_id AS id, e.event_id, least(s.value, e.value) / greatest(s.value, e.value, 1.0) AS score, least(abs(e.t_us - s.t_us) / 3.6e9, 5.0) AS away
FROM ev s JOIN ev e ON e.user_id = s.user_id AND s.event_type = 'signup' AND e.event_type = 'purchase' AND abs(e.t_us - s.t_us) <= 21600000000),
r AS (SELECT *, score - 0.035::DOUBLE * away AS objective, row_number() OVER (PARTITION BY id ORDER BY score - 0.035::DOUBLE * away DESC, score DESC, event_id) AS k FROM p)
SELECT id, event_id, round(score, 6) AS score, round(objective, 6) AS objective FROM r WHERE k = 1"""


def c28_merged_lines(spark, d):
    """Two timelines of a user as one: intervals of the same line that lie within an hour of each other are merged."""
    e = events_us(spark, d).where("event_type in ('view', 'click')")
    at = e.select("user_id", (F.floor("value") % 3).alias("line"), F.col("t_us").alias("start"), (F.col("t_us") + F.floor(F.col("value")) * 600_000_000).alias("end"))
    return lines.merged(at, ["user_id", "line"], 3_600_000_000).select("user_id", "line", "start", "end", "n")


C28 = f"""WITH {EV}, x AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 3 AS line, t_us AS s, t_us + CAST(floor(value) AS BIGINT) * 600000000 AS e FROM ev WHERE event_type IN ('view', 'click')),
y AS (SELECT *, max(e) OVER (PARTITION BY user_id, line ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x),
z AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, line ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM y)
SELECT user_id, line, min(s) AS start, max(e) AS "end", count(*) AS n FROM z GROUP BY user_id, line, k"""


def e10_filled_runs(spark, d):
    """Events without a label of their own take the one before, at first the one after; runs of a label and their lengths."""
    e = events_us(spark, d).withColumn("label", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    got = lines.filled(e.select("user_id", "t_us", "event_id", "label"), ["user_id"], ["t_us", "event_id"], "label")
    return got.groupBy("user_id", "run", "label").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us")).select("user_id", "run", "label", "n", "first_us")


E10 = f"""WITH {EV}, l AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS own FROM ev),
f AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING), first_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS label FROM l),
c AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, label, count(*) AS n, min(t_us) AS first_us FROM r GROUP BY user_id, run, label"""


def e18_shared_indices(spark, d):
    """Neighbouring events that share an index, the second at most a day after the first."""
    e = events_us(spark, d)
    index = F.array_distinct(F.array(F.floor("value") % 4, F.col("event_id") % 5))
    rows = e.select("user_id", F.col("event_id").alias("id"), F.col("t_us").alias("start"), F.col("t_us").alias("end"), index.alias("indices"))
    got = lines.shared_with_next(rows, ["user_id"], ["start", "id"], "indices", 86_400_000_000)
    return got.select("id", "next_id", F.array_join(F.transform("shared", lambda x: x.cast("string")), ",").alias("shared"))


E18 = f"""WITH {EV}, x AS (SELECT user_id, event_id AS id, t_us, list_distinct([CAST(floor(value) AS BIGINT) % 4, event_id % 5]) AS i FROM ev),
n AS (SELECT *, lead(id) OVER w AS next_id, lead(t_us) OVER w AS nt, lead(i) OVER w AS ni FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t_us, id))
SELECT id, next_id, array_to_string(list_sort(list_intersect(i, ni)), ',') AS shared FROM n WHERE nt - t_us <= 86400000000 AND len(list_intersect(i, ni)) > 0"""


def h18_alternative_roles(spark, d):
    """Documents of a source and length are alternatives; license lines are metadata, accented text is native."""
    docs = table(spark, d, "documents").where("text is not null")
    known = docs.select("doc_id", "source", (F.col("n_chars") % 40).alias("slot"), F.lower("text").contains("license").alias("meta"), F.col("text").rlike("[À-ÿ]").alias("native"))
    return lines.alternative_roles(known, ["source", "slot"], F.col("meta"), F.col("native")).select("doc_id", "role")


H18 = """WITH k AS (SELECT doc_id, source, n_chars % 40 AS slot, contains(lower(text), 'license') AS meta, regexp_matches(text, '[À-ÿ]') AS native FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, count(*) FILTER (NOT meta) OVER (PARTITION BY source, slot) AS n, count(*) FILTER (NOT meta AND native) OVER (PARTITION BY source, slot) AS natives FROM k)
SELECT doc_id, CASE WHEN meta THEN 'metadata' WHEN n = 1 OR (native AND natives = 1) THEN 'original' ELSE 'unknown' END AS role FROM c"""


def g4_set_algebra(spark, d):
    """Flags and statuses of an order as sets: union, difference, intersection, subset."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))  # noqa: E741
    text = lambda x: F.array_join(F.array_sort(x), ",")
    known = F.array(F.lit("A"), F.lit("F"), F.lit("N"))
    return l.select("l_orderkey", text(F.array_union("a", "b")).alias("both"), text(F.array_except("a", known)).alias("unknown"), text(F.array_intersect("b", known)).alias("known"), (F.size(F.array_except("a", known)) == 0).alias("all_known"))


G4 = """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS a, list(DISTINCT l_linestatus) AS b, ['A', 'F', 'N'] AS k FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(k, x))), ',') AS unknown,
array_to_string(list_sort(list_intersect(b, k)), ',') AS known, list_has_all(k, a) AS all_known FROM s"""


def a13_csv_audit(spark, d):
    """Orders as CSV lines, with quotes and missing fields, and read again: of two columns the first that isn't empty counts."""
    o = table(spark, d, "orders")
    row = F.struct(F.col("o_orderkey").alias("cue"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('say "'), "o_orderstatus", F.lit('", then go'))).alias("text"), F.concat(F.lit("old "), "o_orderstatus").alias("original"))
    back = F.from_csv(F.to_csv(row, {"quoteAll": "true", "escape": '"'}), "cue LONG, text STRING, original STRING", {"escape": '"'})
    return o.select(back.alias("r")).select("r.cue", F.coalesce(F.nullif(F.col("r.text"), F.lit("")), F.nullif(F.col("r.original"), F.lit(""))).alias("said"))


A13 = """SELECT o_orderkey AS cue, CASE WHEN o_orderkey % 3 <> 0 THEN 'say "' || o_orderstatus || '", then go' ELSE 'old ' || o_orderstatus END AS said FROM orders"""


def a21_csv_report(spark, d):
    """Report rows of two kinds with different fields as lines of one CSV table."""
    n = table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("nation"))
    rows = n.unionByName(s, allowMissingColumns=True)
    return rows.select("kind", "id", F.to_csv(F.struct("kind", "id", "name", "nation")).alias("line"))


A21 = """SELECT 'nation' AS kind, CAST(n_nationkey AS VARCHAR) AS id, 'nation,' || n_nationkey || ',' || n_name || ',' AS line FROM nation
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'supplier,' || s_suppkey || ',,' || s_nationkey FROM supplier"""

QUERIES = {
    "a9_occurrences": (a9_occurrences, A9),
    "a13_csv_audit": (a13_csv_audit, A13),
    "a21_csv_report": (a21_csv_report, A21),
    "c28_merged_lines": (c28_merged_lines, C28),
    "c35_best_nearby": (c35_best_nearby, C35),
    "e10_filled_runs": (e10_filled_runs, E10),
    "e18_shared_indices": (e18_shared_indices, E18),
    "g4_set_algebra": (g4_set_algebra, G4),
    "h18_alternative_roles": (h18_alternative_roles, H18),
}
