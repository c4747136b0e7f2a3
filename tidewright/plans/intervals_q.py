"""Interval, as-of and order-dependent queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import folds
from tidewright.operators import intervals as iv
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table

SEC = 1_000_000
HOUR = 3600 * SEC
#: Events as rows with a clock in microseconds, and as intervals of `value` minutes.
EV = "ev AS (SELECT *, epoch_us(ts) AS t_us FROM events)"
IV = EV + ", ivl AS (SELECT event_id, user_id, event_type, value, t_us AS \"start\", t_us + CAST(floor(value * 60) AS BIGINT) * 1000000 AS \"end\" FROM ev)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    return events_us(spark, d).select("event_id", "user_id", "event_type", "value", F.col("t_us").alias("start"), (F.col("t_us") + F.floor(F.col("value") * 60) * SEC).alias("end"))


def interval_metric_report(spark: SparkSession, d: str) -> DataFrame:
    """Covered time by user, then counts, sums and percentiles by event type and overall."""
    merged = iv.coalesced(spans(spark, d), ["user_id", "event_type"], gap=60 * SEC)
    secs = merged.withColumn("secs", (F.col("end") - F.col("start")) / F.lit(float(SEC)))
    out = secs.rollup("event_type").agg(F.count("*").alias("n_spans"), F.sum("n").alias("n_events"), F.round(F.sum("secs"), 3).alias("covered_s"), F.round(F.percentile("secs", F.lit(0.95)), 3).alias("p95_s"))
    return out.select(F.coalesce("event_type", F.lit("overall")).alias("scope"), "n_spans", "n_events", "covered_s", "p95_s")


REPORT = f"""
WITH {IV}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id, event_type ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR "start" > seen + 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
c AS (SELECT user_id, event_type, island, count(*) AS n, (max("end") - min("start")) / 1e6 AS secs FROM g GROUP BY ALL)
SELECT coalesce(event_type, 'overall') AS scope, count(*) AS n_spans, CAST(sum(n) AS BIGINT) AS n_events, round(sum(secs), 3) AS covered_s, round(quantile_cont(secs, 0.95), 3) AS p95_s
FROM c GROUP BY GROUPING SETS ((event_type), ())
"""


def e1_lead_intervals(spark, d):
    return iv.with_next(events_us(spark, d).select("event_id", "user_id", "t_us"), ["user_id"], ["t_us", "event_id"], "t_us", "end_us")


E1 = f"WITH {EV} SELECT event_id, user_id, t_us, lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS end_us FROM ev"


def e2_shift_overlaps(spark, d):
    """Which proposed shifts make neighbours overlap that did not overlap before."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    s = spans(spark, d).withColumn("shift", F.pmod("event_id", F.lit(5)) * 600 * SEC).withColumn("new_start", F.col("start") + F.col("shift")).withColumn("new_end", F.col("end") + F.col("shift"))
    s = s.withColumn("was", F.coalesce(F.lag("end").over(w) > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(w) < F.col("end"), F.lit(False)))
    s = s.withColumn("now", F.coalesce(F.lag("new_end").over(w) > F.col("new_start"), F.lit(False)) | F.coalesce(F.lead("new_start").over(w) < F.col("new_end"), F.lit(False)))
    return s.select("event_id", "was", "now", (F.col("now") & ~F.col("was")).alias("introduced"))


E2 = f"""WITH {IV}, s AS (SELECT *, "start" + (event_id % 5) * 600000000 AS ns, "end" + (event_id % 5) * 600000000 AS ne FROM ivl),
x AS (SELECT event_id, coalesce(lag("end") OVER w > "start", false) OR coalesce(lead("start") OVER w < "end", false) AS was,
  coalesce(lag(ne) OVER w > ns, false) OR coalesce(lead(ns) OVER w < ne, false) AS now FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id))
SELECT event_id, was, now, now AND NOT was AS introduced FROM x"""


def e3_discontinuities(spark, d):
    """Consecutive rows with a backward value jump, or a rate above 2 with an excess of at least 1.5."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events_us(spark, d).withColumn("dt", (F.col("t_us") - F.lag("t_us").over(w)) / F.lit(3.6e9)).withColumn("dv", F.col("value") - F.lag("value").over(w))
    kind = F.when(F.col("dv") < 0, "backward").when((F.col("dv") > 2 * F.col("dt")) & (F.col("dv") - F.col("dt") >= 1.5), "jump").otherwise("continuous")
    return e.where("dt is not null").select("event_id", "user_id", kind.alias("kind"))


E3 = f"""WITH {EV}, x AS (SELECT *, (t_us - lag(t_us) OVER w) / 3.6e9 AS dt, value - lag(value) OVER w AS dv FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id))
SELECT event_id, user_id, CASE WHEN dv < 0 THEN 'backward' WHEN dv > 2 * dt AND dv - dt >= 1.5 THEN 'jump' ELSE 'continuous' END AS kind FROM x WHERE dt IS NOT NULL"""


def _both_ways(e, seen: str, asked: str, step, start, kind: str):
    """`step` over rows of the two types by time (before, and with signs turned after); rows of one instant don't see each other."""
    rows = e.where(F.col("event_type").isin(seen, asked)).withColumn("seen", F.col("event_type") == seen)
    before = folds.sorted_fold(rows, ["user_id"], ["t_us", "seen", "event_id"], ["seen", "value", "event_id"], start, step, f"event_id long, l {kind}")
    back = rows.withColumn("turned", -F.col("value"))
    after = folds.sorted_fold(back, ["user_id"], [F.desc("t_us"), "seen", F.desc("event_id")], ["seen", "turned", "event_id"], start, step, f"event_id long, r {kind}")
    return before.join(after, ["user_id", "event_id"])


def e4_support_counts(spark, d):
    """How many trusted rows stand before and after each, agreeing in time and in value: two sorted walks, no pairs."""
    found = _both_ways(events_us(ship(spark), d), "view", "click", folds.below_step, list, "long")
    return found.select("event_id", F.col("l").alias("n_left"), F.col("r").alias("n_right"))


E4 = f"""WITH {EV} SELECT c.event_id, count(*) FILTER (a.t_us < c.t_us AND a.value < c.value) AS n_left, count(*) FILTER (a.t_us > c.t_us AND a.value > c.value) AS n_right
FROM ev c LEFT JOIN ev a ON a.user_id = c.user_id AND a.event_type = 'view' WHERE c.event_type = 'click' GROUP BY c.event_id"""


def e7_sliding_windows(spark, d):
    e = events_us(spark, d).groupBy("user_id").agg(F.min("t_us").alias("start"), F.max("t_us").alias("end"))
    return iv.windows(e, "start", "end", 48 * HOUR, 24 * HOUR).select("user_id", "w_start", "w_end")


E7 = f"""WITH {EV}, s AS (SELECT user_id, min(t_us) AS a, max(t_us) AS b FROM ev GROUP BY 1)
SELECT user_id, w AS w_start, w + 172800000000 AS w_end FROM (SELECT user_id, unnest(generate_series(a, b - 172800000000, 86400000000)) AS w FROM s WHERE b - a >= 172800000000)"""


def e8_cap_by_next(spark, d):
    return iv.capped(spans(spark, d), ["user_id"], ["start", "event_id"], "start", "end", 900 * SEC).select("event_id", F.col("end").alias("end_us"))


E8 = f"""WITH {IV} SELECT event_id, least("end", "start" + 900000000, lead("start") OVER (PARTITION BY user_id ORDER BY "start", event_id)) AS end_us FROM ivl"""


def d11_union_and_intersection(spark, d):
    """Length of the union of each user's views and of its clicks, and of their intersection."""
    s = spans(spark, d)
    a = iv.coalesced(s.where("event_type = 'view'"), ["user_id"]).select("user_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = iv.coalesced(s.where("event_type = 'click'"), ["user_id"]).select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = iv.overlap_join(a, b, ["user_id"], HOUR).groupBy("user_id").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("both_us"))
    la = a.groupBy("user_id").agg(F.sum(F.col("l_end") - F.col("l_start")).alias("a_us"))
    lb = b.groupBy("user_id").agg(F.sum(F.col("r_end") - F.col("r_start")).alias("b_us"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return la.join(lb, "user_id", "full").join(both, "user_id", "left").select("user_id", zero("a_us"), zero("b_us"), zero("both_us"))


def _union(kind: str) -> str:
    return f"""SELECT user_id, min("start") AS s, max("end") AS e FROM (SELECT *, sum(CASE WHEN seen IS NULL OR "start" > seen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl WHERE event_type = '{kind}')) GROUP BY user_id, island"""


D11 = f"""WITH {IV}, a AS ({_union('view')}), b AS ({_union('click')}),
la AS (SELECT user_id, sum(e - s) AS x FROM a GROUP BY 1), lb AS (SELECT user_id, sum(e - s) AS x FROM b GROUP BY 1),
ab AS (SELECT a.user_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS x FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e GROUP BY 1)
SELECT user_id, CAST(coalesce(la.x, 0) AS BIGINT) AS a_us, CAST(coalesce(lb.x, 0) AS BIGINT) AS b_us, CAST(coalesce(ab.x, 0) AS BIGINT) AS both_us FROM la FULL JOIN lb USING (user_id) LEFT JOIN ab USING (user_id)"""


def d12_coalesce(spark, d):
    return iv.coalesced(spans(spark, d), ["user_id"], "start", "end", 600 * SEC, F.round(F.avg("value"), 6).alias("mean_value")).select("user_id", "island", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", "mean_value")


D12 = f"""WITH {IV}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl),
g AS (SELECT *, CAST(sum(CASE WHEN seen IS NULL OR "start" > seen + 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
SELECT user_id, island, min("start") AS start_us, max("end") AS end_us, count(*) AS n, round(avg(value), 6) AS mean_value FROM g GROUP BY user_id, island"""


def d13_regions(spark, d):
    """Coalesced regions with an id made of their number and a digest."""
    r = iv.coalesced(spans(spark, d), ["user_id"], gap=750_000)
    key = F.concat_ws("\u001f", F.col("user_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    return r.select("user_id", F.concat(F.lpad(F.col("island").cast("string"), 4, "0"), F.lit("-"), F.substring(F.sha2(key, 256), 1, 10)).alias("region_id"), "n")


D13 = f"""WITH {IV}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl),
g AS (SELECT *, CAST(sum(CASE WHEN seen IS NULL OR "start" > seen + 750000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m),
r AS (SELECT user_id, island, min("start") AS s, max("end") AS e, count(*) AS n FROM g GROUP BY 1, 2)
SELECT user_id, lpad(CAST(island AS VARCHAR), 4, '0') || '-' || substr(sha256(concat_ws(chr(31), user_id, s, e)), 1, 10) AS region_id, n FROM r"""


def d14_runs(spark, d):
    e = events_us(spark, d).select("event_id", "user_id", "t_us", (F.col("event_type") == "error").alias("bad"))
    r = iv.runs(e, ["user_id"], ["t_us", "event_id"], F.col("bad")).where("bad")
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")).drop("run")


D14 = f"""WITH {EV}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY t_us, event_id) AS g FROM ev)
SELECT user_id, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM x WHERE event_type = 'error' GROUP BY user_id, g"""


def d29_continuous_coverage(spark, d):
    """Whether each user's intervals cover their whole stretch without a gap above 12 hours."""
    s = spans(spark, d)
    w = Window.partitionBy("user_id").orderBy("start", "end", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("gap", F.greatest(F.col("start") - F.max("end").over(w), F.lit(0)))
    return s.groupBy("user_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("widest_us"), F.coalesce(F.max("gap") <= 12 * HOUR, F.lit(True)).alias("continuous"))


D29 = f"""WITH {IV}, g AS (SELECT user_id, greatest("start" - max("end") OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY "start", "end", event_id) AS rn FROM ivl)
SELECT user_id, coalesce(max(gap) FILTER (rn > 1), 0) AS widest_us, coalesce(max(gap) FILTER (rn > 1) <= 43200000000, true) AS continuous FROM g GROUP BY 1"""


def d30_gaps(spark, d):
    return iv.gaps(spans(spark, d), ["user_id"], least=6 * HOUR, tie=["event_id"])


D30 = f"""WITH {IV}, g AS (SELECT user_id, "start", max("end") OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl)
SELECT user_id, seen AS gap_start, "start" AS gap_end FROM g WHERE "start" - seen >= 21600000000"""


def d25_cost_totals(spark, d):
    """Planned time of all windows, of the merged ones, and what merging saves."""
    s = spans(spark, d)
    a = s.groupBy("event_type").agg(F.sum(F.col("end") - F.col("start")).alias("separate_us"))
    b = iv.coalesced(s, ["event_type"]).groupBy("event_type").agg(F.sum(F.col("end") - F.col("start")).alias("merged_us"))
    return a.join(b, "event_type").withColumn("saved_us", F.greatest(F.lit(0), F.col("separate_us") - F.col("merged_us")))


D25 = f"""WITH {IV}, m AS (SELECT *, max("end") OVER (PARTITION BY event_type ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR "start" > seen THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m),
b AS (SELECT event_type, sum(l) AS merged FROM (SELECT event_type, island, max("end") - min("start") AS l FROM g GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT event_type, sum("end" - "start") AS separate FROM ivl GROUP BY 1)
SELECT event_type, CAST(separate AS BIGINT) AS separate_us, CAST(merged AS BIGINT) AS merged_us, CAST(greatest(0, separate - merged) AS BIGINT) AS saved_us FROM a JOIN b USING (event_type)"""


def _two(spark, d, a: str, b: str):
    s = spans(spark, d)
    left = s.where(f"event_type = '{a}'").select("user_id", F.col("event_id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = s.where(f"event_type = '{b}'").select("user_id", F.col("event_id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return left, right


def _two_sql(a: str, b: str) -> str:
    return f"""{IV}, l AS (SELECT user_id, event_id AS l_id, "start" AS l_start, "end" AS l_end FROM ivl WHERE event_type = '{a}'), r AS (SELECT user_id, event_id AS r_id, "start" AS r_start, "end" AS r_end FROM ivl WHERE event_type = '{b}')"""


def c7_band_join(spark, d):
    """Intervals within 30 minutes of each other (inclusive), and their distance."""
    a, b = _two(spark, d, "view", "purchase")
    j = iv.overlap_join(a, b, ["user_id"], 2 * HOUR, 1800 * SEC, strict=False)
    return j.select("l_id", "r_id", F.greatest(F.lit(0), F.col("r_start") - F.col("l_end"), F.col("l_start") - F.col("r_end")).alias("distance_us"))


C7 = f"""WITH {_two_sql('view', 'purchase')} SELECT l_id, r_id, greatest(0, r_start - l_end, l_start - r_end) AS distance_us FROM l JOIN r ON l.user_id = r.user_id AND l_start - 1800000000 <= r_end AND r_start <= l_end + 1800000000"""


def c9_point_in_interval(spark, d):
    """Clicks inside a view's interval (closed start, open end)."""
    a, b = _two(spark, d, "view", "click")
    p = b.select("user_id", "r_id", "r_start", F.col("r_start").alias("r_end"))
    return iv.overlap_join(a, p, ["user_id"], HOUR, strict=False).where("r_start < l_end").select("l_id", "r_id")


C9 = f"WITH {_two_sql('view', 'click')} SELECT l_id, r_id FROM l JOIN r ON l.user_id = r.user_id AND r_start >= l_start AND r_start < l_end"


def c10_overlap_join(spark, d):
    """Overlapping intervals of two streams, and their intersection."""
    a, b = _two(spark, d, "view", "click")
    return iv.overlap_join(a, b, ["user_id"], HOUR).select("l_id", "r_id", F.greatest("l_start", "r_start").alias("start_us"), F.least("l_end", "r_end").alias("end_us"))


C10 = f"WITH {_two_sql('view', 'click')} SELECT l_id, r_id, greatest(l_start, r_start) AS start_us, least(l_end, r_end) AS end_us FROM l JOIN r ON l.user_id = r.user_id AND l_start < r_end AND r_start < l_end"


def c11_overlap_self_join(spark, d):
    """Overlapping pairs of one user's events of different types that no signup interval contains."""
    s = spans(spark, d)
    a = s.select("user_id", F.col("event_id").alias("l_id"), F.col("event_type").alias("l_type"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = s.select("user_id", F.col("event_id").alias("r_id"), F.col("event_type").alias("r_type"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    p = iv.overlap_join(a, b, ["user_id"], HOUR).where("l_id < r_id and l_type <> r_type").select("user_id", "l_id", "r_id", F.greatest("l_start", "r_start").alias("s"), F.least("l_end", "r_end").alias("e"))
    c = s.where("event_type = 'signup'").select(F.col("user_id").alias("cu"), F.col("start").alias("cs"), F.col("end").alias("ce"), F.col("event_id").alias("cid"))
    return p.join(c, (F.col("user_id") == F.col("cu")) & (F.col("cs") <= F.col("s")) & (F.col("e") <= F.col("ce")) & (F.col("cid") != F.col("l_id")) & (F.col("cid") != F.col("r_id")), "left_anti").select("l_id", "r_id", (F.col("e") - F.col("s")).alias("overlap_us"))


C11 = f"""WITH {IV}, p AS (SELECT a.user_id, a.event_id AS l_id, b.event_id AS r_id, greatest(a."start", b."start") AS s, least(a."end", b."end") AS e FROM ivl a JOIN ivl b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type AND a."start" < b."end" AND b."start" < a."end")
SELECT l_id, r_id, e - s AS overlap_us FROM p WHERE NOT EXISTS (SELECT 1 FROM ivl c WHERE c.event_type = 'signup' AND c.user_id = p.user_id AND c."start" <= s AND e <= c."end" AND c.event_id NOT IN (l_id, r_id))"""


def c12_segment_lookup(spark, d):
    """The segment of a piecewise axis that each value is in: closed segments, half-open gaps, an epsilon of 1e-6."""
    seg = spark.createDataFrame([(i, 10.0 * i, 10.0 * i + 8.0) for i in range(50)], "seg int, a double, b double")
    e = events_us(spark, d).select("event_id", "value")
    j = e.join(F.broadcast(seg), (F.col("value") >= F.col("a") - 1e-6) & (F.col("value") <= F.col("b") + 1e-6), "left")
    return j.groupBy("event_id").agg(F.min("seg").alias("seg"))


C12 = "SELECT e.event_id, min(s.i)::INTEGER AS seg FROM events e LEFT JOIN range(50) s(i) ON e.value >= 10.0 * s.i - 1e-6 AND e.value <= 10.0 * s.i + 8.0 + 1e-6 GROUP BY 1"


def c14_as_of(spark, d):
    """The nearest purchase before and after each event."""
    e = events_us(spark, d).select("event_id", "user_id", "t_us", "event_type")
    is_p = F.col("event_type") == "purchase"
    e = iv.last_before(e, ["user_id"], ["t_us", "event_id"], is_p, F.col("event_id"), "before_id")
    return iv.first_after(e, ["user_id"], ["t_us", "event_id"], is_p, F.col("event_id"), "after_id").select("event_id", "before_id", "after_id")


C14 = f"""WITH {EV} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_id,
first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_id FROM ev"""


def c8_range_join(spark, d):
    """Purchases within two hours of a signup, by time buckets."""
    e, near = events_us(spark, d), 7_200_000_000
    a = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("l_id"), F.col("t_us").alias("at"), (F.col("t_us") - near).alias("l_start"), (F.col("t_us") + near).alias("l_end"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("r_id"), F.col("t_us").alias("r_start"), F.col("t_us").alias("r_end"))
    return iv.overlap_join(a, b, ["user_id"], near, strict=False).select("l_id", "r_id", (F.col("r_start") - F.col("at")).alias("delta_us"))


C8 = f"WITH {EV} SELECT a.event_id AS l_id, b.event_id AS r_id, b.t_us - a.t_us AS delta_us FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.t_us BETWEEN a.t_us - 7200000000 AND a.t_us + 7200000000"


def c34_words_in_interval(spark, d):
    """What happens from two minutes before a signup to a day after, as one line, by time buckets."""
    e, day = events_us(spark, d), 86_400_000_000
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), (F.col("t_us") - 120_000_000).alias("l_start"), (F.col("t_us") + day).alias("l_end"))
    w = e.where("value > 5").select("user_id", "event_id", "event_type", F.col("t_us").alias("r_start"), F.col("t_us").alias("r_end"))
    said = F.array_sort(F.collect_list(F.struct("r_start", "event_id", "event_type")))
    found = iv.overlap_join(i, w, ["user_id"], day, strict=False).groupBy(F.col("id").alias("event_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(said, lambda x: x.event_type), " ").alias("words"))
    return found.select("event_id", "n", "words")


C34 = f"WITH {EV} SELECT i.event_id, count(*) AS n, string_agg(w.event_type, ' ' ORDER BY w.t_us, w.event_id) AS words FROM ev i JOIN ev w ON w.user_id = i.user_id AND i.event_type = 'signup' AND w.value > 5 AND w.t_us BETWEEN i.t_us - 120000000 AND i.t_us + 86400000000 GROUP BY i.event_id"


def c15_double_as_of(spark, d):
    """For each error the last view before it in both time and value, and the first one after it in both: two sorted walks, no pairs."""
    found = _both_ways(events_us(ship(spark), d), "view", "error", folds.latest_step, lambda: ([], []), "long")
    return found.select("event_id", F.col("l").alias("left_id"), F.col("r").alias("right_id"))


C15 = f"""WITH {EV} SELECT e.event_id, arg_max(a.event_id, (a.t_us, a.event_id)) FILTER (a.t_us < e.t_us AND a.value < e.value) AS left_id, arg_min(a.event_id, (a.t_us, a.event_id)) FILTER (a.t_us > e.t_us AND a.value > e.value) AS right_id
FROM ev e LEFT JOIN ev a ON a.user_id = e.user_id AND a.event_type = 'view' WHERE e.event_type = 'error' GROUP BY 1"""


def c16_adjacent_anchor(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events_us(spark, d)
    side = lambda c: F.coalesce(c.over(w) == "purchase", F.lit(False))
    return e.select("event_id", side(F.lag("event_type")).alias("after_anchor"), side(F.lead("event_type")).alias("before_anchor"))


C16 = f"WITH {EV} SELECT event_id, coalesce(lag(event_type) OVER w = 'purchase', false) AS after_anchor, coalesce(lead(event_type) OVER w = 'purchase', false) AS before_anchor FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)"


def c31_two_sided_as_of(spark, d):
    """Values between the purchases around them, and what they skip of a straight line."""
    e = events_us(spark, d)
    is_p = F.col("event_type") == "purchase"
    for out, c in (("t", "t_us"), ("v", "value")):
        e = iv.last_before(e, ["user_id"], ["t_us", "event_id"], is_p, F.col(c), f"{out}0")
        e = iv.first_after(e, ["user_id"], ["t_us", "event_id"], is_p, F.col(c), f"{out}1")
    e = e.where("event_type <> 'purchase' and t0 is not null and t1 is not null and t1 > t0")
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t_us") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return e.select("event_id", F.round(line, 6).alias("expected"), F.round(F.col("value") - line, 6).alias("skip"))


C31 = f"""WITH {EV}, x AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t_us END IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER p AS v0,
first_value(CASE WHEN event_type = 'purchase' THEN t_us END IGNORE NULLS) OVER n AS t1, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER n AS v1 FROM ev
WINDOW p AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(v0 + (v1 - v0) * (t_us - t0) / (t1 - t0), 6) AS expected, round(value - (v0 + (v1 - v0) * (t_us - t0) / (t1 - t0)), 6) AS skip FROM x WHERE event_type <> 'purchase' AND t0 IS NOT NULL AND t1 IS NOT NULL AND t1 > t0"""


def c33_overlap_anti_join(spark, d):
    """Fallback rows that overlap no primary row."""
    a, b = _two(spark, d, "error", "view")
    return iv.overlap_join(a, b, ["user_id"], HOUR, how="left_anti").select("l_id", "l_start", "l_end")


C33 = f"WITH {_two_sql('error', 'view')} SELECT l_id, l_start, l_end FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND l_start < r_end AND r_start < l_end)"


def e13_anchor_chain(spark, d):
    """Rows that begin a chain of three with all values above 5 and steps of at most two days."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events_us(spark, d).withColumn("ok", (F.col("value") > 5) & F.coalesce(F.lead("t_us").over(w) - F.col("t_us") <= 48 * HOUR, F.lit(True)))
    e = e.withColumn("chain", F.every("ok").over(w.rowsBetween(0, 2)) & (F.count("*").over(w.rowsBetween(0, 2)) == 3))
    return e.where("chain").select("event_id", "user_id")


E13 = f"""WITH {EV}, o AS (SELECT *, value > 5 AND coalesce(lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) - t_us <= 172800000000, true) AS ok FROM ev),
c AS (SELECT event_id, user_id, bool_and(ok) OVER w AND count(*) OVER w = 3 AS chain FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT event_id, user_id FROM c WHERE chain"""


def e14_running_max(spark, d):
    """Rows whose value falls below the greatest one before them."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events_us(spark, d).withColumn("top", F.max("value").over(w)).where("value < top").select("event_id", "top")


E14 = f"WITH {EV}, x AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev) SELECT event_id, top FROM x WHERE value < top"


def e15_isolated_gap(spark, d):
    """Line numbers that an order lacks while it has the numbers on both sides."""
    l = table(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber").distinct()  # noqa: E741
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return l.withColumn("nxt", F.lead("l_linenumber").over(w)).where("nxt = l_linenumber + 2").select("l_orderkey", (F.col("l_linenumber") + 1).alias("missing"))


E15 = "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10), x AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nxt FROM l) SELECT l_orderkey, l_linenumber + 1 AS missing FROM x WHERE nxt = l_linenumber + 2"


def e16_future_duplicates(spark, d):
    """Rows whose type comes again within the user's next three positions."""
    e = events_us(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")))
    w = Window.partitionBy("user_id", "event_type").orderBy("pos").rangeBetween(1, 3)
    return e.withColumn("again", F.count("*").over(w)).select("event_id", "again", (F.col("again") > 0).alias("dropped"))


E16 = f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS pos FROM ev),
x AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS again FROM p) SELECT event_id, again, again > 0 AS dropped FROM x"""


def e19_absorbed_rows(spark, d):
    """Short turns whose text the next turn begins with."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(w))
    return c.select("conv_id", "turn", F.coalesce((F.length("text") < 40) & F.col("nxt").startswith(F.col("text")), F.lit(False)).alias("absorbed"))


E19 = "SELECT conv_id, turn, coalesce(length(text) < 40 AND starts_with(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), text), false) AS absorbed FROM conversations"


def e21_gap_fill(spark, d):
    """Clicks placed into the gap between views that they fall in, clipped to the next click less 80 ms."""
    s = spans(spark, d)
    g = iv.gaps(s.where("event_type = 'view'"), ["user_id"], least=HOUR, tie=["event_id"]).select("user_id", F.col("gap_start").alias("l_start"), F.col("gap_end").alias("l_end"))
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    c = s.where("event_type = 'click'").withColumn("r_end", F.least(F.col("end"), F.lead("start").over(w) - 80_000)).select("user_id", "event_id", F.col("start").alias("r_start"), "r_end").where("r_end > r_start")
    j = iv.overlap_join(g, c, ["user_id"], 24 * HOUR).where("r_start >= l_start").withColumn("end_us", F.least("r_end", "l_end"))
    return j.where(F.col("end_us") - F.col("r_start") >= 300_000).select("event_id", F.col("r_start").alias("start_us"), "end_us")


E21 = f"""WITH {IV}, v AS (SELECT user_id, "start", max("end") OVER (PARTITION BY user_id ORDER BY "start", "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ivl WHERE event_type = 'view'),
g AS (SELECT user_id, seen AS gs, "start" AS ge FROM v WHERE "start" - seen >= 3600000000),
c AS (SELECT user_id, event_id, "start" AS s, least("end", lead("start") OVER (PARTITION BY user_id ORDER BY "start", event_id) - 80000) AS e FROM ivl WHERE event_type = 'click')
SELECT event_id, s AS start_us, least(e, ge) AS end_us FROM c JOIN g USING (user_id) WHERE e > s AND gs <= s AND s < ge AND least(e, ge) - s >= 300000"""


def e22_split_rows(spark, d):
    """View intervals cut at the clicks within them; two parts at least."""
    a, b = _two(spark, d, "view", "click")
    p = b.select("user_id", "r_start", F.col("r_start").alias("r_end")).distinct()
    cuts = iv.overlap_join(a, p, ["user_id"], HOUR, strict=False).where("r_start > l_start and r_start < l_end").groupBy("l_id", "l_start", "l_end").agg(F.array_sort(F.collect_set("r_start")).alias("cuts"))
    edges = F.concat(F.array("l_start"), F.col("cuts"), F.array("l_end"))
    x = cuts.select("l_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cuts") + 1), lambda i: F.struct(F.element_at(edges, i).alias("a"), F.element_at(edges, i + 1).alias("b")))).alias("part", "x"))
    return x.select("l_id", (F.col("part") + 1).alias("part"), F.col("x.a").alias("start_us"), F.col("x.b").alias("end_us"))


E22 = f"""WITH {_two_sql('view', 'click')}, k AS (SELECT DISTINCT l_id, l_start, l_end, r_start AS c FROM l JOIN r ON l.user_id = r.user_id AND r_start > l_start AND r_start < l_end),
e AS (SELECT l_id, l_end, c FROM k UNION SELECT l_id, l_end, l_start FROM k)
SELECT l_id, CAST(row_number() OVER (PARTITION BY l_id ORDER BY c) AS INTEGER) AS part, c AS start_us, coalesce(lead(c) OVER (PARTITION BY l_id ORDER BY c), l_end) AS end_us FROM e"""


def e24_repeats_removed(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    e = events_us(spark, d).withColumn("prev", F.lag("event_type").over(w))
    return e.where("prev is null or prev <> event_type").select("event_id", "user_id", "event_type")


E24 = f"WITH {EV}, x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS prev FROM ev) SELECT event_id, user_id, event_type FROM x WHERE prev IS NULL OR prev <> event_type"


def e26_monotone_filter(spark, d):
    """An array's elements that are no less than the one before them (in the unfiltered array)."""
    e = events_us(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", "event_id", "value"))), lambda x: x["value"]).alias("a"))
    kept = F.filter("a", lambda x, i: (i == 0) | (x >= F.get(F.col("a"), i - 1)))
    return e.select("user_id", F.size("a").cast("long").alias("n"), F.size(kept).cast("long").alias("n_kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


E26 = f"""WITH {EV}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS prev FROM ev)
SELECT user_id, count(*) AS n, count(*) FILTER (prev IS NULL OR value >= prev) AS n_kept, round(sum(value) FILTER (prev IS NULL OR value >= prev), 4) AS total FROM x GROUP BY 1"""

QUERIES = {
    "c8_range_join": (c8_range_join, C8),
    "c34_words_in_interval": (c34_words_in_interval, C34),
    "interval_metric_report": (interval_metric_report, REPORT),
    "c7_band_join": (c7_band_join, C7),
    "c9_point_in_interval": (c9_point_in_interval, C9),
    "c10_overlap_join": (c10_overlap_join, C10),
    "c11_overlap_self_join": (c11_overlap_self_join, C11),
    "c12_segment_lookup": (c12_segment_lookup, C12),
    "c14_as_of": (c14_as_of, C14),
    "c15_double_as_of": (c15_double_as_of, C15),
    "c16_adjacent_anchor": (c16_adjacent_anchor, C16),
    "c31_two_sided_as_of": (c31_two_sided_as_of, C31),
    "c33_overlap_anti_join": (c33_overlap_anti_join, C33),
    "d11_union_and_intersection": (d11_union_and_intersection, D11),
    "d12_coalesce": (d12_coalesce, D12),
    "d13_regions": (d13_regions, D13),
    "d14_runs": (d14_runs, D14),
    "d25_cost_totals": (d25_cost_totals, D25),
    "d29_continuous_coverage": (d29_continuous_coverage, D29),
    "d30_gaps": (d30_gaps, D30),
    "e1_lead_intervals": (e1_lead_intervals, E1),
    "e2_shift_overlaps": (e2_shift_overlaps, E2),
    "e3_discontinuities": (e3_discontinuities, E3),
    "e4_support_counts": (e4_support_counts, E4),
    "e7_sliding_windows": (e7_sliding_windows, E7),
    "e8_cap_by_next": (e8_cap_by_next, E8),
    "e13_anchor_chain": (e13_anchor_chain, E13),
    "e14_running_max": (e14_running_max, E14),
    "e15_isolated_gap": (e15_isolated_gap, E15),
    "e16_future_duplicates": (e16_future_duplicates, E16),
    "e19_absorbed_rows": (e19_absorbed_rows, E19),
    "e21_gap_fill": (e21_gap_fill, E21),
    "e22_split_rows": (e22_split_rows, E22),
    "e24_repeats_removed": (e24_repeats_removed, E24),
    "e26_monotone_filter": (e26_monotone_filter, E26),
}
