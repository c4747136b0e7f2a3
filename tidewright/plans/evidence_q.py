"""Editor evidence, roles from context, and trust from calibration over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import evidence
from tidewright.sources.code import ship
from tidewright.sources.tables import events_us, table


def _numbered(spark, d):
    return events_us(ship(spark), d).withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us", "event_id")) - 1).cast("int"))


def _lines_and_cues(e):
    lines = e.select(F.col("user_id").alias("track"), F.col("k").alias("line"), (F.col("k") * 4000).cast("long").alias("start_ms"), F.when(F.col("event_id") % 11 != 0, F.col("k") * 4000 + 2500).cast("long").alias("end_ms"))
    start = (F.col("k") * 4000 + F.floor(F.col("value") * 60) - 1500).cast("long")
    cues = e.where("event_id % 4 != 0").select(F.col("user_id").alias("track"), F.col("k").alias("cue"), start.alias("start_ms"), (start + 2000).alias("end_ms"))
    return lines, cues


def l6_ranked_evidence(spark, d):
    """The three best cues of each line, texts being scored already."""
    pairs = evidence.near_cues(*_lines_and_cues(_numbered(spark, d)), 2711)
    text = F.when((F.col("line") + F.col("cue")) % 5 != 0, (F.col("line") * 7 + F.col("cue") * 3) % 19 / 19.0)
    by = lambda *w: F.element_at(F.array(*map(F.lit, w)), F.col("line") % 3 + 1)
    return evidence.ranked(pairs.withColumn("text", text).withColumn("text_weight", by(0.85, 0.10, 0.0)).withColumn("timing_weight", by(0.75, 0.30, 0.20)))


L6 = """
WITH e AS (SELECT user_id AS track, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS k FROM events),
l AS (SELECT track, k AS line, k * 4000 AS a, CASE WHEN event_id % 11 <> 0 THEN k * 4000 + 2500 ELSE k * 4000 + 1 END AS b FROM e),
c AS (SELECT track, k AS cue, k * 4000 + CAST(floor(value * 60) AS BIGINT) - 1500 AS p FROM e WHERE event_id % 4 <> 0),
n AS (SELECT l.track, line, cue, a, b, p, p + 2000 AS q FROM l JOIN c ON c.track = l.track AND a - 2711 <= p + 2000 AND p <= b + 2711),
t AS (SELECT *, CAST(greatest(0, least(b, q) - greatest(a, p)) AS DOUBLE) / (greatest(b, q) - least(a, p)) AS iou, greatest(0.0, 1.0 - abs((a + b) / 2 - (p + q) / 2) / 2711) AS prox,
             CASE WHEN (line + cue) % 5 <> 0 THEN CAST((line * 7 + cue * 3) % 19 AS DOUBLE) / 19 END AS txt, CAST([0.85, 0.10, 0.0][line % 3 + 1] AS DOUBLE) AS tw, CAST([0.75, 0.30, 0.20][line % 3 + 1] AS DOUBLE) AS mw FROM n),
u AS (SELECT *, least(1.0, greatest(iou, 0.8 * prox)) AS tim FROM t),
s AS (SELECT *, round(CASE WHEN txt IS NOT NULL AND tw > 0 THEN (tim * mw + txt * tw) / (mw + tw) ELSE tim * mw / mw END, 6) AS score, round(tim, 6) AS timing FROM u),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second, count(*) OVER (PARTITION BY track, line) AS n_near FROM s WINDOW w AS (PARTITION BY track, line ORDER BY score DESC, timing DESC, cue))
SELECT track, line, n_near, cue, CAST(rank AS INTEGER) AS rank, score, timing, CASE WHEN rank = 1 THEN round(score - coalesce(second, 0), 6) END AS margin, p - a AS onset_ms, q - b AS offset_ms FROM r WHERE rank <= 3
"""


def l6_editor_evidence(spark, d):
    """The three best cues of each line by its text, which is heard with changes."""
    e = _numbered(spark, d)
    lines, cues = _lines_and_cues(e)
    text = F.concat_ws(" ", "event_type", F.format_string("%d", F.col("event_id") % 100), F.when(F.col("event_id") % 3 == 0, "사랑 노래").when(F.col("event_id") % 3 == 1, "of the day"))
    said = e.select(F.col("user_id").alias("track"), "k", text.alias("text"), F.when(F.col("event_id") % 2 == 0, "ko").otherwise("en").alias("language"))
    lines = lines.join(said.withColumnRenamed("k", "line"), ["track", "line"])
    cues = cues.join(said.select("track", F.col("k").alias("cue"), F.regexp_replace(F.regexp_replace("text", "사랑 노래", "sarang norae"), "[aeo]", "u").alias("text")), ["track", "cue"])
    return evidence.editor_evidence(lines, cues)


HAN = "天地人日月山水火木金土云雨风花鸟"


def h17_roles(spark, d):
    """Roles of each user's song: every sixth event labels one name, the one after it two, the others are sung or a credit."""
    e = _numbered(spark, d)
    name = lambda n: F.expr(f"substring('{HAN}', CAST(1 + ({n}) % 8 * 2 AS INT), 2)")
    one, two = name("event_id div 6"), F.concat(name("event_id div 12"), F.lit("/"), name("event_id div 12 + 1"))
    text = F.when(F.col("event_id") % 6 == 0, F.concat(one, F.lit("："))).when((F.col("event_id") % 6 == 1) & (F.col("value") > 60), F.concat(two, F.lit("："))).otherwise(F.col("event_type"))
    return evidence.role_names(e.select(F.col("user_id").alias("song"), F.col("k").alias("ord"), (F.col("k") * 1500).cast("long").alias("at_ms"), text.alias("text"), (F.col("event_type") == "error").alias("meta")))


H17 = f"""
WITH e AS (SELECT user_id AS song, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
n AS (SELECT song, k, event_type = 'error' AS meta, CASE WHEN event_id % 6 = 0 THEN substring('{HAN}', 1 + (event_id // 6) % 8 * 2, 2) END AS name,
             CASE WHEN event_id % 6 = 1 AND value > 60 THEN [substring('{HAN}', 1 + (event_id // 12) % 8 * 2, 2), substring('{HAN}', 1 + (event_id // 12 + 1) % 8 * 2, 2)] END AS pair FROM e),
x AS (SELECT DISTINCT song, unnest(pair) AS name FROM n WHERE pair IS NOT NULL),
r AS (SELECT *, lead(name) OVER w AS next_name, lead(meta) OVER w AS next_meta, lead(k) OVER w AS next_k FROM n WINDOW w AS (PARTITION BY song ORDER BY k)),
p AS (SELECT song FROM r SEMI JOIN x USING (song, name) GROUP BY song HAVING count(DISTINCT name) >= 4),
a AS (SELECT song, name FROM r ANTI JOIN x USING (song, name) WHERE name IS NOT NULL GROUP BY song, name
      HAVING count(*) >= 2 AND count(*) = count(*) FILTER (next_k IS NOT NULL AND next_name IS NULL AND NOT next_meta))
SELECT song, name, 'explicit' AS proof FROM x UNION ALL SELECT song, name, 'inferred' FROM a SEMI JOIN p USING (song)
"""


def _calibration(spark, d):
    """A candidate for each supplier: its metric in each split and language against a baseline, gates of four kinds, what it was selected and evaluated on."""
    li, s = table(ship(spark), d, "lineitem"), table(spark, d, "supplier")
    split = F.when(F.col("l_orderkey") % 2 == 0, "calibration").otherwise("blind")
    scope = F.concat(F.lit("language:"), F.element_at(F.array(*map(F.lit, ("en", "ko", "ja", "zh"))), F.col("l_orderkey").cast("int") % 4 + 1))
    metrics = li.groupBy(F.col("l_suppkey").alias("candidate"), split.alias("split"), scope.alias("scope"), F.lit("rate").alias("metric")).agg((F.sum("l_tax") / F.count("*")).alias("baseline"), (F.sum("l_discount") / F.count("*")).alias("value"))
    kind = F.when(F.col("scope") == "language:en", "floor").when(F.col("scope") == "language:ko", "ceiling").when(F.col("scope") == "language:ja", "improvement").otherwise("regression")
    bound = F.when(F.col("split") == "calibration", F.when(kind == "ceiling", 0.9).otherwise(-0.9)).when(kind == "floor", 0.0495).when(kind == "ceiling", 0.0505).when(kind == "improvement", 0.0095).otherwise(-0.0095)
    # The calibration split passes for all; in the blind one each scope is its own candidate's matter.
    gates = metrics.select("candidate", "split", "scope", "metric", kind.alias("kind"), bound.alias("bound"))
    selections = s.select(F.col("s_suppkey").alias("candidate"), F.col("s_nationkey").alias("revision"), F.lit("songs").alias("dataset"), F.lit("c1").alias("calibration_truth"), F.when(F.col("s_suppkey") % 7 == 0, "b0").otherwise("b1").alias("blind_truth"))
    evaluations = s.select(F.col("s_suppkey").alias("candidate"), F.col("s_nationkey").alias("revision"), F.explode(F.array(F.lit("calibration"), F.lit("blind"))).alias("split"), F.lit("songs").alias("dataset"), (F.col("s_acctbal") > -500).alias("isolated"))
    evaluations = evaluations.withColumn("truth", F.when(F.col("split") == "blind", "b1").otherwise("c1"))
    return selections, evaluations, metrics, gates


def l8_gate_results(spark, d):
    _, _, metrics, gates = _calibration(spark, d)
    return evidence.gate_results(metrics, gates)


GATES = """
m AS (SELECT l_suppkey AS candidate, CASE WHEN l_orderkey % 2 = 0 THEN 'calibration' ELSE 'blind' END AS split, 'language:' || ['en', 'ko', 'ja', 'zh'][l_orderkey % 4 + 1] AS scope,
             sum(l_tax) / count(*) AS base, sum(l_discount) / count(*) AS v FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT *, CASE scope WHEN 'language:en' THEN 'floor' WHEN 'language:ko' THEN 'ceiling' WHEN 'language:ja' THEN 'improvement' ELSE 'regression' END AS kind FROM m),
h AS (SELECT *, CASE WHEN split = 'calibration' THEN CASE kind WHEN 'ceiling' THEN 0.9 ELSE -0.9 END ELSE CASE kind WHEN 'floor' THEN 0.0495 WHEN 'ceiling' THEN 0.0505 WHEN 'improvement' THEN 0.0095 ELSE -0.0095 END END AS bound FROM g),
r AS (SELECT candidate, split, scope, 'rate' AS metric, kind, CASE kind WHEN 'floor' THEN v + 1e-12 >= bound WHEN 'ceiling' THEN v <= bound + 1e-12 WHEN 'improvement' THEN v - base + 1e-12 >= bound ELSE v + 1e-12 >= base - bound END AS passed FROM h)
"""
L8_GATES = f"WITH {GATES} SELECT * FROM r"


def _trust(spark, d):
    selections, evaluations, metrics, gates = _calibration(spark, d)
    results = evidence.gate_results(metrics, gates)
    # A scope that fails its gate isn't declared, so it doesn't fail its candidate's other scopes.
    scopes = evidence.eligible_scopes(selections, evaluations, results.where("passed OR split = 'calibration'"))
    orders, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lang = F.element_at(F.array(*map(F.lit, ("en", "ko", "ja", "zh"))), F.col("o_orderkey").cast("int") % 4 + 1)
    both = orders.join(li, orders.o_orderkey == li.l_orderkey)
    status = F.when(F.col("o_orderpriority") < "3", "trusted").when(F.col("o_orderpriority") < "5", "untrusted").otherwise("unknown")
    first = li.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("candidate"))
    revisions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate"), F.col("s_nationkey").alias("revision"))
    decided = orders.join(first, orders.o_orderkey == first.l_orderkey).join(revisions, "candidate")
    decisions = decided.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("cue"), "candidate", "revision", F.concat(F.lit("language:"), F.when(F.col("o_orderkey") % 37 == 0, "fr").otherwise(lang)).alias("scope"), status.alias("status"), F.lower("o_orderstatus").alias("reason"))
    lines = both.where("l_linenumber = 2 OR (l_linenumber = 3 AND l_quantity > 45)").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("cue"), lang.alias("language"), F.when(F.col("l_discount") > 0.08, "CONFLICT").otherwise("HIGH").alias("level"))
    human = orders.where("o_orderkey % 50 = 7").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("cue"), F.lit("trusted").alias("status"), F.lit("heard").alias("reason"))
    return evidence.trusted(decisions, lines, scopes, human), scopes


def l8_eligible_scopes(spark, d):
    return _trust(spark, d)[1]


SCOPES = f"""{GATES},
k AS (SELECT s_suppkey AS candidate, s_nationkey AS revision FROM supplier WHERE s_acctbal > -500 AND s_suppkey % 7 <> 0),
f AS (SELECT candidate, split FROM r WHERE passed OR split = 'calibration' GROUP BY 1, 2 HAVING bool_and(passed)),
n AS (SELECT candidate FROM f GROUP BY 1 HAVING count(*) = 2),
sc AS (SELECT k.candidate, revision, scope FROM k JOIN n USING (candidate) JOIN r USING (candidate) WHERE split = 'blind' AND passed)
"""
L8_SCOPES = f"WITH {SCOPES} SELECT candidate, revision, scope FROM sc"


def l8_trust(spark, d):
    """Decisions of each order's candidate, as far as its language is covered; every fiftieth order has been heard by people."""
    return _trust(spark, d)[0]


L8_TRUST = f"""WITH {SCOPES},
o AS (SELECT *, ['en', 'ko', 'ja', 'zh'][o_orderkey % 4 + 1] AS lang FROM orders),
d AS (SELECT o_custkey AS task, o_orderkey AS cue, l_suppkey AS candidate, 'language:' || CASE WHEN o_orderkey % 37 = 0 THEN 'fr' ELSE lang END AS scope, lang,
             CASE WHEN o_orderpriority < '3' THEN 'trusted' WHEN o_orderpriority < '5' THEN 'untrusted' ELSE 'unknown' END AS status, lower(o_orderstatus) AS reason
      FROM o JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey),
b AS (SELECT l_orderkey AS cue, count(*) AS n, bool_or(l_discount > 0.08) AS conflict FROM lineitem WHERE l_linenumber = 2 OR (l_linenumber = 3 AND l_quantity > 45) GROUP BY 1),
j AS (SELECT d.*, coalesce(n, 0) AS n, conflict, sc.scope IS NOT NULL AS covered FROM d LEFT JOIN b USING (cue) LEFT JOIN sc ON sc.candidate = d.candidate AND sc.scope = d.scope),
w AS (SELECT task, cue, CASE WHEN n <> 1 THEN ['unknown', 'ambiguous_or_missing_p9_editor_binding'] WHEN scope <> 'language:' || lang THEN ['invalid', 'scope_does_not_match_language']
        WHEN NOT covered THEN ['unknown', 'blind_gate_does_not_cover_language_scope'] WHEN conflict AND status = 'trusted' THEN ['unknown', 'p9_conflict_cannot_be_auto_trusted'] ELSE [status, reason] END AS x FROM j),
hu AS (SELECT o_custkey AS task, o_orderkey AS cue FROM orders WHERE o_orderkey % 50 = 7)
SELECT task, cue, x[1] AS status, x[2] AS reason, 'calibrated_policy' AS source FROM w ANTI JOIN hu USING (task, cue) UNION ALL SELECT task, cue, 'trusted', 'heard', 'human_review' FROM hu
"""

QUERIES = {
    "l6_ranked_evidence": (l6_ranked_evidence, L6), "l6_editor_evidence": (l6_editor_evidence, None), "h17_roles": (h17_roles, H17),
    "l8_gate_results": (l8_gate_results, L8_GATES), "l8_eligible_scopes": (l8_eligible_scopes, L8_SCOPES), "l8_trust": (l8_trust, L8_TRUST),
}
