"""Gates and selections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import gates
from tidewright.sources.tables import table


def b8_publish_issues(spark, d):
    """Pages as files in folders and with suffixes by their numbers, some with local paths or credentials in them."""
    n = F.col("page_id")
    pick = lambda m, *w: F.element_at(F.array(*map(F.lit, w)), (n % m + 1).cast("int"))
    path = F.concat(pick(5, "src/", "Private/", "output/", "docs/private/", ""), F.format_string("p%d", n), pick(4, ".html", ".SRT", ".txt", ".mp3"))
    said = pick(9, "", " /home/x ", " C:\\Users\\me ", " ghp_0123456789abcdefghijklm ", "", " -----BEGIN RSA PRIVATE KEY----- ", "", "github_pat_short", "")
    return gates.publish_issues(table(spark, d, "pages").select(path.alias("path"), F.concat(F.regexp_replace(F.coalesce("html", F.lit("")), "/home/", "/h/"), said).alias("text")))


B8 = r"""
WITH f AS (SELECT ['src/', 'Private/', 'output/', 'docs/private/', ''][page_id % 5 + 1] || 'p' || page_id || ['.html', '.SRT', '.txt', '.mp3'][page_id % 4 + 1] AS path,
                  replace(coalesce(html, ''), '/home/', '/h/') || ['', ' /home/x ', ' C:\Users\me ', ' ghp_0123456789abcdefghijklm ', '', ' -----BEGIN RSA PRIVATE KEY----- ', '', 'github_pat_short', ''][page_id % 9 + 1] AS t FROM pages)
SELECT path, 'local_data_path' AS issue FROM f WHERE lower(path) LIKE 'private/%' OR lower(path) LIKE 'output/%'
UNION ALL SELECT path, 'media_or_subtitle_file' FROM f WHERE lower(path) LIKE '%.srt' OR lower(path) LIKE '%.mp3'
UNION ALL SELECT path, 'sensitive_content' FROM f WHERE regexp_matches(t, '(?i)(C:\\Users\\|/Users/|/home/)') OR regexp_matches(t, 'github_pat_[A-Za-z0-9_]{20,}|ghp_[A-Za-z0-9]{20,}|-----BEGIN (RSA |OPENSSH )?PRIVATE KEY-----')
"""


def b12_stage_reasons(spark, d):
    """Orders as coarse results, lines as windows; those that need the finer stage, and why."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    selection = F.when(F.col("o_orderstatus") == "F", "AFFINE_ACCEPTED").when(F.col("o_orderstatus") == "O", "").otherwise("PIECEWISE_RATE")
    results = o.select(F.col("o_orderkey").alias("case"), (F.col("o_orderkey") % 17 == 0).alias("blocked"), selection.alias("selection"))
    found = gates.stage_reasons(results, li.select(F.col("l_orderkey").alias("case"), (F.col("l_discount") > 0.08).alias("ambiguous")))
    return found.withColumn("reasons", F.array_join("reasons", ";"))


B12 = """
WITH w AS (SELECT l_orderkey, count(*) FILTER (l_discount > 0.08) AS n FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS "case", concat_ws(';', CASE WHEN o_orderkey % 17 = 0 THEN 'coarse_timewarp_blocked' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'coarse_selection:PIECEWISE_RATE' END,
             CASE WHEN n > 0 THEN 'ambiguous_windows:' || n END) AS reasons FROM orders LEFT JOIN w ON l_orderkey = o_orderkey)
SELECT * FROM r WHERE reasons <> ''
"""


def b13_votes(spark, d):
    """Which lines' evidence may vote, flags being missing for many."""
    n, m = F.col("l_orderkey"), F.col("l_partkey")
    flag = lambda c, k, j: F.when(c % k != 0, c % j == 0)
    vote = gates.may_vote(flag(n, 3, 2), flag(m, 4, 3), flag(n, 7, 5) | (m % 2 == 0), flag(m, 11, 5), flag(n, 13, 6))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(vote).alias("n_votes"), F.count("*").alias("n"))


B13 = """
SELECT l_suppkey, count(*) FILTER (coalesce(CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey % 2 = 0 END, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 3 = 0 END, false)
    AND coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey % 5 = 0 END OR l_partkey % 2 = 0, false)
    AND coalesce(NOT CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 5 = 0 END, false) AND coalesce(NOT CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey % 6 = 0 END, false)) AS n_votes, count(*) AS n FROM lineitem GROUP BY 1
"""


def h26_rate_priors(spark, d):
    """Customers as tasks, their nations' tempos as sources; every fifth has an exact rate."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("source"), "c_acctbal")
    return gates.rate_priors(c.where("task % 5 = 0").select("task", "source", (F.col("task") % 7 / 10.0 + 0.7).alias("rate")), c.where("task % 4 <> 1").select("task", "source", (F.col("source") * 5.0).alias("source_bpm"), (F.floor("c_acctbal") % 200).cast("double").alias("target_bpm")))


H26 = """
WITH e AS (SELECT c_custkey AS task, c_nationkey AS source, CAST(c_custkey % 7 AS DOUBLE) / 10 + 0.7::DOUBLE AS rate FROM customer WHERE c_custkey % 5 = 0),
t AS (SELECT c_custkey AS task, c_nationkey AS source, CAST(floor(c_acctbal) % 200 AS DOUBLE) / (c_nationkey * 5) AS derived FROM customer WHERE c_custkey % 4 <> 1 AND c_nationkey > 0 AND floor(c_acctbal) % 200 > 0)
SELECT coalesce(e.task, t.task) AS task, coalesce(e.source, t.source) AS source, coalesce(rate, derived) AS rate, CASE WHEN rate IS NOT NULL THEN 'exact_daw' ELSE 'bpm_derived' END AS provenance FROM e FULL JOIN t ON e.task = t.task AND e.source = t.source
"""


def a11_tempo_changes(spark, d):
    """Parts as lines of a tempo list; every sixth line is no change."""
    p = table(spark, d, "part")
    label = F.concat("p_brand", F.lit(" - "), F.regexp_replace("p_name", "[0-9]", ""))
    line = F.concat(label, F.format_string("%d", F.col("p_size") + 80), F.when(F.col("p_partkey") % 6 == 0, "+").otherwise("-"), F.format_string("%.1f", F.col("p_retailprice") % 90 + 60), F.lit(" - x.wav"))
    return gates.tempo_changes(p.select("p_partkey", line.alias("line"))).select("p_partkey", "label", "source_bpm", "mix_bpm", F.round("ratio", 6).alias("ratio"))


def b11_selected_cases(spark, d):
    """The blind cases of the documents' sources."""
    cases = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ("development", " blind_test", "calibration", "blind_test "))), (F.col("doc_id") % 4 + 1).cast("int")).alias("split"))
    return gates.selected(cases, "blind_test").select("doc_id")


QUERIES = {
    "b8_publish_issues": (b8_publish_issues, B8), "b12_stage_reasons": (b12_stage_reasons, B12), "b13_votes": (b13_votes, B13), "h26_rate_priors": (h26_rate_priors, H26),
    "a11_tempo_changes": (a11_tempo_changes, None), "b11_selected_cases": (b11_selected_cases, "SELECT doc_id FROM documents WHERE doc_id % 2 = 1"),
}
