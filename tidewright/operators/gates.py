"""Gates and selections: what may pass to a dearer stage, what may vote, which prior holds, what must not be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders and suffixes of local data, and what a published file must not hold.
LOCAL = ("private/", "output/")
MEDIA = tuple(".srt .lrc .wav .mp3 .flac .m4a .aac .ogg .mp4 .mov .mkv".split())
SENSITIVE = r"(?i:C:\\Users\\|/Users/|/home/)|github_pat_[A-Za-z0-9_]{20,}|ghp_[A-Za-z0-9]{20,}|-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----"


def publish_issues(files: DataFrame) -> DataFrame:
    """(path, issue) of files (path, text) that must not be published; one issue of each kind. A null text can't be read, so only its path tells."""
    path = F.lower("path")
    kinds = {
        "local_data_path": F.substring_index(path, "/", 1).isin(*[x[:-1] for x in LOCAL]) & path.contains("/"),
        "media_or_subtitle_file": path.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in MEDIA) + ")$"),
        "sensitive_content": F.coalesce(F.col("text").rlike(SENSITIVE), F.lit(False)),
    }
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("issue"))


def stage_reasons(results: DataFrame, windows: DataFrame) -> DataFrame:
    """(case, reasons) of the cases that need the dearer stage. results: case, blocked, selection; windows: case, ambiguous."""
    n = windows.groupBy("case").agg(F.count_if("ambiguous").alias("n"))
    r = results.join(n, "case", "left")
    why = [
        F.when(F.col("blocked"), F.lit("coarse_timewarp_blocked")),
        F.when((F.col("selection") != "") & (F.col("selection") != "AFFINE_ACCEPTED"), F.concat(F.lit("coarse_selection:"), "selection")),
        F.when(F.col("n") > 0, F.concat(F.lit("ambiguous_windows:"), F.col("n").cast("string"))),
    ]
    return r.select("case", F.array_compact(F.array(*why)).alias("reasons")).where(F.size("reasons") > 0)


def may_vote(passed: Column, reliable: Column, eligible: Column, slope_at_edge: Column, source_at_edge: Column) -> Column:
    """Whether local evidence may speak on timing: its match holds (by the older flag where the newer is missing), it was granted, and its search ended at no edge. What isn't said isn't granted."""
    return F.coalesce(passed, reliable, F.lit(False)) & F.coalesce(eligible, F.lit(False)) & F.coalesce(~slope_at_edge, F.lit(False)) & F.coalesce(~source_at_edge, F.lit(False))


def rate_priors(exact: DataFrame, tempos: DataFrame) -> DataFrame:
    """(task, source, rate, provenance): the exact rate where one is given, else target over source tempo, if both are positive.

    exact: task, source, rate; tempos: task, source, source_bpm, target_bpm.
    """
    derived = tempos.where("source_bpm > 0 AND target_bpm > 0").select("task", "source", (F.col("target_bpm") / F.col("source_bpm")).alias("derived"))
    both = exact.select("task", "source", "rate").join(derived, ["task", "source"], "full_outer")
    return both.select("task", "source", F.coalesce("rate", "derived").alias("rate"), F.when(F.col("rate").isNotNull(), "exact_daw").otherwise("bpm_derived").alias("provenance"))


#: A label, source tempo, mix tempo, as in "Artist - Title103-130 - x.wav".
TEMPO = r"^(.+?)(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\s+-"


def tempo_changes(lines: DataFrame) -> DataFrame:
    """(all columns of `lines`, label, source_bpm, mix_bpm, ratio) of the lines (line) that tell a change of tempo."""
    part = lambda k: F.regexp_extract(F.trim("line"), TEMPO, k)
    found = lines.where(F.trim("line").rlike(TEMPO)).withColumns({"label": F.trim(part(1)), "source_bpm": part(2).cast("double"), "mix_bpm": part(3).cast("double")})
    return found.where("source_bpm > 0 AND mix_bpm > 0").withColumn("ratio", F.col("mix_bpm") / F.col("source_bpm"))


def selected(cases: DataFrame, split: str, allowed: tuple[str, ...] = ("development", "calibration", "blind_test")) -> DataFrame:
    """The cases of a split. A split that isn't allowed, or has no cases, is refused."""
    if split not in allowed:
        raise ValueError(f"unsupported split {split!r}")
    out = cases.where(F.trim(F.coalesce("split", F.lit(""))) == split)
    if out.isEmpty():
        raise ValueError(f"no cases for split {split!r}")
    return out


def requesting(jobs: DataFrame, capability: str) -> DataFrame:
    """The jobs that request a capability."""
    return jobs.where(F.coalesce(F.array_contains("requested", capability), F.lit(False)))
