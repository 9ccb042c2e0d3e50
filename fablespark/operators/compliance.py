"""Delivery rules for audio measures, and rule tables for text corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter, measure, lower limit, upper limit, level.
STANDARDS = (
    ("RMS/Loudness", "rms_db", -23.0, -18.0, "fail"),
    ("Peak", "peak_db", None, -3.0, "fail"),
    ("True Peak", "true_peak_db", None, -1.0, "warning"),
    ("Noise Floor", "noise_floor_db", None, -60.0, "warning"),
    ("Sample Rate", "sample_rate", 44100.0, None, "fail"),
    ("Channels", "channels", None, 1.0, "warning"),
)


def _broken(measure: str, low: float | None, high: float | None) -> Column:
    value = F.col(measure).cast("double")
    tests = [value < low] if low is not None else []
    tests += [value > high] if high is not None else []
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def issues(metrics: DataFrame, key: str) -> DataFrame:
    """One row for each rule that a file breaks: parameter, value, level."""
    rules = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(m).cast("double").alias("value"), F.lit(level).alias("level"), _broken(m, low, high).alias("broken")) for p, m, low, high, level in STANDARDS])
    return metrics.select(key, F.explode(F.filter(rules, lambda r: r["broken"])).alias("r")).select(key, "r.parameter", "r.value", "r.level")


def report(metrics: DataFrame, key: str) -> DataFrame:
    """n_issues, status and is_compliant of each file, from its own row alone."""
    broken = [(_broken(m, low, high), level) for _, m, low, high, level in STANDARDS]
    count = sum((F.coalesce(b.cast("int"), F.lit(0)) for b, _ in broken), F.lit(0))
    failed = sum((F.coalesce(b.cast("int"), F.lit(0)) for b, level in broken if level == "fail"), F.lit(0))
    return metrics.select(key, count.alias("n_issues"), F.when(failed > 0, "fail").when(count > 0, "warning").otherwise("pass").alias("status"), (failed == 0).alias("is_compliant"))


def rule_stats(rules: DataFrame) -> DataFrame:
    """Counts of rules in total and by confidence, action and section, in one pass of grouping sets."""
    return rules.groupingSets([[], ["confidence"], ["action"], ["section"]], "confidence", "action", "section").agg(F.count(F.lit(1)).alias("n"))


def selected(rules: DataFrame, confidence: list[str] | None = None, action: list[str] | None = None) -> DataFrame:
    """Rules of the given confidences and actions; None takes all."""
    for column, wanted in (("confidence", confidence), ("action", action)):
        if wanted is not None:
            rules = rules.where(F.col(column).isin(*wanted))
    return rules


def rewritten(text: Column, rules: list[dict]) -> Column:
    """Replacements of a rule table in order; flags i and m, groups as \\1 or $1.

    The table is read when the plan is made, for it is the plan: one nested expression, no join.
    """
    for rule in sorted(rules, key=lambda r: r.get("ord", 0)):
        flags = "".join({"i": "(?iu)", "m": "(?m)"}.get(f.lower()[:1], "") for f in rule.get("flags") or [])
        text = F.regexp_replace(text, flags + rule["pattern"], rule["replacement"].replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    return text
