"""Secret scan: one narrow pass of a fused multi-pattern projection, and what is planned from its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import case_of, env_name, extension, mask


def _any(catalog: tuple[P.Secret, ...]) -> str:
    return "|".join(f"(?:{s.regex})" for s in catalog)


def raw_findings(lines: DataFrame, catalog: tuple[P.Secret, ...] = P.SECRETS) -> DataFrame:
    """Every match of every pattern: file, line_no, line, the pattern's row, raw match; order is (pattern, line, match)."""
    hits = F.array(*[F.struct(F.lit(k).alias("pattern_ord"), F.lit(s.name).alias("pattern"), F.lit(s.kind).alias("type"), F.lit(s.severity).alias("severity"), F.lit(s.advice).alias("suggestion"), F.regexp_extract_all("line", F.lit(s.regex), F.lit(0)).alias("found")) for k, s in enumerate(catalog)])
    one = lines.where(F.col("line").rlike(_any(catalog))).select("file", "line_no", "line", F.explode(F.filter(hits, lambda h: F.size(h["found"]) > 0)).alias("h"))
    return one.select("file", "line_no", "line", "h.pattern_ord", "h.pattern", "h.type", "h.severity", "h.suggestion", F.posexplode("h.found").alias("match_ord", "raw"))


def allowed(findings: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Without what the whitelist (file, raw) names, compared before masking."""
    return findings.join(whitelist.select("file", "raw"), ["file", "raw"], "left_anti")


def findings(lines: DataFrame, catalog: tuple[P.Secret, ...] = P.SECRETS, whitelist: DataFrame | None = None) -> DataFrame:
    found = raw_findings(lines, catalog)
    found = found if whitelist is None else allowed(found, whitelist)
    return found.select("type", "severity", "file", F.col("line_no").alias("line"), "pattern", "match_ord", mask(F.col("raw")).alias("match"), "suggestion")


def by_severity(found: DataFrame) -> DataFrame:
    """Counts of critical, high and other findings."""
    level = F.when(F.col("severity").isin("critical", "high"), F.col("severity")).otherwise("other")
    return found.groupBy(level.alias("severity")).agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


def rollup(found: DataFrame) -> DataFrame:
    return found.rollup("severity", "type").agg(F.count("*").alias("findings"))


def first_of_line(raw: DataFrame) -> DataFrame:
    w = Window.partitionBy("file", "line_no").orderBy("pattern_ord", "match_ord")
    return raw.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def placeholder(pattern: Column) -> Column:
    return case_of(F.lower(pattern), P.PLACEHOLDERS, "your-value-here")


def accessor(file: Column, variable: Column) -> Column:
    ext, out = extension(file), None
    for names, template in P.ENV_ACCESS[1:]:
        text = F.concat(*[p for i, t in enumerate(template.split("{}")) for p in ([variable] if i else []) + [F.lit(t)]])
        out = F.when(ext.isin(*names.split()), text) if out is None else out.when(ext.isin(*names.split()), text)
    return out.otherwise(F.concat(F.lit("process.env."), variable))


def quoted(line: Column, raw: Column) -> Column:
    """The first quoted string of the line that covers the first place of ``raw``; null if there is none."""
    spans = F.regexp_extract_all(line, F.lit("'[^'\"`]*'|\"[^'\"`]*\"|`[^'\"`]*`"), F.lit(0))
    at = F.instr(line, raw)
    covers = lambda x: F.contains(x, raw) & (F.instr(line, x) <= at) & (F.instr(line, x) + F.length(x) >= at + F.length(raw))
    return F.try_element_at(F.filter(spans, covers), F.lit(1))


def fix_plan(raw: DataFrame) -> DataFrame:
    """One replacement for each line with a finding: what stands there and what should. Nothing is edited."""
    var = env_name(F.col("pattern"))
    one = first_of_line(raw)
    return one.select("file", F.col("line_no").alias("line"), F.coalesce(quoted(F.col("line"), F.col("raw")), F.col("raw")).alias("original"), accessor(F.col("file"), var).alias("replacement"), var.alias("env_var"), placeholder(F.col("pattern")).alias("placeholder"))


def env_file(plan: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(env_var, placeholder) to add to the example file: distinct, without those set already."""
    names = plan.select("env_var", "placeholder").distinct()
    return names if existing is None else names.join(existing.select("env_var"), "env_var", "left_anti")


def instructions(plan: DataFrame) -> DataFrame:
    """Replacements by file, in line order, long originals cut in the middle."""
    shown = F.when(F.length("original") > 20, F.concat(F.substring("original", 1, 10), F.lit("..."), F.right("original", F.lit(10)))).otherwise(F.col("original"))
    step = F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": "), shown, F.lit(" -> "), F.col("replacement"))
    rows = plan.groupBy("file").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("line", step.alias("step")))).alias("steps"))
    return rows.select("file", "n", F.array_join(F.transform("steps", lambda s: s["step"]), "\n").alias("steps"))
