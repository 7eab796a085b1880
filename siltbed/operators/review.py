"""Gates: check results, review items, validation, and rules over file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import basename, strip


# --- check pipeline ------------------------------------------------------------------------------------------------


def stored_output(outputs: DataFrame, chars: int = 5000) -> DataFrame:
    """(name, output): of each output the first ``chars`` characters; errors and warnings are found in all of it."""
    return outputs.select("name", F.substring("output", 1, chars).alias("output"))


def check_summary(checks: DataFrame) -> DataFrame:
    """(nth, line): a verdict over (name, passed, duration), then a line for each check, by name."""
    all_ = pipeline_result(checks).select(F.lit(0).alias("nth"), F.when(F.col("passed"), "All checks passed").otherwise("Some checks failed").alias("line"))
    each = checks.select(F.rpad("name", 12, " ").alias("name"), "passed", "duration", F.row_number().over(Window.orderBy("name", "duration", "passed")).alias("nth"))  # a row for each check of a run
    return all_.unionByName(each.select("nth", F.concat(F.when(F.col("passed"), "ok   ").otherwise("FAIL "), "name", F.lit(" "), F.col("duration").cast("string"), F.lit(" ms")).alias("line")))


def output_lines(outputs: DataFrame, most: int = 20) -> DataFrame:
    """(name, kind, nth, line): errors and warnings among (name, output), the first ``most`` of each."""
    rows = outputs.select("name", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    low = F.lower("line")
    kind = F.when(F.contains(low, F.lit("error")) | F.contains(low, F.lit("failed")), "error").when(F.contains(low, F.lit("warn")), "warning")
    w = Window.partitionBy("name", "kind").orderBy("pos")
    rows = rows.withColumn("kind", kind).where("kind is not null").withColumn("nth", F.row_number().over(w).cast("long"))
    return rows.where(F.col("nth") <= most).select("name", "kind", "nth", strip(F.col("line")).alias("line"))


def pipeline_result(checks: DataFrame) -> DataFrame:
    """One row over (name, passed, duration): all passed, counts, total duration; no checks count as passed."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.sum("duration"), F.lit(0)).cast("long").alias("duration"))


def commands(files: DataFrame) -> DataFrame:
    """(step, command) from marker files (file, text): later markers override earlier, a Makefile fills gaps."""
    steps = ("build", "test", "lint", "typecheck")
    parts = []
    for marker, level, *cmds in P.COMMANDS:
        hit = files.where(F.col("file").endswith(marker) if marker.startswith(".") else basename(F.col("file")) == marker)
        if marker == ".csproj":
            hit = files.where(F.col("file").rlike(r"\.(?:csproj|sln)$"))
        parts += [hit.select(F.lit(s).alias("step"), F.lit(c).alias("command"), F.lit(level * 10).alias("level")) for s, c in zip(steps, cmds) if c]
    node = files.where(basename(F.col("file")) == "package.json")
    for s, key, cmd, level in (("build", "build", "npm run build", 19), ("test", "test", "npm test", 19), ("lint", "lint", "npm run lint", 19), ("typecheck", "typecheck", "npm run typecheck", 19), ("typecheck", "type-check", "npm run type-check", 18), ("typecheck", "tsc", "npm run tsc", 17)):
        parts.append(node.where(F.get_json_object("text", f"$.scripts['{key}']") != "").select(F.lit(s).alias("step"), F.lit(cmd).alias("command"), F.lit(level).alias("level")))
    make = files.where(basename(F.col("file")) == "Makefile")
    parts += [make.where(F.contains("text", F.lit(f"{s}:"))).select(F.lit(s).alias("step"), F.lit(f"make {s}").alias("command"), F.lit(1).alias("level")) for s in steps[:3]]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    # requirements.txt only counts without pyproject.toml, which its lower level amounts to
    return rows.groupBy("step").agg(F.max_by("command", "level").alias("command"))


# --- review --------------------------------------------------------------------------------------------------------


def security_gate(findings: DataFrame) -> DataFrame:
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")])
    bad = (F.col("critical") > 0) | (F.col("high") > 0)
    text = F.when(bad, F.format_string("Found %d critical and %d high severity issues", "critical", "high")).when(F.col("medium") > 0, F.format_string("Clean (%d medium severity - review recommended)", "medium")).otherwise("No security issues found")
    return n.select(F.lit("Security Scan").alias("name"), (~bad).alias("passed"), text.alias("details"), F.lit(True).alias("required"))


def duplicate_gate(sized: DataFrame, min_lines: int = 10, min_occurrences: int = 3) -> DataFrame:
    """Never blocks; tells how many duplicates (hash, lines, n) are large."""
    n = sized.agg(F.count_if((F.col("lines") >= min_lines) & (F.col("n") >= min_occurrences)).alias("n"))
    return n.select(F.lit("Duplicate Code").alias("name"), F.lit(True).alias("passed"), F.when(F.col("n") > 0, F.format_string("Found %d significant duplicates", "n")).otherwise("No significant duplicates found").alias("details"), F.lit(False).alias("required"))


def check_gates(checks: DataFrame, required: tuple[str, ...] = ("Build", "Tests")) -> DataFrame:
    """Review items from check results (name, passed, errors)."""
    n = F.size("errors")
    return checks.select("name", "passed", F.when(F.col("passed"), "Passed").otherwise(F.format_string("Failed with %d errors", n)).alias("details"), F.col("name").isin(*required).alias("required"))


def feature_gate(state: DataFrame) -> DataFrame:
    n = state.agg(F.count_if(F.col("status") == "active").alias("n"))
    return n.select(F.lit("Active Feature").alias("name"), (F.col("n") > 0).alias("passed"), F.when(F.col("n") > 0, F.format_string("%d active", "n")).otherwise("No active feature").alias("details"), F.lit(False).alias("required"))


def git_gate(status: DataFrame) -> DataFrame:
    """From (path) of files with changes: clean or not; never required."""
    n = status.agg(F.count("*").alias("n"))
    return n.select(F.lit("Git Status").alias("name"), (F.col("n") == 0).alias("passed"), F.when(F.col("n") == 0, "Working tree clean").otherwise(F.format_string("%d uncommitted changes", "n")).alias("details"), F.lit(False).alias("required"))


def review(items: DataFrame) -> DataFrame:
    """One row: counts, whether all required items passed, and what to do."""
    lost = ~F.col("passed") & F.col("required")
    rows = items.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(lost).alias("failed"), F.count_if(~F.col("passed") & ~F.col("required")).alias("warnings"), F.array_join(F.sort_array(F.collect_list(F.when(lost, F.col("name")))), ", ").alias("names"))
    ready = F.col("failed") == 0
    text = F.when(ready & (F.col("warnings") == 0), "All checks passed. Ready to complete").when(ready, F.concat(F.lit("Ready to complete. "), F.col("warnings").cast("string"), F.lit(" warning(s) to review"))).otherwise(F.concat(F.lit("Not ready. Fix required issues: "), "names"))
    return rows.select("checks", "passed", "failed", "warnings", ready.alias("ready"), text.alias("recommendation"))


def validate(findings: DataFrame, functions: DataFrame, state: DataFrame) -> DataFrame:
    """One row: status error with critical findings, warn with others, else ok; functions indexed; the active feature."""
    a = findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count("*").alias("findings"))
    b = functions.agg(F.count("*").alias("functions"))
    c = state.agg(F.min(F.when(F.col("status") == "active", F.col("name"))).alias("active_feature"))
    status = F.when(F.col("critical") > 0, "error").when(F.col("findings") > 0, "warn").otherwise("ok")
    return a.crossJoin(b).crossJoin(c).select(status.alias("status"), "critical", "findings", "functions", "active_feature", (F.col("critical") == 0).alias("can_finish"))


# --- rules over files ----------------------------------------------------------------------------------------------


def project_types(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """(type, priority, rule_ord, chosen) of rules that match files (file, text); the first of highest priority is chosen."""
    spark: SparkSession = files.sparkSession
    rows = [(k, name, p, j, ("^" + m.replace(".", r"\.").replace("*", "[^/]*") + "$"), m.lstrip("*") if m.startswith("*") else m, m.startswith("*"), content) for k, (name, p, marks, content) in enumerate(P.PROJECT_TYPES) for j, m in enumerate(marks)]
    rules = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[5], r[6], r[7]) for r in rows], "rule_ord int, type string, priority int, mark_ord int, mark string, suffix boolean, content string")
    near = files.where(F.size(F.split("file", "/")) <= max_depth).select(basename(F.col("file")).alias("base"), "text")
    hit = F.when(F.col("suffix"), F.col("base").endswith(F.col("mark"))).otherwise(F.col("base") == F.col("mark"))
    ok = F.col("content").isNull() | F.contains(F.coalesce("text", F.lit("")), F.col("content"))
    found = near.join(F.broadcast(rules), hit & ok).select("rule_ord", "type", "priority").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("priority"), "rule_ord")  # at most a row for each rule
    return found.withColumn("chosen", F.row_number().over(w) == 1)


def safe_to_modify(files: DataFrame, own_project: bool = False) -> DataFrame:
    """(file, safe, reason): protected paths, and the engine's own sources, are not."""
    path = F.regexp_replace("file", r"\\", "/")
    reason: Column | None = None
    for p in P.PROTECTED:
        text = F.lit(f"Protected path: {p}")
        reason = F.when(F.contains(path, F.lit(p)), text) if reason is None else reason.when(F.contains(path, F.lit(p)), text)
    own = F.lit(own_project) & (path.startswith("src/") | F.contains(path, F.lit("/src/")))
    return files.select("file", reason.when(own, "Own source code").alias("reason")).select("file", F.col("reason").isNull().alias("safe"), "reason")


def needs_force(files: DataFrame, most: int = 5) -> DataFrame:
    return files.agg(F.count("*").alias("files")).withColumn("force", F.col("files") > most)
