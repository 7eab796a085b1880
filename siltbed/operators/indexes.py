"""Indexes of functions, HTTP routes and hardware use: line-wise extraction by catalogs of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.functions.text import blank_to_null, case_of, strip
from siltbed.sources.corpus import language


# --- functions -----------------------------------------------------------------------------------------------------


def parameters(params: Column) -> Column:
    """ARRAY<STRUCT<name, type>> of a parameter list; a missing type is null."""
    def one(p: Column) -> Column:
        parts = F.split(strip(p), r"[: \t\n\f\r]+")
        return F.struct(F.regexp_replace(F.element_at(parts, 1), r"^([^*&]*)[*&]", "$1").alias("name"), F.try_element_at(parts, F.lit(2)).alias("type"))

    return F.when(strip(params) == "", F.array().cast("array<struct<name:string,type:string>>")).otherwise(F.transform(F.split(params, ","), one))


def functions(lines: DataFrame) -> DataFrame:
    """(name, file, line, signature, return_type, parameters): the first match a line of each pattern of its language.

    A name found twice on a line, by a declaration and as a method, is one row, of the earlier pattern; statements that
    look like calls are none.
    """
    lang = language(F.col("file"))
    rows = lines.withColumn("language", lang).where(F.col("language").isNotNull() & F.contains("line", F.lit("(")))

    def group(d: P.Definition, k: int) -> Column:
        return F.regexp_extract("line", d.regex, k) if k else F.lit("")

    hits = F.array(*[F.when(F.col("language") == d.language, F.struct(F.lit(k).alias("ord"), group(d, d.name).alias("name"), strip(F.regexp_extract("line", d.regex, 0)).alias("signature"), blank_to_null(strip(group(d, d.result))).alias("return_type"), group(d, d.params).alias("params"))) for k, d in enumerate(P.DEFINITIONS)])
    rows = rows.select("file", "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull() & (h["name"] != "") & ~h["name"].isin(*P.CONTROL_WORDS))).alias("h"))
    best = rows.groupBy("file", "line_no", "h.name").agg(F.min_by("h", F.col("h.ord")).alias("h"))
    return best.select("name", "file", F.col("line_no").alias("line"), "h.signature", "h.return_type", parameters(F.col("h.params")).alias("parameters"))


def search_functions(index: DataFrame, query: str, file: str | None = None, top: int | None = 20) -> DataFrame:
    q = F.lit(query.lower())
    rows = index.where(F.contains(F.lower("name"), q) | F.contains(F.lower("signature"), q))
    rows = rows if file is None else rows.where(F.contains("file", F.lit(file)))
    rows = rows.orderBy("file", "line", "name")
    return rows if top is None else rows.limit(top)


def count_by(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    out = rows.groupBy(key).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), key).limit(top)


# --- routes --------------------------------------------------------------------------------------------------------


def frameworks(manifests: DataFrame) -> DataFrame:
    """(framework), distinct, by the manifests (file, text); express where none is known."""
    hits = None
    for name, file, text in P.ROUTE_MARKERS:
        part = manifests.where(F.col("file").endswith(file) & F.contains(F.lower("text"), F.lit(text))).select(F.lit(name).alias("framework"))
        hits = part if hits is None else hits.union(part)
    known = hits.distinct()
    fallback = manifests.sparkSession.createDataFrame([("express",)], "framework string").join(known.limit(1).select(F.lit(True).alias("any")), how="left")
    return known.union(fallback.where("any is null").select("framework"))


def routes(lines: DataFrame, framework: tuple[str, ...] = ("express",), by_file_name: bool = True) -> DataFrame:
    """(method, path, handler, file, line), distinct. The handler is named in the line or one of the next two."""
    w = Window.partitionBy("file").orderBy("line_no")
    near = F.concat_ws(" ", F.col("line"), *[F.when(F.lead("line_no", k).over(w) <= F.col("line_no") + 2, F.lead("line", k).over(w)) for k in (1, 2)])
    rows = lines.withColumn("near", near)
    catalog = [r for r in P.ROUTES if r.framework in framework]
    hits = []
    for r in catalog:
        fits = F.col("line").rlike(r.regex) & (F.col("file").rlike(P.ROUTE_FILES[r.framework]) if by_file_name else F.lit(True))
        method = F.upper(F.regexp_extract("line", r.regex, r.method)) if r.method else F.lit(r.default)
        hits.append(F.when(fits, F.struct(method.alias("method"), F.regexp_extract("line", r.regex, r.path).alias("path"))))
    handler = F.coalesce(*[blank_to_null(F.regexp_extract("near", h, 1)) for h in P.HANDLERS], F.lit("anonymous"))
    rows = rows.select("file", "line_no", handler.alias("handler"), F.explode(F.array_distinct(F.filter(F.array(*hits), lambda h: h.isNotNull()))).alias("h"))
    return rows.select("h.method", "h.path", "handler", "file", F.col("line_no").alias("line"))


def search_routes(index: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return index.where(F.contains(F.lower("path"), q) | F.contains(F.lower("handler"), q) | F.contains(F.lower("method"), q))


def first_per_file(rows: DataFrame, most: int = 10) -> DataFrame:
    w = Window.partitionBy("file").orderBy("line", "method", "path")
    return rows.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= most)


# --- hardware ------------------------------------------------------------------------------------------------------


def pins(line: Column) -> Column:
    """Distinct pins of a line, in the order of patterns, then of matches."""
    lists = []
    for regex, groups in P.PINS:
        found = [F.regexp_extract_all(line, F.lit(regex), F.lit(g)) for g in groups]
        lists.append(found[0] if len(found) == 1 else F.flatten(F.zip_with(found[0], found[1], lambda a, b: F.array(a, b))))
    return F.array_distinct(F.filter(F.concat(*lists), lambda p: p != ""))


def peripherals(lines: DataFrame) -> DataFrame:
    """(type, name, pins, file, line): the first match a line of each kind."""
    any_ = "|".join(f"(?:{r})" for _, r in P.PERIPHERALS)
    rows = lines.where(F.col("line").rlike(any_))
    hits = F.array(*[F.when(F.col("line").rlike(r), F.struct(F.lit(k).alias("type"), F.regexp_extract("line", r, 0).alias("name"))) for k, r in P.PERIPHERALS])
    rows = rows.select("file", "line_no", pins(F.col("line")).alias("pins"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("h.type", "h.name", "pins", "file", F.col("line_no").alias("line"))


def defines(lines: DataFrame) -> DataFrame:
    """(name, value, file, line) of constants whose name speaks of hardware."""
    hits = F.array(*[F.when(F.col("line").rlike(r), F.struct(F.regexp_extract("line", r, 1).alias("name"), F.regexp_extract("line", r, 2).alias("value"))) for r in P.DEFINES])
    rows = lines.select("file", "line_no", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).where(F.upper("h.name").rlike(P.HARDWARE_WORDS))
    return rows.select("h.name", "h.value", "file", F.col("line_no").alias("line"))


def signal_type(signal: Column) -> Column:
    return case_of(F.upper(signal), P.SIGNALS, "OTHER")


def pin_config(lines: DataFrame) -> DataFrame:
    """Peripherals of ``.ioc`` lines such as ``PA5.Signal=SPI1_SCK``."""
    regex = r"(?i)^(P[A-H]\d+)\.(\w+)=(.+)$"
    rows = lines.where(F.col("file").endswith(".ioc") & F.regexp_extract("line", regex, 2).isin("Signal", "Mode"))
    value = F.regexp_extract("line", regex, 3)
    return rows.select(signal_type(value).alias("type"), value.alias("name"), F.array(F.regexp_extract("line", regex, 1)).alias("pins"), "file", F.col("line_no").alias("line"))


def sdk_config(lines: DataFrame) -> DataFrame:
    """Defines of ``sdkconfig`` lines such as ``CONFIG_LED_PIN=5``; comments are skipped."""
    regex = r"(?i)^CONFIG_(\w+)=(\d+)$"
    name = F.regexp_extract("line", regex, 1)
    rows = lines.where(F.col("file").rlike("(?:^|/)sdkconfig$") & ~F.col("line").startswith("#") & (F.contains(name, F.lit("GPIO")) | F.contains(name, F.lit("PIN"))))
    return rows.select(name.alias("name"), F.regexp_extract("line", regex, 2).alias("value"), "file", F.col("line_no").alias("line"))
