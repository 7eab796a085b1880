"""Every query over the shared tables, and its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.operators import duplicates, imports, indexes, knowledge, refactor, review, secrets, similarity, state
from siltbed.plans.derived import corpus_sql, derived, lines_sql, oracle, quote, squeeze_sql, strip_sql, table
from siltbed.sources.corpus import from_table, lines, sections

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def joined(c: str, sep: str = ",") -> Column:
    return F.array_join(c, sep).alias(c)


# --- sources -------------------------------------------------------------------------------------------------------

_DOCS = corpus_sql("documents", "doc_id", suffix=".py")
_PAGES = corpus_sql("pages", "page_id", "html", ".js")
_BOTH = f"(select * from {_DOCS} union all select * from {_PAGES})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "documents"), "doc_id", suffix=".py")


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).unionByName(from_table(table(spark, sf_dir, "pages"), "page_id", "html", ".js"))


@query(f"select file, count(*) as n, max(line_no) as last, sum(length(line))::bigint as chars from {lines_sql(_DOCS)} group by file")
def src_lines(spark, sf_dir):
    return lines(docs(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.sum(F.length("line")).alias("chars"))


@query(f"select feature as file, count(*) as n, sum(length(section))::bigint as chars from (select feature, unnest(string_split_regex(text, '(?m)^## ')[2:]) as section from {oracle('notes')}) group by feature")
def src_sections(spark, sf_dir):
    notes = derived(spark, sf_dir, "notes").withColumnRenamed("feature", "file")
    return sections(notes).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("section")).alias("chars"))


# --- secrets -------------------------------------------------------------------------------------------------------

_RAW = "(" + " union all ".join(f"select file, line_no, line, {k} as pattern_ord, {quote(s.name)} as pattern, '{s.kind}' as type, '{s.severity}' as severity, {quote(s.advice)} as suggestion, unnest(regexp_extract_all(line, {quote(s.regex)})) as raw, unnest(range(0, len(regexp_extract_all(line, {quote(s.regex)}))))::int as match_ord from l where regexp_matches(line, {quote(s.regex)})" for k, s in enumerate(P.SECRETS)) + ")"
_MASK = "case when length(raw) <= 8 then '***' else concat(substr(raw, 1, 4), '...', right(raw, 4)) end"
_WITH = f"with l as (select * from {lines_sql(_BOTH)}), raw as (select * from {_RAW}) "


def raw(spark, sf_dir):
    return secrets.raw_findings(lines(both(spark, sf_dir)))


@query(_WITH + f"select type, severity, file, line_no as line, pattern, match_ord, {_MASK} as match, suggestion from raw")
def sec_findings(spark, sf_dir):
    return secrets.findings(lines(both(spark, sf_dir)))


@query(_WITH + "select case when severity in ('critical', 'high') then severity else 'other' end as severity, count(*) as findings, count(distinct file) as files from raw group by 1")
def sec_by_severity(spark, sf_dir):
    return secrets.by_severity(sec_findings(spark, sf_dir))


@query(_WITH + "select severity, type, count(*) as findings from raw group by rollup(severity, type) having count(*) > 0")
def sec_rollup(spark, sf_dir):
    return secrets.rollup(sec_findings(spark, sf_dir))


@query(_WITH + f"select type, severity, file, line_no as line, pattern, match_ord, {_MASK} as match, suggestion from raw r where not exists (select 1 from raw w where w.file like '%7.py' and w.file = r.file and w.raw = r.raw)")
def sec_whitelist(spark, sf_dir):
    listed = raw(spark, sf_dir).where("file like '%7.py'").select("file", "raw").distinct()
    return secrets.findings(lines(both(spark, sf_dir)), whitelist=listed)


_VAR = "trim(regexp_replace(upper(pattern), '[^A-Z0-9]+', '_', 'g'), '_')"
_HOLD = " ".join(f"when lower(pattern) like '%{k}%' then '{v}'" for k, v in P.PLACEHOLDERS)
_COVER = "lambda x: contains(x, raw) and instr(line, x) <= instr(line, raw) and instr(line, x) + length(x) >= instr(line, raw) + length(raw)"
_SPANS = quote("'[^'\"`]*'|\"[^'\"`]*\"|`[^'\"`]*`")
_PLAN = f"""plan as (select file, line_no as line, coalesce(list_filter(regexp_extract_all(line, {_SPANS}), {_COVER})[1], raw) as original,
  case when file like '%.py' then concat('os.environ.get(''', {_VAR}, ''')') else concat('process.env.', {_VAR}) end as replacement, {_VAR} as env_var, case {_HOLD} else 'your-value-here' end as placeholder
  from (select *, row_number() over (partition by file, line_no order by pattern_ord, match_ord) as nth from raw) where nth = 1)"""


@query(_WITH + f", {_PLAN} select * from plan")
def sec_fix_plan(spark, sf_dir):
    return secrets.fix_plan(raw(spark, sf_dir))


@query(_WITH + f", {_PLAN} select distinct env_var, placeholder from plan")
def sec_env_file(spark, sf_dir):
    return secrets.env_file(sec_fix_plan(spark, sf_dir))


@query(_WITH + f", {_PLAN} select distinct env_var, placeholder from plan where env_var <> 'SECRET_IN_CODE'")
def sec_env_new(spark, sf_dir):
    existing = spark.createDataFrame([("SECRET_IN_CODE",), ("OTHER",)], "env_var string")
    return secrets.env_file(sec_fix_plan(spark, sf_dir), existing)


@query(_WITH + f", {_PLAN} select file, count(*) as n, string_agg(concat('Line ', line, ': ', case when length(original) > 20 then concat(substr(original, 1, 10), '...', right(original, 10)) else original end, ' -> ', replacement), chr(10) order by line) as steps from plan group by file")
def sec_instructions(spark, sf_dir):
    return secrets.instructions(sec_fix_plan(spark, sf_dir))


# --- functions, routes, hardware -----------------------------------------------------------------------------------

_FN = f"(select regexp_extract(line, 'def (\\w+)\\(', 1) as name, file, line_no as line, line as signature, regexp_extract(line, '-> ([^:]+):', 1) as return_type, 'size:int,brand:' as parameters from {oracle('python_lines')})"


def fn_all(spark, sf_dir):
    return indexes.functions(derived(spark, sf_dir, "python_lines"))


def shown(fns):
    return fns.withColumn("parameters", F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type"], F.lit("")))), ","))


@query(f"select * from {_FN}")
def fn_index(spark, sf_dir):
    return shown(fn_all(spark, sf_dir))


@query(f"select * from {_FN} where contains(lower(name), 'ste') or contains(lower(signature), 'ste') order by file, line, name limit 20")
def fn_search(spark, sf_dir):
    return shown(indexes.search_functions(fn_all(spark, sf_dir), "STE"))


@query(f"select file, count(*) as n from {_FN} group by file order by n desc, file limit 10")
def fn_top_files(spark, sf_dir):
    return indexes.count_by(fn_all(spark, sf_dir), "file", 10)


_FN5 = f"""(select regexp_extract(line, '([Ff]n_?\\d+)\\(', 1) as name, file, line_no as line, case when file like '%.c' then line else regexp_replace(line, ' \\{{$', '') end as signature,
 case when file like '%.go' then 'error' when file like '%.rs' then 'bool' when file like '%.ts' then 'string' else 'int' end as return_type,
 case when file like '%.go' then 'size:int' when file like '%.rs' then 'size:i32' when file like '%.ts' then 'size:number' else 'int:size' end as parameters from {oracle('function_lines')})"""


@query(f"select * from {_FN5}")
def fn_languages(spark, sf_dir):
    return shown(indexes.functions(derived(spark, sf_dir, "function_lines")))


@query(f"select * from {_FN5} where (contains(lower(name), 'fn1') or contains(lower(signature), 'fn1')) and contains(file, '.cs') order by file, line, name limit 20")
def fn_search_file(spark, sf_dir):
    return shown(indexes.search_functions(indexes.functions(derived(spark, sf_dir, "function_lines")), "FN1", file=".cs"))


def _routes_sql() -> str:
    rows = " union all ".join(f"select file, line_no, near, upper(regexp_extract(line, {quote(r.regex)}, {r.method})) as method, regexp_extract(line, {quote(r.regex)}, {r.path}) as path from n where regexp_matches(line, {quote(r.regex)})" for r in P.ROUTES if r.framework == "express")
    handler = ", ".join(f"nullif(regexp_extract(near, {quote(h)}, 1), '')" for h in P.HANDLERS)
    near = " , ".join(f"case when lead(line_no, {k}) over w <= line_no + 2 then lead(line, {k}) over w end" for k in (1, 2))
    return f"(with n as (select *, concat_ws(' ', line, {near}) as near from {oracle('route_lines')} window w as (partition by file order by line_no)) select distinct method, path, coalesce({handler}, 'anonymous') as handler, file, line_no as line from ({rows}))"


@query(f"select * from {_routes_sql()}")
def rt_index(spark, sf_dir):
    return indexes.routes(derived(spark, sf_dir, "route_lines"))


@query(f"select * from {_routes_sql()} where contains(lower(path), '/en') or contains(lower(handler), '/en') or contains(lower(method), '/en')")
def rt_search(spark, sf_dir):
    return indexes.search_routes(rt_index(spark, sf_dir), "/EN")


@query(f"select * from (select *, row_number() over (partition by file order by line, method, path) as nth from {_routes_sql()}) where nth <= 10")
def rt_by_file(spark, sf_dir):
    return indexes.first_per_file(rt_index(spark, sf_dir), 10)


@query(f"select case p when 0 then 'GET' when 1 then 'GET' when 2 then 'POST' when 3 then 'ALL' when 4 then 'DELETE' else 'PUT' end as method, concat('/p', k) as path, 'anonymous' as handler, file, k as line from (select file, line_no as k, line_no % 6 as p from {oracle('web_lines')})")
def rt_frameworks_index(spark, sf_dir):
    return indexes.routes(derived(spark, sf_dir, "web_lines"), ("flask", "fastapi", "go", "aspnet"))


@query(f"select distinct case when file like '%.json' then 'express' when file like '%.txt' then 'flask' else 'aspnet' end as framework from {oracle('manifests')}")
def rt_frameworks(spark, sf_dir):
    return indexes.frameworks(derived(spark, sf_dir, "manifests"))


def _pins_sql() -> str:
    lists = []
    for r, groups in P.PINS:
        got = [f"regexp_extract_all(line, {quote(r)}, {g})" for g in groups]
        lists.append(got[0] if len(got) == 1 else f"flatten(list_transform(range(1, len({got[0]}) + 1), lambda i: [{got[0]}[i], {got[1]}[i]]))")
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return f"array_to_string(list_sort(list_distinct({out})), ',')"


_HW = "(" + " union all ".join(f"select '{k}' as type, regexp_extract(line, {quote(r)}) as name, {_pins_sql()} as pins, file, line_no as line from {oracle('board_lines')} where regexp_matches(line, {quote(r)})" for k, r in P.PERIPHERALS) + ")"


@query(f"select * from {_HW}")
def hw_peripherals(spark, sf_dir):
    return indexes.peripherals(derived(spark, sf_dir, "board_lines")).withColumn("pins", F.array_join(F.sort_array("pins"), ","))


@query(f"select type, count(*) as n from {_HW} group by type")
def hw_by_type(spark, sf_dir):
    return indexes.count_by(indexes.peripherals(derived(spark, sf_dir, "board_lines")), "type")


@query("select * from (" + " union all ".join(f"select regexp_extract(line, {quote(r)}, 1) as name, regexp_extract(line, {quote(r)}, 2) as value, file, line_no as line from {oracle('board_lines')} where regexp_matches(line, {quote(r)})" for r in P.DEFINES) + f") where regexp_matches(upper(name), '{P.HARDWARE_WORDS}')")
def hw_defines(spark, sf_dir):
    return indexes.defines(derived(spark, sf_dir, "board_lines"))


@query(f"select case {' '.join(f'when regexp_matches(upper(v), {quote(p)}) then {quote(t)}' for p, t in P.SIGNALS)} else 'OTHER' end as type, v as name, regexp_extract(line, '^(\\w+)', 1) as pins, file, line_no as line from (select *, regexp_extract(line, '=(.+)$', 1) as v from {oracle('pin_lines')}) where contains(line, '.Signal=')")
def hw_pin_config(spark, sf_dir):
    return indexes.pin_config(derived(spark, sf_dir, "pin_lines")).select("type", "name", joined("pins"), "file", "line")


@query(f"select regexp_extract(line, 'CONFIG_(\\w+)', 1) as name, regexp_extract(line, '=(\\d+)', 1) as value, file, line_no as line from {oracle('sdk_lines')} where not starts_with(line, '#') and contains(line, 'PIN')")
def hw_sdk_config(spark, sf_dir):
    return indexes.sdk_config(derived(spark, sf_dir, "sdk_lines"))


# --- duplicates and similarity -------------------------------------------------------------------------------------

_WINDOWS = f"""
w0 as (select file, list_transform(list_transform(string_split(text, chr(10)), lambda x: {squeeze_sql('x')}), lambda x: case when starts_with(x, '//') or starts_with(x, '#') or starts_with(x, '*') then '' else x end) as clean from {_DOCS} where text is not null),
w1 as (select file, clean, len(clean) as n, list_transform(clean, lambda x: case when x <> '' then length(x) + 1 else 0 end) as sizes, list_transform(clean, lambda x: length(regexp_replace(x, '[^a-zA-Z]+', '', 'g'))) as letters from w0 where len(clean) >= 5),
w2 as (select *, unnest(range(5, least(50, n) + 1)) as size from w1),
w3 as (select *, unnest(range(1, n - size + 2)) as s from w2),
w4 as (select *, list_sum(sizes[s:s + size - 1]) - 1 as chars, list_sum(letters[s:s + size - 1]) as alpha from w3),
w5 as (select file, s, size, array_to_string(list_filter(clean[s:s + size - 1], lambda x: x <> ''), ' ') as content from w4 where chars >= 50 and alpha >= 0.3::double * chars),
w as (select substr(md5(content), 1, 12) as hash, file, s::bigint as start_line, (s + size - 1)::bigint as end_line, case when length(content) > 100 then concat(substr(content, 1, 100), '...') else content end as preview
  from w5 where not regexp_matches(substr(content, 1, 16), {quote(duplicates.IMPORT_LIKE)}))"""
_GROUPS = f"""with {_WINDOWS},
f as (select hash, file, min(preview) as preview, list_sort(list({{'s': start_line, 'e': end_line}})) as spans from w group by hash, file),
k as (select hash, file, preview, unnest(list_reduce(list_transform(spans, lambda x: [x]), lambda a, x: case when x[1].s > a[-1].e then list_concat(a, x) else a end)) as o from f),
g as (select hash, max(o.e - o.s + 1)::bigint as lines, count(*) as occurrences, count(distinct file) as files, min(preview) as preview, string_agg(concat(file, ':', o.s, '-', o.e), ' ' order by file, o.s) as places from k group by hash having count(*) >= 2) """


def dup_all(spark, sf_dir):
    return duplicates.groups(duplicates.windows(docs(spark, sf_dir)), docs(spark, sf_dir))


def dup_largest(spark, sf_dir, top):
    return duplicates.largest(duplicates.windows(docs(spark, sf_dir)), docs(spark, sf_dir), top)


def flat_groups(g):
    n = F.size("occurrences")
    places = F.array_join(F.transform("occurrences", lambda o: F.concat(o["file"], F.lit(":"), o["start_line"].cast("string"), F.lit("-"), o["end_line"].cast("string"))), " ")
    return g.select("hash", "lines", n.cast("long").alias("occurrences"), F.size(F.array_distinct(F.transform("occurrences", lambda o: o["file"]))).cast("long").alias("files"), "preview", places.alias("places"))


@query(_GROUPS + "select hash, lines, occurrences, files, preview, places from g")
def dup_groups(spark, sf_dir):
    return flat_groups(dup_all(spark, sf_dir))


@query(f"with {_WINDOWS} select hash, count(*) as occurrences, count(distinct file) as files, max(end_line - start_line + 1) as lines from w group by hash having count(*) >= 2")
def dup_counts(spark, sf_dir):
    return duplicates.counts(duplicates.windows(docs(spark, sf_dir)))


@query(_GROUPS + "select hash, lines, occurrences, files, preview, places from g order by occurrences desc, lines desc, hash limit 50")
def dup_report(spark, sf_dir):
    return flat_groups(dup_largest(spark, sf_dir, 50))


@query(_GROUPS + "select count(*) as groups, coalesce(sum(occurrences), 0)::bigint as occurrences, coalesce(round(avg(lines)), 0)::bigint as mean_lines, coalesce(sum(lines * (occurrences - 1)), 0)::bigint as removable_lines from g")
def dup_summary(spark, sf_dir):
    return duplicates.summary(duplicates.sizes(duplicates.windows(docs(spark, sf_dir))))


@query(_GROUPS + """, t as (select *, row_number() over (order by occurrences desc, lines desc, hash) as nth from g)
select nth, lines, occurrences, preview, array_to_string(string_split(places, ' ')[1:3], ' ') as shown, greatest(occurrences - 3, 0) as more from t where nth <= 5""")
def dup_listing(spark, sf_dir):
    return duplicates.listing(dup_largest(spark, sf_dir, 5)).withColumn("shown", joined("shown", " "))


SNIPPET = "The of, and to.\nIt is (the) = of;\nwith the by"
_TOK = quote(r"[a-z_][a-z0-9_]*|[\{\}()\[\];,=<>!+\-*/&|^%]")


def _grams(t: str) -> str:
    """Distinct 1- to 3-grams of a column of tokens."""
    two = f"list_transform(range(1, greatest(len({t}), 1)), lambda i: concat({t}[i], ' ', {t}[i + 1]))"
    three = f"list_transform(range(1, greatest(len({t}) - 1, 1)), lambda i: concat({t}[i], ' ', {t}[i + 1], ' ', {t}[i + 2]))"
    return f"list_distinct(list_concat(list_concat({t}, {two}), {three}))"


def _norm(x: str) -> str:
    return f"lower(array_to_string(list_filter(list_transform({x}, lambda y: {squeeze_sql('y')}), lambda y: y <> '' and not starts_with(y, '//') and not starts_with(y, '#') and not starts_with(y, '*')), ' '))"


_SIM = f"""with q as materialized (select {_grams('t')} as want from (select regexp_extract_all({_norm(f"string_split({quote(SNIPPET)}, chr(10))")}, {_TOK}) as t)),
s0 as (select file, string_split(text, chr(10)) as ls, list_transform(list_transform(string_split(text, chr(10)), lambda y: {squeeze_sql('y')}), lambda y: case when starts_with(y, '//') or starts_with(y, '#') or starts_with(y, '*') then '' else lower(y) end) as clean from {_DOCS} where text is not null),
s1 as (select file, ls, clean, unnest(range(1, len(ls) - 1)) as s from s0 where len(ls) >= 3),
s2 as materialized (select file, s, ls[s] as first, regexp_extract_all(array_to_string(list_filter(clean[s:s + 2], lambda y: y <> ''), ' '), {_TOK}) as t from s1),
s3 as materialized (select file, s, first, {_grams('t')} as grams from s2),
s3b as materialized (select file, s, first, len(grams) as n, len(want) as m, len(list_intersect(grams, want)) as both_ from s3, q),
s4 as (select file, s, first, case when n = 0 or m = 0 then 0.0::double else both_ * 100.0::double / (n + m - both_) end as score from s3b),
best as (select file, list_sort(list({{'o': -score, 's': s::bigint, 'e': (s + 2)::bigint, 'sim': round(score)::int, 'p': case when length({strip_sql('first')}) > 80 then concat(substr({strip_sql('first')}, 1, 77), '...') else {strip_sql('first')} end}})) as found from s4 where score >= 6 group by file),
apart as (select file, unnest(list_reduce(list_transform(found, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda k: not (x[1].e < k.s or x[1].s > k.e))) > 0 then a else list_concat(a, x) end)) as m from best)
select file, m.s as start_line, m.e as end_line, m.sim as similarity, m.p as preview from apart order by similarity desc, file, start_line limit 200"""


@query(_SIM)
def sim_search(spark, sf_dir):
    return similarity.similar(docs(spark, sf_dir), SNIPPET, min_similarity=6, top=200)


# --- imports -------------------------------------------------------------------------------------------------------

_EDGES = f"""(select file as src, concat('./m', (k * k + 1) % 97) as spec, concat('src/m', (k * k + 1) % 97, '.ts') as dst, false as external from (select file, regexp_extract(file, 'm(\\d+)', 1)::bigint as k from {oracle('scripts')})
 union all select file, concat('./gone', k % 5, '.js'), concat('src/gone', k % 5, '.js'), false from (select file, regexp_extract(file, 'm(\\d+)', 1)::bigint as k from {oracle('scripts')})
 union all select file, concat('lib', k % 7), null, true from (select file, regexp_extract(file, 'm(\\d+)', 1)::bigint as k from {oracle('scripts')}))"""
_EDGES = _EDGES.replace("concat('src/m', (k * k + 1) % 97, '.ts') as dst", "case when exists (select 1 from f where f.file = concat('src/m', (k * k + 1) % 97, '.ts')) then concat('src/m', (k * k + 1) % 97, '.ts') else concat('src/m', (k * k + 1) % 97) end as dst")
_DEP = f"with f as (select file from {oracle('scripts')}), e as (select * from {_EDGES}) "


def dep_all(spark, sf_dir):
    corpus = derived(spark, sf_dir, "scripts")
    return corpus, imports.edges(corpus)


@query(_DEP + "select * from e")
def dep_edges(spark, sf_dir):
    return dep_all(spark, sf_dir)[1]


@query(_DEP + "select dst as file, string_agg(distinct src, ',' order by src) as imported_by from e where dst in (select file from f) group by dst")
def dep_reverse(spark, sf_dir):
    corpus, found = dep_all(spark, sf_dir)
    return imports.reverse(found, corpus).select("file", joined("imported_by"))


@query(_DEP + "select file, case when regexp_matches(regexp_extract(file, '([^/]*)$', 1), 'index|main|app|server|cli') or file in (select src from e where not external) then 'entry' else 'orphan' end as role from f where file not in (select dst from e where dst is not null)")
def dep_roles(spark, sf_dir):
    corpus, found = dep_all(spark, sf_dir)
    return imports.classify(found, corpus)


@query(_DEP + "select dst as file, count(*) as n from e where dst is not null group by dst order by n desc, file limit 10")
def dep_most_imported(spark, sf_dir):
    return imports.degrees(dep_all(spark, sf_dir)[1])[0]


@query(_DEP + "select src as file, count(*) as n from e where dst is not null group by src order by n desc, file limit 10")
def dep_most_importing(spark, sf_dir):
    return imports.degrees(dep_all(spark, sf_dir)[1])[1]


@query(_DEP + "select (select count(*) from f) as files, count(*) as imports, count(*) filter (where not external) as internal, count(*) filter (where external) as external, string_agg(distinct spec, ',' order by spec) filter (where external) as external_names from e")
def dep_report(spark, sf_dir):
    corpus, found = dep_all(spark, sf_dir)
    return imports.report(found, corpus).withColumn("external_names", joined("external_names"))


_I4 = oracle("import_files")


@query(f"""select file as src, 'lib.a' as spec, null as dst, true as external from {_I4} where k % 4 = 0
 union all select file, concat('.m', (k * 3) % 97), concat('pkg/m', (k * 3) % 97, '.py'), false from {_I4} where k % 4 = 0
 union all select file, '..up', 'up.py', false from {_I4} where k % 4 = 0
 union all select file, concat('fmt', k), concat('fmt', k), false from {_I4} where k % 4 = 1
 union all select file, 'example.com/y', null, true from {_I4} where k % 4 = 1
 union all select file, concat('crate::m', k), concat('crate::m', k), false from {_I4} where k % 4 = 2
 union all select file, unnest(['sub', 'std::io']), null, true from {_I4} where k % 4 = 2
 union all select file, 'System.Text', null, true from {_I4} where k % 4 = 3
 union all select file, concat('App.M', k), concat('App.M', k), false from {_I4} where k % 4 = 3""")
def dep_languages(spark, sf_dir):
    return imports.edges(derived(spark, sf_dir, "import_files"))


@query(_DEP + """, m as (select dst as item, count(*) as n from e where dst is not null group by dst)
select 'total' as section, 1::bigint as nth, 'files' as item, (select count(*) from f) as n union all select 'total', 2, 'imports', (select count(*) from e) union all select 'total', 3, 'external', (select count(distinct spec) from e where external)
union all select 'most imported', nth, item, n from (select *, row_number() over (order by n desc, item) as nth from m) where nth <= 5""")
def dep_summary(spark, sf_dir):
    """Without the sections of cycles and orphans, which this corpus has none of or dep_cycles and dep_roles compare."""
    corpus, found = dep_all(spark, sf_dir)
    none = spark.createDataFrame([], "length int, cycle string")
    return imports.summary(found, corpus, none).where("section in ('total', 'most imported')")


@query(f"""with recursive g as (select * from {oracle('graph')}), walk(root, last, path, n) as (
  select src, dst, [src], 1 from g where src <= dst
  union all select w.root, g.dst, list_append(w.path, w.last), w.n + 1 from walk w join g on w.last = g.src where w.n < 8 and w.last <> w.root and g.dst >= w.root and not list_contains(w.path, w.last))
select n as length, array_to_string(path, '>') as cycle from walk where last = root""")
def dep_cycles(spark, sf_dir):
    return imports.cycles(derived(spark, sf_dir, "graph"))


@query("select page_id, link, not starts_with(link, '/') as external from (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as link from pages)")
def page_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("link"))
    return rows.select("page_id", "link", (~F.col("link").startswith("/")).alias("external"))


# --- refactoring ---------------------------------------------------------------------------------------------------

_ALLOWED = ", ".join(f"'{x}'" for x in P.ALLOWED_NUMBERS)
_MAGIC = f"""(select file, line, (rank - 1)::int as match_ord, value, context from (select file, line_no as line, {strip_sql('line')} as context, unnest(v) as value, unnest(range(1, len(v) + 1)) as rank from
  (select *, list_filter(list_transform(regexp_extract_all(line, '0x[0-9a-fA-F]{{3,}}[a-zA-Z_0-9]*|[a-zA-Z_]?[0-9]+[a-zA-Z_]?'), lambda m: case when regexp_full_match(m, '\\d{{2,}}|0x[0-9a-fA-F]{{3,}}|[a-zA-Z_]\\d{{3,}}') then regexp_replace(m, '^[a-zA-Z_]\\d', '') end), lambda m: m is not null) as v from {oracle('code_lines')}))
  where value not in ({_ALLOWED}) and not regexp_matches(context, '^(?://|#|import|const )'))"""


def magic(spark, sf_dir):
    return refactor.magic_numbers(derived(spark, sf_dir, "code_lines"))


@query(f"select * from {_MAGIC}")
def ref_magic_numbers(spark, sf_dir):
    return magic(spark, sf_dir)


@query(f"""select file, line, match_ord, value, case when again = 0 then name else concat(name, '_', again) end as const_name,
 concat(case when file like '%.py' then '' else 'const ' end, case when again = 0 then name else concat(name, '_', again) end, ' = ', value) as definition
 from (select *, row_number() over (partition by file, name order by line, match_ord, value, context) - 1 as again from (select *, 'TOTAL_PRICE_VALUE' as name, row_number() over (partition by file order by line, match_ord, value, context) as nth from {_MAGIC}) where nth <= 10)""")
def ref_constants(spark, sf_dir):
    return refactor.constant_fixes(magic(spark, sf_dir))


@query(f"select concat('long', n_nationkey, '.js') as file, concat('start', n_nationkey) as name, 1::bigint as start_line, (n_nationkey * 8)::bigint as lines from nation where n_nationkey * 8 > 50 union all select concat('long', n_nationkey, '.js'), 'next', (n_nationkey * 8 + 2)::bigint, (n_nationkey * 4)::bigint from nation where n_nationkey * 4 > 50 order by lines desc, file, start_line limit 20")
def ref_long_functions(spark, sf_dir):
    return refactor.long_functions(derived(spark, sf_dir, "long_corpus"))


@query(_GROUPS + f""", o1 as (select hash, arg_min(file, (file, o.s)) as file, arg_min(o.s, (file, o.s)) as s, arg_min(o.e, (file, o.s)) as e from k group by hash)
select g.hash, 'python' as language, concat('    ', array_to_string(string_split(text, chr(10))[o1.s:o1.e], concat(chr(10), '    ')), chr(10)) as body, occurrences
from g join o1 on g.hash = o1.hash join {_DOCS} c on c.file = o1.file where not regexp_matches({strip_sql('preview')}, {quote(P.NOT_EXTRACTABLE)})""")
def ref_fixes(spark, sf_dir):
    fixes = refactor.duplicate_fixes(dup_all(spark, sf_dir), docs(spark, sf_dir))
    return fixes.select("hash", "language", F.regexp_replace("new_code", r"^def \w+\(\):\n", "").alias("body"), F.size("replacements").cast("long").alias("occurrences"))


@query(_GROUPS + f""", d as (select 'remove-duplicate' as type, case when occurrences >= 3 then 'high' else 'medium' end as priority, hash as key, lines * occurrences as lines, concat('Remove ~', lines * (occurrences - 1), ' duplicate lines') as impact from g where not regexp_matches({strip_sql('preview')}, {quote(P.NOT_EXTRACTABLE)})),
m as (select 'extract-constant' as type, case when count(*) >= 5 then 'medium' else 'low' end as priority, file as key, null::bigint as lines, 'Improved code readability and maintainability' as impact from {_MAGIC} group by file having count(*) >= 3)
select * from d union all select * from m""")
def ref_suggestions(spark, sf_dir):
    rows = refactor.duplicate_suggestions(dup_all(spark, sf_dir)).unionByName(refactor.constant_suggestions(magic(spark, sf_dir)))
    return rows.select("type", "priority", "key", "lines", "impact")


# --- knowledge -----------------------------------------------------------------------------------------------------

_TAGS = "list_filter([" + ", ".join(quote(t) for t in P.TAGS) + "], lambda t: contains(lower(content), t))[1:5]"
_KN = f"(select *, {_TAGS} as tags from {oracle('entries')})"


def kn_base(spark, sf_dir):
    return derived(spark, sf_dir, "entries").withColumn("tags", knowledge.tags(F.col("content")))


@query(f"select id, type, title, array_to_string(tags, ',') as tags from {_KN} where contains(lower(title), 'the') or contains(lower(content), 'the') or len(list_filter(tags, lambda t: contains(t, 'the'))) > 0")
def kn_search(spark, sf_dir):
    return knowledge.search(kn_base(spark, sf_dir), "The").select("id", "type", "title", joined("tags"))


@query(f"select type, count(*) as n from {_KN} group by rollup(type) having count(*) > 0")
def kn_stats(spark, sf_dir):
    return knowledge.stats(kn_base(spark, sf_dir))


@query(f"""select feature, date, case when length(content) > 50 then concat('Decision: ', substr(content, 1, 47), '...') else concat('Decision: ', content) end as title, content, array_to_string({_TAGS}, ',') as tags from
 (select feature, {strip_sql("regexp_extract(s, '^([^' || chr(10) || ']*)', 1)")} as date, {strip_sql("substr(s, length(regexp_extract(s, '^([^' || chr(10) || ']*)', 1)) + 1)")} as content from (select feature, {strip_sql('section')} as s from (select feature, unnest(string_split_regex(text, '(?m)^## ')[2:]) as section from {oracle('notes')}))) where length(content) > 10""")
def kn_decisions(spark, sf_dir):
    notes = derived(spark, sf_dir, "notes").select("feature", F.col("feature").alias("file"), "text", F.array().cast("array<string>").alias("files"))
    return knowledge.decisions(notes).select("source.feature", "source.date", "title", "content", joined("tags"))


def _marked(kind: str, regex: str) -> str:
    rest = f"regexp_replace(line, {quote(regex)}, '', 'g')"
    return f"select '{kind}' as type, concat(file, ':', line_no) as file, {strip_sql(rest)} as content from {oracle('marked_lines')} where regexp_matches(line, {quote(regex)})"


@query("select type, file as place, case when length(content) > 60 then concat(substr(content, 1, 57), '...') else content end as title, content from (" + " union all ".join(_marked(k, r) for k, r in P.MARKERS) + ")")
def kn_markers(spark, sf_dir):
    return knowledge.markers(derived(spark, sf_dir, "marked_lines"), "f", "2024-01-01").select("type", F.col("source.files")[0].alias("place"), "title", "content")


_MARKED = "select type, file as place, case when length(content) > 60 then concat(substr(content, 1, 57), '...') else content end as title, content from (" + " union all ".join(_marked(k, r) for k, r in P.MARKERS) + ")"


@query(f"select sha256(concat_ws(chr(31), type, title, content, 'f')) as id, type, title, content, place from ({_MARKED}) union all select sha256(concat_ws(chr(31), type, title, content, feature)), type, title, content, null from (select case when kind = 'blocker' then 'bug' else 'pattern' end as type, case when length(text) > 60 then concat(substr(text, 1, 57), '...') else text end as title, text as content, feature from {oracle('items')})")
def kn_feature(spark, sf_dir):
    notes = spark.createDataFrame([], "file string, text string, feature string, files array<string>")
    out = knowledge.extract_feature(notes, derived(spark, sf_dir, "items"), derived(spark, sf_dir, "marked_lines"), "f", "2024-01-01")
    return out.select("id", "type", "title", "content", F.try_element_at("source.files", F.lit(1)).alias("place"))


@query("select name, nth, id, title from (select s_name as name, e.id, title, row_number() over (partition by s_name order by e.id) as nth from (select distinct lower(substr(regexp_extract(lower(text), '([a-z]{4,})', 1), 1, 6)) as s_name from benchmark) f join " + _KN + " e on contains(lower(title), s_name) or contains(lower(content), s_name) where s_name <> '') where nth <= 3")
def ft_related(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.substring(F.regexp_extract(F.lower("text"), "([a-z]{4,})", 1), 1, 6).alias("name")).where("name <> ''").distinct()
    return knowledge.related(F.broadcast(names), kn_base(spark, sf_dir)).select("name", "nth", "id", "title")


# --- features, sessions, context -----------------------------------------------------------------------------------

_FT = f"""(select name, min(ts) filter (where action = 'start') as started_at, case when arg_max(action, (ts, seq)) filter (where action in ('start', 'complete')) = 'complete' then 'completed' else 'active' end as status, coalesce(string_agg(text, '|' order by ts, seq) filter (where action = 'decide'), '') as decisions from {oracle('feature_events')} group by name having min(ts) filter (where action = 'start') is not null)"""


def ft_all(spark, sf_dir):
    return state.features(derived(spark, sf_dir, "feature_events"))


@query(f"select f.*, case when status = 'completed' then concat(strftime(done, '%Y-%m-%d'), '_', f.name) end as archive from {_FT} f left join (select name, max(ts) as done from {oracle('feature_events')} where action = 'complete' group by name) d on d.name = f.name")
def ft_list(spark, sf_dir):
    return ft_all(spark, sf_dir).select("name", "started_at", "status", joined("decisions", "|"), "archive")


@query(f"select name, status from {_FT} where status = 'active' order by name limit 1")
def ft_active(spark, sf_dir):
    return state.active_feature(ft_all(spark, sf_dir)).select("name", "status")


@query(f"select n as name from (select distinct concat('feature', cast(o_custkey % 600 as varchar(9))) as n from orders) where n not in (select name from {_FT})")
def ft_new(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("feature"), (F.col("o_custkey") % 600).cast("string")).alias("name"))
    return state.new_features(ft_all(spark, sf_dir), wanted)


_SS = oracle("session_events")


@query(f"select i.session, arg_max(task, (ts, seq)) filter (where task is not null) as task, min(ts) as started_at, max(ts) as last_active, max(ts) is not null as active from (values ('A'), ('1'), ('2')) i(session) left join {_SS} e on i.session = e.session group by i.session")
def ss_status(spark, sf_dir):
    ids = spark.createDataFrame([("A",), ("1",), ("2",)], "session string")
    return state.session_status(derived(spark, sf_dir, "session_events"), ids)


@query(f"""with recursive e as (select *, row_number() over (partition by file order by ts, seq) as k from {_SS} where action in ('lock', 'unlock')),
 f(file, k, owner, since) as (select distinct file, 0::bigint, null::varchar, null::timestamp from e union all
  select e.file, e.k, case when owner is null and action = 'lock' then session when owner = session and action = 'unlock' then null else owner end, case when owner is null and action = 'lock' then ts when owner = session and action = 'unlock' then null else since end from f join e on e.file = f.file and e.k = f.k + 1)
 select file, owner as session, since as locked_at from (select *, row_number() over (partition by file order by k desc) as last from f) where last = 1 and owner is not null""")
def ss_locks(spark, sf_dir):
    return state.locks(derived(spark, sf_dir, "session_events"))


@query(ORACLES["ss_locks"].replace("select file, owner as session, since as locked_at from", "select 'lock' as kind, owner as session, file as what, since as ts from") + f" and owner <> '1' union all select * from (select 'discovery', session, content, ts from {_SS} where action = 'discovery' and session <> '1' order by ts desc, seq desc limit 10)")
def ss_sync(spark, sf_dir):
    events = derived(spark, sf_dir, "session_events")
    return state.sync(state.locks(events), events, "1")


@query(f"select session, seq, content from {_SS} where action = 'discovery' and session <> '1' and ts >= (select max(ts) from {_SS}) - interval 3 day")
def ss_discoveries_since(spark, sf_dir):
    events = derived(spark, sf_dir, "session_events")
    since = events.agg((F.max("ts") - F.expr("interval 3 days")).alias("t")).first().t
    return state.discoveries(events, "1", since=since).select("session", "seq", "content")


@query(f"select session, arg_max(task, (ts, seq)) filter (where task is not null) as task, max(ts) as last_updated from {_SS} where ts <= (select min(ts) from {_SS}) + interval 10 day group by session")
def cx_as_of(spark, sf_dir):
    events = derived(spark, sf_dir, "session_events")
    as_of = events.agg((F.min("ts") + F.expr("interval 10 days")).alias("t")).first().t
    return state.context(events, "session", ("task",), as_of=as_of)


@query(f"select session, seq, content from {_SS} where action = 'discovery' and session <> '1' order by ts desc, seq desc limit 10")
def ss_discoveries(spark, sf_dir):
    return state.discoveries(derived(spark, sf_dir, "session_events"), "1", top=10).select("session", "seq", "content")


@query(f"select session, arg_max(task, (ts, seq)) filter (where task is not null) as task, coalesce(string_agg(task, '|' order by ts, seq), '') as steps, max(ts) as last_updated from (select *, case when action = 'discovery' then file end as f from {_SS}) group by session")
def cx_state(spark, sf_dir):
    rows = derived(spark, sf_dir, "session_events").withColumn("steps", F.col("task"))
    return state.context(rows, "session", ("task",), ("steps",)).select("session", "task", joined("steps", "|"), "last_updated")


@query(f"select session, row_number() over (partition by session order by ts desc, seq desc) as nth, ts from {_SS} where action = 'checkpoint'")
def cx_checkpoints(spark, sf_dir):
    return state.checkpoints(derived(spark, sf_dir, "session_events"), "session")


# --- checks, review, rules -----------------------------------------------------------------------------------------


@query(f"""select name, kind, nth, {strip_sql('line')} as line from (select name, kind, line, row_number() over (partition by name, kind order by i) as nth from
 (select name, line, i, case when contains(lower(line), 'error') or contains(lower(line), 'failed') then 'error' when contains(lower(line), 'warn') then 'warning' end as kind from (select name, unnest(string_split(output, chr(10))) as line, unnest(range(0, len(string_split(output, chr(10))))) as i from {oracle('outputs')})) where kind is not null) where nth <= 20""")
def vp_output(spark, sf_dir):
    return review.output_lines(derived(spark, sf_dir, "outputs"))


@query(f"select bool_and(passed) as passed, count(*) as checks, count(*) filter (where not passed) as failed, sum(duration)::bigint as duration from {oracle('check_runs')}")
def vp_result(spark, sf_dir):
    return review.pipeline_result(derived(spark, sf_dir, "check_runs"))


_CHECKS = oracle("check_rows")


@query(f"select name, passed, case when passed then 'Passed' else concat('Failed with ', errors, ' errors') end as details, name <> 'Lint' as required from {_CHECKS} union all select 'Git Status', count(*) = 0, case when count(*) = 0 then 'Working tree clean' else concat(count(*), ' uncommitted changes') end, false from {oracle('file_names')}")
def rv_checks(spark, sf_dir):
    runs = derived(spark, sf_dir, "check_rows").withColumn("errors", F.array_repeat(F.lit("e"), F.col("errors")))
    return review.check_gates(runs).unionByName(review.git_gate(derived(spark, sf_dir, "file_names").select(F.col("file").alias("path"))))


@query(f"select 0 as nth, case when bool_and(passed) then 'All checks passed' else 'Some checks failed' end as line from {_CHECKS} union all select nth::int, concat(case when passed then 'ok   ' else 'FAIL ' end, rpad(name, 12, ' '), ' ', duration, ' ms') from (select *, row_number() over (order by rpad(name, 12, ' '), duration, passed) as nth from {_CHECKS})")
def vp_summary(spark, sf_dir):
    return review.check_summary(derived(spark, sf_dir, "check_rows"))


@query(f"select name, substr(output, 1, 5000) as output from {oracle('outputs')}")
def vp_stored(spark, sf_dir):
    return review.stored_output(derived(spark, sf_dir, "outputs"))


@query(f"select count(*) as files, count(*) > 5 as force from {oracle('file_names')}")
def sf_force(spark, sf_dir):
    return review.needs_force(derived(spark, sf_dir, "file_names"))


_GATES = """s as (select count(*) filter (where severity = 'critical') as c, count(*) filter (where severity = 'high') as h from raw),
i as (select 'Security Scan' as name, c = 0 and h = 0 as passed, case when c > 0 or h > 0 then concat('Found ', c, ' critical and ', h, ' high severity issues') else 'No security issues found' end as details, true as required from s
 union all select 'Duplicate Code', true, case when n > 0 then concat('Found ', n, ' significant duplicates') else 'No significant duplicates found' end, false from (select count(*) as n from g where lines >= 10 and occurrences >= 3)
 union all select 'Active Feature', n > 0, case when n > 0 then concat(n, ' active') else 'No active feature' end, false from (select count(*) as n from ft where status = 'active'))"""
_REVIEW = _GROUPS.rstrip() + f", l as (select * from {lines_sql(_BOTH)}), raw as (select * from {_RAW}), ft as (select * from {_FT}), {_GATES} "


def gates(spark, sf_dir):
    return review.security_gate(sec_findings(spark, sf_dir)).unionByName(review.duplicate_gate(duplicates.sizes(duplicates.windows(docs(spark, sf_dir))))).unionByName(review.feature_gate(ft_all(spark, sf_dir)))


@query(_REVIEW + "select * from i")
def rv_gates(spark, sf_dir):
    return gates(spark, sf_dir)


@query(_REVIEW + "select count(*) as checks, count(*) filter (where passed) as passed, count(*) filter (where not passed and required) as failed, count(*) filter (where not passed and not required) as warnings, count(*) filter (where not passed and required) = 0 as ready, case when count(*) filter (where not passed) = 0 then 'All checks passed. Ready to complete' when count(*) filter (where not passed and required) = 0 then concat('Ready to complete. ', count(*) filter (where not passed), ' warning(s) to review') else concat('Not ready. Fix required issues: ', string_agg(name, ', ' order by name) filter (where not passed and required)) end as recommendation from i")
def rv_report(spark, sf_dir):
    return review.review(gates(spark, sf_dir))


@query(_WITH + f", a as (select count(*) filter (where severity = 'critical') as critical, count(*) as findings from raw) select case when critical > 0 then 'error' when findings > 0 then 'warn' else 'ok' end as status, critical, findings, (select count(*) from {_FN}) as functions, (select min(name) from {_FT} where status = 'active') as active_feature, critical = 0 as can_finish from a")
def vl_validate(spark, sf_dir):
    return review.validate(sec_findings(spark, sf_dir), fn_all(spark, sf_dir), ft_all(spark, sf_dir))


def _types_sql() -> str:
    rows = ", ".join(f"({k}, {quote(n)}, {p}, {quote(m.lstrip('*'))}, {str(m.startswith('*')).lower()}, {'null' if c is None else quote(c)})" for k, (n, p, marks, c) in enumerate(P.PROJECT_TYPES) for m in marks)
    return f"""with r(rule_ord, type, priority, mark, suffix, content) as (values {rows}), n as (select regexp_extract(file, '([^/]*)$', 1) as base, text from {oracle('file_names')} where len(string_split(file, '/')) <= 3),
 m as (select distinct rule_ord, type, priority from n join r on (case when suffix then ends_with(base, mark) else base = mark end) and (content is null or contains(text, content)))
 select rule_ord, type, priority, row_number() over (order by priority desc, rule_ord) = 1 as chosen from m"""


@query(_types_sql())
def pd_detect(spark, sf_dir):
    return review.project_types(derived(spark, sf_dir, "file_names"))


_REASON = " ".join(f"when contains(file, {quote(p)}) then {quote('Protected path: ' + p)}" for p in P.PROTECTED)


@query(f"select file, reason is null as safe, reason from (select file, case {_REASON} when starts_with(file, 'src/') or contains(file, '/src/') then 'Own source code' end as reason from {oracle('file_names')})")
def sf_safe(spark, sf_dir):
    return review.safe_to_modify(derived(spark, sf_dir, "file_names"), own_project=True)


@query(f"select step, command from (select step, arg_max(command, level) as command from (select 'build' as step, 'go build ./...' as command, 30 as level union all select 'test', 'go test ./...', 30 union all select 'lint', 'golangci-lint run', 30 union all select 'typecheck', 'go vet ./...', 30) where exists (select 1 from {oracle('file_names')} where file like '%go.mod') group by step)")
def vp_commands(spark, sf_dir):
    return review.commands(derived(spark, sf_dir, "file_names"))
