"""Corpora of code derived from the shared tables by SQL that both engines run, and SQL pieces of the oracles."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

#: name -> (table, SQL over it); FROM {t}
DERIVED: dict[str, tuple[str, str]] = {
    "python_lines": ("part", "select concat('mod', cast(p_partkey % 97 as varchar(9)), '.py') as file, p_partkey as line_no, concat('def ', replace(lower(p_name), ' ', '_'), '(size: int, brand) -> ', replace(p_type, ' ', '_'), ':') as line from {t}"),
    "scripts": ("part", "select concat('src/m', cast(k as varchar(9)), '.ts') as file, concat('import { a } from ''./m', cast((k * k + 1) % 97 as varchar(9)), ''';', chr(10), 'import b from ''./gone', cast(k % 5 as varchar(9)), '.js'';', chr(10), 'const c = require(''lib', cast(k % 7 as varchar(9)), ''');') as text from (select distinct p_partkey % 97 as k from {t}) x"),
    "graph": ("part", "select distinct cast(p_partkey % 97 as varchar(9)) as src, cast(((p_partkey % 97) * (p_partkey % 97) + 1) % 97 as varchar(9)) as dst from {t}"),
    "route_lines": (
        "pages",
        "select concat('routes/r', cast(page_id % 40 as varchar(9)), '.js') as file, page_id as line_no, concat(case when page_id % 4 = 0 then 'app.get(''' when page_id % 4 = 1 then 'router.post(\"' when page_id % 4 = 2 then '@Put(\"' else 'const h' end, "
        "case when page_id % 4 = 3 then concat(cast(page_id as varchar(19)), ' = 1;') else concat(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), case when page_id % 4 = 0 then ''', async function f' when page_id % 4 = 1 then '\", ' else '\")' end, cast(page_id as varchar(19))) end) as line from {t}",
    ),
    "board_lines": (
        "events",
        "select concat('fw', cast(user_id % 50 as varchar(9)), '.c') as file, event_id as line_no, case when event_id % 5 = 0 then concat('HAL_GPIO_WritePin(GPIOA, GPIO_PIN_', cast(event_id % 16 as varchar(9)), ', 1);') when event_id % 5 = 1 then concat('#define LED_PIN ', cast(event_id % 40 as varchar(9))) when event_id % 5 = 2 then concat('Serial', cast(event_id % 3 as varchar(9)), '.begin(9600);') when event_id % 5 = 3 then 'pinMode(LED, OUTPUT);' else concat('const int SPEED = ', cast(event_id % 7 as varchar(9))) end as line from {t}",
    ),
    "pin_lines": ("events", "select 'board.ioc' as file, event_id as line_no, concat('PA', cast(event_id % 16 as varchar(9)), case when event_id % 2 = 0 then '.Signal=' else '.Label=' end, case when event_id % 3 = 0 then 'SPI1_SCK' when event_id % 3 = 1 then 'USART2_TX' else 'X' end) as line from {t}"),
    "sdk_lines": ("events", "select 'sdkconfig' as file, event_id as line_no, concat(case when event_id % 4 = 0 then '# ' else '' end, 'CONFIG_', case when event_id % 3 = 0 then 'LED_PIN' else 'SPEED' end, '=', cast(event_id % 50 as varchar(9))) as line from {t}"),
    "code_lines": ("lineitem", "select concat('f', cast(l_orderkey % 200 as varchar(9)), case when l_orderkey % 2 = 0 then '.py' else '.go' end) as file, l_orderkey * 10 + l_linenumber as line_no, concat(case when l_linenumber % 5 = 0 then '# ' else '  total price ' end, '= x * ', cast(l_partkey as varchar(19)), ' + ', cast(cast(l_quantity as int) as varchar(19)), ';') as line from {t}"),
    "long_corpus": ("nation", "select concat('long', cast(n_nationkey as varchar(9)), '.js') as file, concat('function start', cast(n_nationkey as varchar(9)), '() {', repeat(concat(chr(10), '  step();'), cast(n_nationkey * 8 as int)), chr(10), 'const next = () => {', repeat(concat(chr(10), '  more();'), cast(n_nationkey * 4 as int))) as text from {t}"),
    "entries": ("conversations", "select concat(cast(conv_id as varchar(19)), '-', cast(turn as varchar(19))) as id, case when role = 'user' then 'bug' when role = 'assistant' then 'solution' else 'decision' end as type, substring(text, 1, 40) as title, text as content from {t}"),
    "notes": ("documents", "select concat('n', cast(doc_id as varchar(19))) as feature, concat('intro', chr(10), '## 2024-01-0', cast(doc_id % 9 + 1 as varchar(9)), chr(10), text) as text from {t}"),
    "marked_lines": ("documents", "select concat('k', cast(doc_id as varchar(19)), '.py') as file, n_chars as line_no, concat(case when doc_id % 3 = 0 then '# BUG: ' when doc_id % 3 = 1 then 'x = 1 // FIX: ' else '' end, substring(replace(text, chr(10), ' '), 1, 90)) as line from {t}"),
    "session_events": ("events", "select ts, event_id as seq, cast(user_id % 40 as varchar(9)) as session, concat('file', cast(event_id % 60 as varchar(9))) as file, case when event_type = 'click' then 'lock' when event_type = 'view' then 'unlock' when event_type = 'error' then 'checkpoint' else 'discovery' end as action, case when event_type = 'purchase' then props end as task, props as content from {t}"),
    "feature_events": ("orders", "select o_orderdate as ts, o_orderkey as seq, concat('feature', cast(o_custkey % 300 as varchar(9))) as name, case when o_orderkey % 5 = 0 then 'start' when o_orderkey % 5 = 4 then 'complete' else 'decide' end as action, o_orderpriority as text from {t}"),
    "check_runs": ("orders", "select concat('check', cast(o_orderkey % 30 as varchar(9))) as name, o_orderkey % 7 <> 0 as passed, o_orderkey % 1000 as duration from {t}"),
    "outputs": ("documents", "select concat('run', cast(doc_id as varchar(19))) as name, concat(case when doc_id % 2 = 0 then 'Error: first' else 'warn: x' end, chr(10), text, chr(10), 'build failed ', chr(10), 'Warning later') as output from {t}"),
    "file_names": ("part", "select concat(case when p_partkey % 6 = 0 then 'node_modules/' when p_partkey % 6 = 1 then 'src/' when p_partkey % 6 = 2 then 'a/b/c/' else '' end, case when p_partkey % 5 = 0 then 'package.json' when p_partkey % 5 = 1 then 'go.mod' when p_partkey % 5 = 2 then 'x.ino' when p_partkey % 5 = 3 then '.env' else concat('f', cast(p_partkey as varchar(19)), '.py') end) as file, case when p_partkey % 10 = 0 then '{\"react\": 1}' else '' end as text from {t}"),
    "function_lines": (
        "part",
        "select concat('f', cast(p_partkey % 7 as varchar(9)), case when p_partkey % 5 = 0 then '.go' when p_partkey % 5 = 1 then '.rs' when p_partkey % 5 = 2 then '.cs' when p_partkey % 5 = 3 then '.c' else '.ts' end) as file, p_partkey as line_no, "
        "case when p_partkey % 5 = 0 then concat('func (s *S) Fn', cast(p_partkey as varchar(9)), '(size int) error {') when p_partkey % 5 = 1 then concat('pub fn fn_', cast(p_partkey as varchar(9)), '(size: i32) -> bool {') "
        "when p_partkey % 5 = 2 then concat('public static int Fn', cast(p_partkey as varchar(9)), '(int size)') when p_partkey % 5 = 3 then concat('int fn_', cast(p_partkey as varchar(9)), '(int size) {') else concat('export function fn', cast(p_partkey as varchar(9)), '(size: number): string {') end as line from {t}",
    ),
    "import_files": (
        "part",
        "select concat(case when k % 4 = 0 then 'pkg/m' else 'm' end, cast(k as varchar(9)), case when k % 4 = 0 then '.py' when k % 4 = 1 then '.go' when k % 4 = 2 then '.rs' else '.cs' end) as file, k, "
        "case when k % 4 = 0 then concat('import lib.a', chr(10), 'from .m', cast((k * 3) % 97 as varchar(9)), ' import x', chr(10), 'from ..up import y') when k % 4 = 1 then concat('import \"fmt', cast(k as varchar(9)), '\"', chr(10), 'import x \"example.com/y\"') "
        "when k % 4 = 2 then concat('use crate::m', cast(k as varchar(9)), ';', chr(10), 'mod sub;', chr(10), 'use std::io;') else concat('using System.Text;', chr(10), 'using App.M', cast(k as varchar(9)), ';') end as text from (select distinct p_partkey % 97 as k from {t}) x",
    ),
    "web_lines": (
        "pages",
        "select concat('w', cast(page_id as varchar(19)), case when page_id % 6 < 3 then '.py' when page_id % 6 < 5 then '.go' else '.cs' end) as file, page_id as line_no, case when page_id % 6 = 0 then concat('@app.route(\"/p', cast(page_id as varchar(19)), '\")') "
        "when page_id % 6 = 1 then concat('@app.get(\"/p', cast(page_id as varchar(19)), '\")') when page_id % 6 = 2 then concat('@router.post(\"/p', cast(page_id as varchar(19)), '\")') when page_id % 6 = 3 then concat('r.HandleFunc(\"/p', cast(page_id as varchar(19)), '\", h)') "
        "when page_id % 6 = 4 then concat('r.DELETE(\"/p', cast(page_id as varchar(19)), '\", h)') else concat('[HttpPut(\"/p', cast(page_id as varchar(19)), '\")]') end as line from {t}",
    ),
    "manifests": ("nation", "select concat('d', cast(n_nationkey as varchar(9)), case when n_nationkey % 3 = 0 then '/package.json' when n_nationkey % 3 = 1 then '/requirements.txt' else '/x.csproj' end) as file, case when n_nationkey % 3 = 0 then '{\"express\": 1}' when n_nationkey % 3 = 1 then 'Flask==2' else '' end as text from {t}"),
    "check_rows": ("nation", "select case when n_nationkey % 3 = 0 then 'Build' when n_nationkey % 3 = 1 then 'Tests' else 'Lint' end as name, n_nationkey % 4 <> 0 as passed, n_nationkey as errors, n_nationkey * 10 as duration from {t}"),
    "items": ("conversations", "select case when turn % 2 = 0 then 'blocker' else 'note' end as kind, text, concat('f', cast(conv_id as varchar(19))) as feature from {t}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = DERIVED[name]
    view = f"derived_{source}_{zlib.crc32(sf_dir.encode()):08x}"
    table(spark, sf_dir, source).createOrReplaceTempView(view)
    return spark.sql(sql.replace("{t}", view))


def oracle(name: str) -> str:
    source, sql = DERIVED[name]
    return "(" + sql.replace("{t}", source) + ")"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_sql(source: str) -> str:
    """(file, line_no, line) from (file, text)."""
    return f"(select file, i::bigint as line_no, line from (select file, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from {source} where text is not null) where line <> '')"


def corpus_sql(table_name: str, key: str, text: str = "text", suffix: str = "") -> str:
    return f"(select concat({key}::varchar, {quote(suffix)}) as file, {text} as text from {table_name})"


SPACE = "[ \\t\\n\\v\\f\\r]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(x)}, '{SPACE}+', ' ', 'g')"
