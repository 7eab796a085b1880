"""A micro-corpus of a few files: what each operator must find follows by hand from its rule in SURVEY 2, and for
duplicates and similarity from a brute-force version here."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltbed.operators import duplicates, imports, indexes, refactor, secrets, similarity
from siltbed.sources.corpus import lines

CORPUS = {
    "src/a.ts": "import { b } from './b';\nimport { m } from './missing.js';\nexport async function alpha(x: number, y: string): Promise<number> {\n  return b(x) + 4242;\n}\nconst beta = async (q: string): string => q;\n",
    "src/b.ts": "import { a } from './a';\nimport { m } from './missing.js';\nimport express from 'express';\nexport const b = (n) => n * 37;\nx123 = y + 3.14159;\n",
    "p.py": "async def fetch(url: str, n=3) -> dict:\n    return url\ndef plain(a, b):\n    password = 'hunter2hunter2'\n    return 99\n# BUG: off by one\n",
    "fw.c": "#define LED_PIN 13\nvoid setup(void) {\n  pinMode(LED_PIN, OUTPUT);\n  HAL_GPIO_WritePin(GPIOA, GPIO_PIN_5, 1);\n  Serial1.begin(9600);\n}\n",
    "r.js": "app.get('/users', async function listUsers(req) {\nrouter.post(\"/users\",\n  auth,\n  createUser);\n",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(CORPUS.items()), "file string, text string")


def test_secrets_and_fix_plan(corpus):
    found = secrets.findings(lines(corpus)).collect()
    assert [(r.pattern, r.severity, r.file, r.line, r.match) for r in found] == [("Hardcoded Password", "high", "p.py", 4, "pass...er2'")]
    plan = secrets.fix_plan(secrets.raw_findings(lines(corpus))).collect()[0]
    assert (plan.original, plan.replacement) == ("password = 'hunter2hunter2'", "os.environ.get('HARDCODED_PASSWORD')")
    assert plan.placeholder == "your-password-here"


def test_functions(corpus):
    rows = {(r.file, r.line, r.name): r for r in indexes.functions(lines(corpus)).collect()}
    assert ("fw.c", 2, "setup") in rows and ("p.py", 3, "plain") in rows and ("src/a.ts", 6, "beta") in rows and ("src/b.ts", 4, "b") in rows
    fetch = rows["p.py", 1, "fetch"]
    assert fetch.return_type == "dict" and [(p.name, p.type) for p in fetch.parameters] == [("url", "str"), ("n=3", None)]
    assert rows["src/a.ts", 3, "alpha"].return_type == "Promise<number>"
    assert sum(k[2] == "alpha" for k in rows) == 1


def test_routes(corpus):
    got = {(r.method, r.path, r.handler, r.file, r.line) for r in indexes.routes(lines(corpus)).collect()}
    assert got == {("GET", "/users", "listUsers", "r.js", 1), ("POST", "/users", "anonymous", "r.js", 2)}


def test_hardware(corpus):
    c = lines(corpus).where("file = 'fw.c'")
    got = {(r.type, r.name, tuple(r.pins), r.line) for r in indexes.peripherals(c).collect()}
    assert ("GPIO", "GPIO_PIN_5", ("GPIOA", "GPIO_PIN_5"), 4) in got and ("UART", "Serial1", (), 5) in got
    assert [(r.name, r.value) for r in indexes.defines(c).collect()] == [("LED_PIN", "13")]


def test_imports(corpus):
    found = imports.edges(corpus)
    got = {(r.src, r.spec, r.dst, r.external) for r in found.collect()}
    assert ("src/a.ts", "./b", "src/b.ts", False) in got and ("src/b.ts", "./a", "src/a.ts", False) in got
    assert ("src/b.ts", "express", None, True) in got and ("src/a.ts", "./missing.js", "src/missing.js", False) in got
    assert [(r.length, r.cycle) for r in imports.cycles(found.where("not external")).collect()] == [(2, "src/a.ts>src/b.ts")]
    roles = {r.file: r.role for r in imports.classify(found, corpus).collect()}
    assert roles["p.py"] == "orphan" and "src/a.ts" not in roles


def _clean(text):
    out = [re.sub(r"\s+", " ", x.strip()) for x in text.split("\n")]
    return ["" if x.startswith(("//", "#", "*")) else x for x in out]


def _grams(lines):
    toks = re.findall(r"[a-z_][a-z0-9_]*|[{}()\[\];,=<>!+\-*/&|^%]", " ".join(x for x in lines if x).lower())
    return {tuple(toks[k : k + n]) for n in (1, 2, 3) for k in range(len(toks) - n + 1)}


def test_similarity(corpus):
    snippet = "def plain(a, b):\n    password = 'x'\n    return 99"
    want = _grams(_clean(snippet))
    rows = similarity.similar(corpus, snippet).collect()
    scores = {}
    for file, text in CORPUS.items():
        lines_ = _clean(text)
        for k in range(len(lines_) - 2):
            own = _grams(lines_[k : k + 3])
            score = 100 * len(own & want) / len(own | want)
            if score >= 60:
                scores[file, k + 1, k + 3] = int(score + 0.5)
    best = sorted(scores, key=lambda w: (-scores[w], w))
    kept = [w for k, w in enumerate(best) if not any(v[0] == w[0] and v[1] <= w[2] and w[1] <= v[2] for v in best[:k])]
    scores = {w: scores[w] for w in kept}
    assert scores and {(r.file, r.start_line, r.end_line): r.similarity for r in rows} == scores


def _brute_groups(files):
    """hash -> (most lines, disjoint occurrences), window by window."""
    found = defaultdict(list)
    for file, text in files:
        lines_ = _clean(text)
        for n in range(5, min(50, len(lines_)) + 1):
            for k in range(len(lines_) - n + 1):
                content = " ".join(x for x in lines_[k : k + n] if x)
                if len(content) >= 50 and len(re.sub("[^a-zA-Z]", "", content)) >= 0.3 * len(content) and not re.match(r"(?i)(from|import|include|require|using)\s", content):
                    found[hashlib.md5(content.encode()).hexdigest()[:12]].append((file, k + 1, k + n))
    out = {}
    for h, spans in found.items():
        kept = []
        for s in sorted(spans):
            if not kept or s[0] != kept[-1][0] or s[1] > kept[-1][2]:
                kept.append(s)
        if len(kept) > 1:
            out[h] = (max(e - s + 1 for _, s, e in kept), kept)
    return out


def test_duplicates(spark):
    block = "\n".join(f"  total{i} = compute(total{i}, factor{i});" for i in range(6))
    long = "\n".join(f"value{k % 37} = load(table{k % 37}) // {k}" if k % 5 else "" for k in range(120))
    files = [("x.js", f"start();\n{block}\nend();\n"), ("y.js", f"{block}\n\n{block}\n"), ("z.js", long), ("short.js", "a\nb"), ("none.js", "")]
    found = duplicates.windows(spark.createDataFrame(files + [("null.js", None)], "file string, text string"))
    got = {r.hash: (r.lines, [(o.file, o.start_line, o.end_line) for o in r.occurrences]) for r in duplicates.groups(found).collect()}
    assert got == _brute_groups(files) and len(got) == 4
    assert {r.hash: (r.lines, r.n) for r in duplicates.sizes(found).collect()} == {h: (n, len(o)) for h, (n, o) in got.items()}


def test_magic_numbers(corpus):
    got = {(r.file, r.line, r.value) for r in refactor.magic_numbers(lines(corpus)).collect()}
    assert ("src/a.ts", 4, "4242") in got and ("src/b.ts", 5, "14159") in got and ("src/b.ts", 5, "23") in got


def test_long_python_function(spark):
    body = "def long():\n" + "    x = 1\n" * 60 + "y = 2\n" + "def short():\n    pass\n"
    c = spark.createDataFrame([("m.py", body)], "file string, text string")
    assert [(r.name, r.start_line, r.lines) for r in refactor.long_functions(c).collect()] == [("long", 1, 60)]


def test_names(spark):
    df = spark.createDataFrame([("total = price * 4242", "4242"), ("x = 12", "12")], "c string, v string")
    assert [r[0] for r in df.select(refactor.constant_name(F.col("v"), F.col("c"))).collect()] == ["TOTAL_PRICE_VALUE", "MAGIC_12"]
    code = spark.createDataFrame([("if (!x) y",), ("doit; saveAll()",), ("zzz",)], "c string")
    assert [r[0] for r in code.select(refactor.function_name(F.col("c"))).collect()] == ["checkNegativeCondition", "saveAll", "extractedBlock"]
