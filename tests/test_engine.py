from __future__ import annotations

import pytest

from siltbed.functions import patterns as P
from siltbed.plans.engine import Engine
from siltbed.sources import tables

FILES = [("src/a.ts", "import './b';\nexport function alpha(x: number) {\n  return 4242;\n}\n"), ("src/b.ts", "const key = 'zz-12345';\n"), ("package.json", '{"react": 1, "scripts": {"test": "x"}}'), ("node_modules/x.ts", "function no() {}\n")]


@pytest.fixture(scope="module")
def engine(spark):
    own = P.Secret("Own Key", "key", "critical", "zz-[0-9]{5}", "-")
    return Engine(spark.createDataFrame(FILES, "file string, text string"), (own,))


def test_tools(spark, engine):
    assert [r.name for r in engine.scan().collect()] == ["alpha"]
    assert [(r.pattern, r.file) for r in engine.security().collect()] == [("Own Key", "src/b.ts")]
    assert engine.project_type().first().type == "web-react"
    assert {r.step for r in engine.pipeline_commands().collect()} == {"test"}
    deps = engine.dependencies()
    assert [(r.src, r.dst) for r in deps["edges"].collect()] == [("src/a.ts", "src/b.ts")] and deps["cycles"].count() == 0
    assert [r.file for r in engine.search("A.TS", "file").collect()] == ["src/a.ts"]
    events = spark.sql("select timestamp'2024-01-01' as ts, 1L as seq, 'f' as name, 'start' as action, cast(null as string) as text")
    row = engine.validate(events).first()
    assert (row.status, row.functions, row.active_feature, row.can_finish) == ("error", 1, "f", False)
    with pytest.raises(ValueError):
        engine.search("x", "nothing")


def test_refactor_has_no_caps(spark):
    body = "".join(f"function f{k}() {{\n" + "  step();\n" * 60 + "}\n" for k in range(25)) + "".join(f"total = price * {4200 + k};\n" for k in range(15))
    out = Engine(spark.createDataFrame([("src/long.js", body)], "file string, text string")).refactor()
    assert out["stats"].first().long_functions == 25
    assert out["suggestions"].where("type = 'reduce-complexity'").count() == 25
    assert out["constant_fixes"].count() == 15


def test_fixes_hold_the_whole_block(spark):
    block = "\n".join(f"  let total{i} = compute(total{i}, factor{i}, offset{i});" for i in range(6))
    corpus = spark.createDataFrame([("x.ts", f"start();\n{block}\nend();\n"), ("y.ts", f"{block}\n"), ("z.test.ts", "let a = 4242;\n"), ("z.ts", "let a = 4343;\n")], "file string, text string")
    out = Engine(corpus).refactor()
    fix = next(r for r in out["duplicate_fixes"].collect() if len(r.new_code.split("\n")) == 9)
    assert fix.new_code == "function extractedBlock(): void {\n" + "\n".join("  " + x for x in block.split("\n")) + "\n}\n" and fix.call == "extractedBlock();"
    assert {r.value for r in out["constant_fixes"].collect()} == {"4343"}
    assert out["summary"].where("type = 'remove-duplicate'").first().n >= 1


def test_frameworks_and_hardware_of_the_corpus(spark):
    files = [("requirements.txt", "Flask==2\n"), ("app.py", "@app.route('/x')\ndef show():\n    pass\n"), ("Drivers/hal.c", "SPI1 = 1;\n"), ("src/main.c", "SPI2 = 1;\n"), ("notes.md", "SPI3\n")]
    engine = Engine(spark.createDataFrame(files, "file string, text string"))
    assert [(r.method, r.path, r.handler) for r in engine.routes().collect()] == [("GET", "/x", "show")]
    assert {r.name for r in engine.hardware()["peripherals"].collect()} == {"SPI2"}


def test_summary_of_dependencies(spark):
    ring = [(f"r{k}.ts", f"import './r{(k + 1) % 3}';\n") for k in range(3)] + [("alone.ts", "x();\n")]
    out = Engine(spark.createDataFrame(ring, "file string, text string")).dependencies()
    got = {(r.section, r.nth): (r.item, r.n) for r in out["summary"].collect()}
    assert got["cycle", 1] == ("r0.ts>r1.ts>r2.ts", 3) and got["orphan", 1] == ("alone.ts", 0) and got["total", 2] == ("imports", 3)


def test_features_sessions_and_locks(spark, engine):
    log = spark.createDataFrame([], "ts timestamp, seq long, name string, action string, text string")
    out = engine.start("alpha", log, "2024-01-01 00:00:00", 1)
    log = log.union(out["event"])
    assert log.count() == 1 and out["hardware"].count() == 0
    again = engine.start("beta", log, "2024-01-02 00:00:00", 2)
    assert again["event"].count() == 0 and again["active"].first().name == "alpha"
    done = engine.done(log, "2024-01-03 00:00:00", 3)
    assert (done["verdict"].first().ok, done["event"].count()) == (False, 0)  # its corpus holds a critical secret
    clean = Engine(engine.corpus.where("file <> 'src/b.ts'")).done(log, "2024-01-03 00:00:00", 3)
    assert log.union(clean["event"]).orderBy("seq").collect()[-1].action == "complete"

    events = spark.createDataFrame([], "ts timestamp, seq long, session string, file string, action string, task string, content string")
    events = events.union(engine.session_start(events, "A", "2024-01-01 00:00:00", 1)).union(engine.session_start(events, "B", "2024-01-01 00:00:01", 2))
    events = events.union(engine.lock(events, "A", "f.ts", "2024-01-01 00:00:02", 3)["event"])
    refused = engine.lock(events, "B", "f.ts", "2024-01-01 00:00:03", 4)
    assert tuple(refused["verdict"].first()) == ("f.ts", "A", False) and refused["event"].count() == 0
    assert engine.unlock(events, "B", "f.ts", "2024-01-01 00:00:03", 4)["event"].count() == 0
    assert engine.unlock(events, "A", "f.ts", "2024-01-01 00:00:03", 4)["event"].count() == 1
    assert engine.session_switch(events, "A").first().locked_files == 1
    assert {r.session for r in engine.session_status(events)["sessions"].collect()} == {"A", "B"}
    assert [(r.kind, r.what) for r in engine.session_sync(events, "B").collect()] == [("lock", "f.ts")]
    events = events.union(engine.checkpoint(events, "A", "2024-01-01 00:00:05", 5))
    assert engine.resume(events, "session", ("task",)).count() == 1
    assert engine.resume(events, "session", ("task",), checkpoint="2024-01-01 00:00:00").count() == 1
    with pytest.raises(ValueError):
        engine.session_start(events, "D", "2024-01-01", 9)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert tables.read_or_empty(spark, path, "id string, v int").count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    assert tables.append_new(rows, path).count() == 2
    assert tables.append_new(rows.unionByName(spark.createDataFrame([("c", 3)], "id string, v int")), path).count() == 3
    tables.write_index(rows.limit(1), path + "2")
    tables.write_index(rows, path + "2")
    assert spark.read.parquet(path + "2").count() == 3
