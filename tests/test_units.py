from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from siltbed.functions import text
from siltbed.operators import imports, knowledge, review, state
from siltbed.sources import corpus
from siltbed.streaming import streams


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (text.mask, "12345678", "***"),
        (text.mask, "123456789", "1234...6789"),
        (text.strip, "\t a b \n", "a b"),
        (text.squeeze, " a \t\n b ", "a b"),
        (text.env_name, "AWS Access Key!", "AWS_ACCESS_KEY"),
        (text.extension, "a/b.test.TS", "ts"),
        (text.extension, ".env", ""),
        (text.basename, "a/b/c.py", "c.py"),
        (text.normalize_path, "./a/../b//c/./d", "b/c/d"),
        (lambda x: text.clip(x, 5), "abcdef", "ab..."),
        (lambda x: text.clip(x, 6), "abcdef", "abcdef"),
        (lambda x: F.array_join(text.gram_set(x), "|"), "a = b", "a|=|b|a =|= b|a = b"),
        (lambda x: F.array_join(text.gram_set(x), "|"), "", ""),
    ],
)
def test_scalars(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_jaccard_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    rows = df.select(text.jaccard_percent(F.col("a"), F.col("b")).alias("x"), text.jaccard_percent(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] == pytest.approx([100 / 3, 0, 100])


def test_files_and_lines(spark):
    with tempfile.TemporaryDirectory() as d:
        (p := __import__("pathlib").Path(d, "src")).mkdir()
        (p / "a.py").write_text("x = 1\n\n  \ny\n")
        (p / "b.md").write_text("no")
        files = corpus.read_files(spark, d)
        assert {r.file for r in files.collect()} == {"src/a.py", "src/b.md"}
        rows = corpus.lines(corpus.scannable(files)).collect()
        assert [(r.file, r.line_no, r.line) for r in rows] == [("src/a.py", 1, "x = 1"), ("src/a.py", 3, "  "), ("src/a.py", 4, "y")]


def test_locks(spark):
    rows = [(1, 1, "A", "f", "lock"), (2, 2, "B", "f", "lock"), (3, 3, "B", "f", "unlock"), (4, 4, "A", "f", "unlock"), (5, 5, "B", "f", "lock"), (6, 6, "A", "g", "lock"), (7, 7, "A", "g", "lock")]
    e = spark.createDataFrame(rows, "ts long, seq long, session string, file string, action string")
    assert {(r.file, r.session, r.locked_at) for r in state.locks(e).collect()} == {("f", "B", 5), ("g", "A", 6)}


def test_lock_stream_agrees_with_batch(spark, tmp_path):
    rows = [(k, k, "AB"[k * 7 % 3 % 2], f"f{k % 3}", "lock" if k % 2 else "unlock") for k in range(60)]
    e = spark.createDataFrame(rows, "ts long, seq long, session string, file string, action string")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.lock_stream(stream).writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("locks").count() == 60
    assert spark.table("locks").where("granted and action = 'lock'").count() > 0


def test_event_windows_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(k, k % 3, "ab"[k % 2], float(k)) for k in range(100)], "t long, user_id long, event_type string, value double")
    e = e.select(F.timestamp_seconds("t" if False else F.col("t") * 120).alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in streams.event_counts(spark.read.parquet(str(tmp_path / "e"))).collect()}
    q = streams.event_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == batch


def test_knowledge_append_skips_known_ids(spark):
    notes = spark.createDataFrame([("n", "x\n## 2024-01-01\nWe cache the api state\n## d\nshort", "f", [])], "file string, text string, feature string, files array<string>")
    new = knowledge.decisions(notes)
    row = new.collect()
    assert len(row) == 1 and row[0].tags == ["api", "cache", "state"] and row[0].title == "Decision: We cache the api state"
    assert knowledge.append(new, new.union(new)).count() == 0


def test_rules(spark):
    files = spark.createDataFrame([("package.json", '{"react": 1}'), ("a/b/c/d/x.ioc", ""), ("x.csproj", "")], "file string, text string")
    rows = {r.type: r.chosen for r in review.project_types(files).collect()}
    assert rows["dotnet-wpf"] and not rows["web-react"] and "embedded-stm32" not in rows
    safe = {r.file: r.safe for r in review.safe_to_modify(spark.createDataFrame([("dist/a.js",), ("lib/a.js",)], "file string")).collect()}
    assert safe == {"dist/a.js": False, "lib/a.js": True}
    cmds = {r.step: r.command for r in review.commands(files).collect()}
    assert cmds == {"build": "dotnet build", "test": "dotnet test"}


def test_entry_module_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def ring(name, n):
    return [(f"{name}{k:02d}", f"{name}{(k + 1) % n:02d}") for k in range(n)]


def test_long_cycles_are_not_lost(spark):
    pairs = ring("a", 12) + ring("b", 9) + ring("c", 3) + ring("d", 8) + [("e", "e"), ("tail", "a03"), ("b01", "end"), ("c00", "d00")]
    pairs += ring("f", 11) + [("f02", "f01")]  # a short cycle and a long one in one component
    pairs += [("g", "h"), ("h", "i"), (None, "g")]
    got = imports.cycles(spark.createDataFrame(pairs, "src string, dst string")).collect()
    want = [[a for a, _ in ring(x, n)] for x, n in (("a", 12), ("b", 9), ("c", 3), ("d", 8), ("f", 11))] + [["e"], ["f01", "f02"]]
    assert sorted((r.length, r.cycle) for r in got) == sorted((len(p), ">".join(p)) for p in want)


def test_long_cycles_cover_every_edge_of_a_cycle():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(2, 9)
        pairs = {(str(r.randrange(n)), str(r.randrange(n))) for _ in range(r.randrange(1, 2 * n))}
        reach = {(a, b) for a, b in pairs}
        for k in map(str, range(n)):
            reach |= {(a, b) for a in map(str, range(n)) for b in map(str, range(n)) if (a, k) in reach and (k, b) in reach}
        found = imports.long_cycles(list(pairs), 1)
        steps = {e for p in found for e in zip(p, p[1:] + p[:1])}
        assert all(len(set(p)) == len(p) > 1 and p[0] == min(p) for p in found) and len(set(map(tuple, found))) == len(found)
        assert steps == {(a, b) for a, b in pairs if a != b and (b, a) in reach}


def test_secret_and_session_streams_equal_batch(spark, tmp_path):
    corpus = spark.createDataFrame([(f"f{k}.py", f"x = 1\npassword = 'hunter{k}hunter{k}'\n") for k in range(8)], "file string, text string")
    corpus.repartition(2).write.parquet(str(tmp_path / "files"))
    events = spark.createDataFrame([(k * 10 + (k // 5) * 3600, k % 2) for k in range(40)], "t long, user_id long").select(F.timestamp_seconds("t").alias("ts"), "user_id")
    events.write.parquet(str(tmp_path / "events"))
    for name, fold, schema, mode in (("files", streams.secret_stream, corpus.schema, "append"), ("events", streams.event_sessions, events.schema, "complete")):
        batch = sorted(map(tuple, fold(spark.read.parquet(str(tmp_path / name))).collect()))
        q = fold(spark.readStream.schema(schema).parquet(str(tmp_path / name))).writeStream.outputMode(mode).format("memory").queryName(f"of_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"of_{name}").collect())) == batch and batch


def test_windows_are_shuffled_without_their_texts(spark):
    """What is shuffled of a window is its mark and place; previews come from the text, and the largest groups are the first of all."""
    import hashlib
    import re
    from collections import defaultdict

    from siltbed.operators import duplicates

    block = [f"value_{k} = compute(alpha, beta)  é " for k in range(7)]
    texts = {"a.py": ["# top", *block, "", "tail"], "b.py": ["x", *block, "", ""], "c.py": ["from x import y", *block[:6], "import z"] * 2, "d.py": None, "e.py": [""] * 60}
    corpus = spark.createDataFrame([(f, None if t is None else "\n".join(t)) for f, t in texts.items()], "file string, text string")
    found = duplicates.windows(corpus)
    assert found.columns == ["mark", "file", "start", "lines"]
    want = defaultdict(list)
    for f, t in texts.items():
        clean = ["" if x.startswith(("#", "*", "//")) else re.sub("[ \t\r\f\x0b]+", " ", x).strip(" ") for x in t or []]
        for s in range(len(clean)):
            for e in range(s + 5, min(len(clean), s + 50) + 1):
                c = " ".join(x for x in clean[s:e] if x)
                if len(c) >= 50 and len(re.sub("[^a-zA-Z]", "", c)) >= 0.3 * len(c) and not re.match("(?i)(from|import|include|require|using) ", c):
                    want[hashlib.md5(c.encode()).hexdigest()[:12]].append((f, s + 1, e, c[:100] + "..." * (len(c) > 100)))
    want = {h: w for h, w in want.items() if len(w) > 1}
    counts = {r.hash: (r.occurrences, r.files, r.lines) for r in duplicates.counts(found).collect()}
    assert counts == {h: (len(w), len({x[0] for x in w}), max(e - s + 1 for _, s, e, _ in w)) for h, w in want.items()}
    groups = duplicates.groups(found, corpus)
    got = groups.collect()
    assert got and all(r.preview == want[r.hash][0][3] for r in got)
    assert duplicates.largest(found, corpus, 3).collect() == duplicates.ranked(groups, 3).collect()
