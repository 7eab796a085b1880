"""One object over a corpus with a method for each tool, composed of the operators; nothing runs until a result is read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions import patterns as P
from siltbed.operators import duplicates, imports, indexes, knowledge, refactor, review, secrets, similarity, state
from siltbed.sources import corpus as sources


class Engine:
    """``corpus``: (file, text). Parameters have the defaults of the operators. Limits of work are off unless given; output
    caps (``top``, the 10 of most-lists) are the surveyed design's, but for refactor, which covers everything."""

    def __init__(self, corpus: DataFrame, extra_patterns: tuple[P.Secret, ...] = (), whitelist: DataFrame | None = None):
        self.corpus, self.catalog, self.whitelist = corpus, (*P.SECRETS, *extra_patterns), whitelist

    @cached_property
    def lines(self) -> DataFrame:
        return sources.lines(sources.in_folders(self.corpus))

    def scan(self) -> DataFrame:
        return indexes.functions(self.lines)

    def security(self) -> DataFrame:
        return secrets.findings(sources.lines(sources.scannable(self.corpus)), self.catalog, self.whitelist)

    def security_fixes(self) -> DataFrame:
        return secrets.fix_plan(secrets.raw_findings(sources.lines(sources.scannable(self.corpus)), self.catalog))

    def search(self, query: str, kind: str = "function", top: int | None = 20) -> DataFrame:
        """``kind``: function, route or file."""
        if kind == "function":
            return indexes.search_functions(self.scan(), query, top=top)
        if kind == "route":
            return indexes.search_routes(self.routes(), query)
        if kind == "file":
            return self.corpus.where(F.contains(F.lower("file"), F.lit(query.lower()))).select("file").orderBy("file")
        raise ValueError(f"kind is function, route or file, not {kind}")

    def function_index(self, query: str | None = None, file: str | None = None, top: int | None = 15) -> DataFrame:
        """Functions that match, or without a query the files with most."""
        return indexes.count_by(self.scan(), "file", 10) if query is None else indexes.search_functions(self.scan(), query, file, top)

    def similar(self, snippet: str, min_similarity: int = 60, top: int | None = 20) -> DataFrame:
        return similarity.similar(sources.of_language(self.corpus).drop("language"), snippet, min_similarity, top)

    def windows(self, min_lines: int = 5) -> DataFrame:
        return duplicates.windows(sources.comparable(self.corpus), min_lines=min_lines)

    def duplicates(self, min_lines: int = 5, top: int | None = 50) -> DataFrame:
        found, corpus = self.windows(min_lines), sources.comparable(self.corpus)
        return duplicates.groups(found, corpus) if top is None else duplicates.largest(found, corpus, top)

    def routes(self, framework: tuple[str, ...] | None = None) -> DataFrame:
        """Routes of these frameworks, or of those that the corpus's manifests name."""
        if framework is None:
            framework = tuple(sorted(r[0] for r in self.frameworks().collect()))  # five at most
        return indexes.routes(self.lines, framework)

    def frameworks(self) -> DataFrame:
        return indexes.frameworks(self.corpus)

    def hardware(self) -> dict[str, DataFrame]:
        code = sources.lines(sources.embedded(self.corpus))
        found = indexes.peripherals(code).unionByName(indexes.pin_config(self.lines))
        return {"peripherals": found, "defines": indexes.defines(code).unionByName(indexes.sdk_config(self.lines)), "by_type": indexes.count_by(found, "type")}

    def dependencies(self, detect_circular: bool = True, max_length: int = 8) -> dict[str, DataFrame]:
        edges = imports.edges(sources.in_folders(self.corpus))
        most, most_by = imports.degrees(edges)
        out = {"edges": edges, "report": imports.report(edges, self.corpus), "roles": imports.classify(edges, self.corpus), "most_imported": most, "most_importing": most_by}
        if detect_circular:
            out["cycles"] = imports.cycles(edges.where("not external"), max_length)
            out["summary"] = imports.summary(edges, self.corpus, out["cycles"])
        return out

    def refactor(self) -> dict[str, DataFrame]:
        groups, numbers, long = self.duplicates(top=None), refactor.magic_numbers(sources.lines(sources.without_tests(sources.in_folders(self.corpus)))), refactor.long_functions(sources.in_folders(self.corpus), top=None)
        made = refactor.suggestions(groups, numbers, long)
        return {"suggestions": made, "summary": refactor.summary(made), "constant_fixes": refactor.constant_fixes(numbers, most=None), "duplicate_fixes": refactor.duplicate_fixes(groups, self.corpus), "stats": refactor.stats(groups, numbers, long)}

    def extract(self, feature: str, as_of: str, notes: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
        """Knowledge entries of a feature: its code markers and, where given, decisions of notes and items."""
        spark = self.corpus.sparkSession
        notes = notes if notes is not None else spark.createDataFrame([], "file string, text string, feature string, files array<string>")
        items = items if items is not None else spark.createDataFrame([], "kind string, text string, feature string")
        return knowledge.extract_feature(notes, items, self.lines, feature, as_of)

    def knowledge(self, base: DataFrame, query: str | None = None, kind: str | None = None) -> DataFrame:
        """Entries of a base that match, or without a query counts by type and in all."""
        return knowledge.stats(base) if query is None else knowledge.search(base, query, kind)

    def pipeline_commands(self) -> DataFrame:
        return review.commands(self.corpus)

    def project_type(self) -> DataFrame:
        return review.project_types(self.corpus).where("chosen").select("type", "priority")

    def review(self, feature_events: DataFrame, checks: DataFrame | None = None) -> dict[str, DataFrame]:
        """Gate rows and their rollup; ``checks`` are results (name, passed, errors) of builds and tests run elsewhere."""
        items = review.security_gate(self.security()).unionByName(review.duplicate_gate(duplicates.sizes(self.windows()))).unionByName(review.feature_gate(state.features(feature_events)))
        items = items if checks is None else items.unionByName(review.check_gates(checks))
        return {"items": items, "report": review.review(items)}

    def validate(self, feature_events: DataFrame) -> DataFrame:
        return review.validate(self.security(), self.scan(), state.features(feature_events))

    # --- features, sessions and locks: folds over event logs; what a tool would record comes back as rows to append

    def _event(self, log: DataFrame, ok: DataFrame, **fields: object) -> DataFrame:
        """A row for ``log`` if ``ok``, one row with a boolean ``ok``, is true; columns that aren't named are null."""
        known = {f.name.lower(): f for f in log.schema.fields}
        cols = [F.lit(fields.get(name)).cast(f.dataType).alias(f.name) for name, f in known.items()]
        return ok.where("ok").select(*cols)

    def start(self, feature: str, events: DataFrame, ts: str, seq: int, base: DataFrame | None = None) -> dict[str, DataFrame]:
        """eng_start: what is active already, the event to append if nothing is, related knowledge, and hardware."""
        active = state.active_feature(state.features(events))
        out = {"active": active, "event": self._event(events, active.agg((F.count("*") == 0).alias("ok")), ts=ts, seq=seq, name=feature, action="start")}
        if base is not None:
            out["related"] = knowledge.search(base, feature)
        embedded = self.project_type().where(F.col("type").startswith("embedded-")).select(F.lit(True).alias("embedded"))
        out["hardware"] = self.hardware()["by_type"].join(F.broadcast(embedded.limit(1)), how="left_semi", on=F.lit(True))  # one row
        return out

    def done(self, events: DataFrame, ts: str, seq: int, notes: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, DataFrame]:
        """eng_done: the verdict (feature, critical, ok), the event to append if nothing critical is found, and knowledge."""
        active = state.active_feature(state.features(events)).select("name")
        critical = self.security().agg(F.count_if(F.col("severity") == "critical").alias("critical"))
        verdict = active.crossJoin(critical).select(F.col("name").alias("feature"), "critical", (F.col("critical") == 0).alias("ok"))
        row = active.first()
        out = {"verdict": verdict, "event": self._event(events, verdict, ts=ts, seq=seq, name=row.name if row else None, action="complete")}
        if row:
            out["knowledge"] = self.extract(row.name, ts, notes, items)
        return out

    def checkpoint(self, events: DataFrame, session: str, ts: str, seq: int) -> DataFrame:
        """eng_session_checkpoint: the event to append."""
        return self._event(events, events.sparkSession.sql("select true as ok"), ts=ts, seq=seq, session=session, action="checkpoint")

    def resume(self, events: DataFrame, key: str, scalars: tuple[str, ...], lists: tuple[str, ...] = (), checkpoint: object | None = None) -> DataFrame:
        """eng_session_resume: the checkpoints, or the state as of one (its ts)."""
        return state.checkpoints(events, key) if checkpoint is None else state.context(events, key, scalars, lists, checkpoint)

    def session_start(self, events: DataFrame, session: str, ts: str, seq: int) -> DataFrame:
        """eng_session_start: the event to append; sessions are A, B and C."""
        if session not in ("A", "B", "C"):
            raise ValueError("a session is A, B or C")
        return self._event(events, events.sparkSession.sql("select true as ok"), ts=ts, seq=seq, session=session, action="start")

    def session_status(self, events: DataFrame) -> dict[str, DataFrame]:
        """eng_session_status: sessions that ever started, and all locks."""
        ids = events.select(F.col("session").cast("string").alias("session")).where("session is not null").distinct()
        return {"sessions": state.session_status(events.withColumn("session", F.col("session").cast("string")), ids), "locks": state.locks(events)}

    def session_switch(self, events: DataFrame, session: str) -> DataFrame:
        """eng_session_switch: (session, last_active, locked_files) of the session that is switched to."""
        one = events.sparkSession.createDataFrame([(session,)], "session string")
        held = state.locks(events).where(F.col("session") == session).agg(F.count("*").alias("locked_files"))
        return state.session_status(events.withColumn("session", F.col("session").cast("string")), one).select("session", "last_active").crossJoin(held)

    def session_sync(self, events: DataFrame, session: str, top: int = 10) -> DataFrame:
        """eng_session_sync: others' locks and their last discoveries."""
        return state.sync(state.locks(events), events, session, top)

    def _locked(self, events: DataFrame, file: str, session: str, action: str, ok: object, ts: str, seq: int) -> dict[str, DataFrame]:
        owner = state.locks(events).where(F.col("file") == file).agg(F.max("session").alias("owner"))
        verdict = owner.select(F.lit(file).alias("file"), "owner", ok.alias("ok"))
        return {"verdict": verdict, "event": self._event(events, verdict, ts=ts, seq=seq, session=session, file=file, action=action)}

    def lock(self, events: DataFrame, session: str, file: str, ts: str, seq: int) -> dict[str, DataFrame]:
        """eng_lock: (file, owner, ok) and the event to append; a file that another session holds is refused."""
        return self._locked(events, file, session, "lock", F.col("owner").isNull() | (F.col("owner") == session), ts, seq)

    def unlock(self, events: DataFrame, session: str, file: str, ts: str, seq: int) -> dict[str, DataFrame]:
        """eng_unlock: as :meth:`lock`; only the owner unlocks."""
        return self._locked(events, file, session, "unlock", F.coalesce(F.col("owner") == session, F.lit(False)), ts, seq)
