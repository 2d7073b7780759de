"""The analysis of a source tree from scan to report: lazy tables first, then bounded rows for the report."""

from __future__ import annotations

import importlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import architecture, extract, graph, metrics, resolve, retrieval, rules, summary
from ..schema import CHECKPOINTS, RUNS
from ..sources.tree import OUTPUT_FOLDER, require_folder, scan
from ..staging import Stages
from ..streaming.events import EventLog
from .report import write_reports
from .store import Store

Planner = Callable[[str], dict]
Narrator = Callable[[dict], dict | None]


@dataclass
class Options:
    query: str | None = None
    planner: Planner | None = None  # falls back to the rules where it fails
    narrator: Narrator | None = None  # None or an error: the report goes on without
    listener: Callable[[dict], None] | None = None
    output: str | None = None
    persist: bool = True
    most_findings: int = 1_000  # of a report, and files of each; the store has them all
    most_files: int = 100

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None, **more) -> Options:
        """From TESSERA_OUTPUT, TESSERA_PERSIST (0: no), and TESSERA_PLANNER and TESSERA_NARRATOR, each "module:function"."""
        env = os.environ if env is None else env

        def named(where: str | None) -> Callable | None:
            module, _, name = (where or "").partition(":")
            return getattr(importlib.import_module(module), name) if name else None

        return cls(**{"planner": named(env.get("TESSERA_PLANNER")), "narrator": named(env.get("TESSERA_NARRATOR")), "output": env.get("TESSERA_OUTPUT"), "persist": env.get("TESSERA_PERSIST") != "0"} | more)


@dataclass
class Repositories:
    """The tables of any number of repositories, of one plan: nothing is collected, and no repository has a plan of its own."""

    roots: DataFrame
    settings: DataFrame
    files: DataFrame
    contents: DataFrame
    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    cycles: DataFrame
    findings: DataFrame
    directories: DataFrame
    layers: DataFrame
    stacks: DataFrame
    metrics: DataFrame

    def contexts(self, limits: summary.Limits = summary.Limits()) -> DataFrame:
        """repo_id, context: the summary of each."""
        cuts = graph.cycle_cuts(self.cycles, architecture.edge_paths(self.edges, self.files))
        others = self.findings.where(F.col("rule") != graph.CYCLE_RULE).select("repo_id", "rule", "severity", "files", F.row_number().over(Window.partitionBy("repo_id", "rule").orderBy("files")).alias("ordinal"))
        made = summary.contexts(self.roots, self.files, self.symbols, self.edges, self.stacks, self.metrics, self.directories, self.layers, self.cycles, cuts, others, limits)
        return Stages(self.roots.sparkSession, "contexts").put(made, "contexts")


@dataclass
class Analysis(Repositories):
    """The tables of one repository, and what was collected of them."""

    repo_id: str = ""
    stack: dict = field(default_factory=dict)
    score: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)
    plan: dict | None = None
    retrieval: list[dict] = field(default_factory=list)


def metrics_of(row) -> dict:
    """Score 0 and no dimensions without files."""
    return {"score": row["score"], "dimensions": {k: row[k] for k in ("complexity", "coupling", "typing")}} if row else {"score": 0, "dimensions": {}}


def repositories(roots: DataFrame) -> Repositories:
    """Everything that needs no planner or narrator, of all roots (repo_id, root) at once."""
    stages = Stages(roots.sparkSession, "repositories")
    roots = roots.select("repo_id", "root")
    files, contents, settings, links = scan(roots)
    files, contents = stages.put(files, "files"), stages.put(contents, "contents")
    none = resolve.Surroundings.none(roots.sparkSession)
    facts = stages.put(extract.facts(files, contents), "facts")
    symbols = stages.put(extract.symbols(facts, files), "symbols")
    edges, unresolved, _ = resolve.dependency_edges(facts, files, resolve.Surroundings(settings, links, none.elsewhere, roots))
    edges = stages.put(edges, "edges")
    cycles = stages.put(graph.components(files, edges), "cycles")
    front = rules.frontend_findings(contents).withColumn("ordinal", F.lit(1 << 30).cast("long"))
    findings = stages.put(graph.cycle_findings(cycles).unionByName(front), "findings")
    deps = metrics.package_rows(settings.where("path = 'package.json'"))
    stacks = stages.put(metrics.stack(files, metrics.merged_dependencies(deps)), "stacks")
    found = {"directories": architecture.directories(files, edges), "layers": architecture.layers(files, edges), "metrics": metrics.maintainability(files, edges)}
    return Repositories(roots, settings, files, contents, symbols, edges, unresolved, cycles, findings, stacks=stacks, **{k: stages.put(v, k) for k, v in found.items()})


def tables(spark: SparkSession, root: str, repo_id: str | None = None) -> Analysis:
    """Those of one repository, with its stack and score."""
    root = require_folder(root)
    repo_id = repo_id or root
    r = repositories(spark.createDataFrame([(repo_id, root)], "repo_id string, root string"))
    row = r.stacks.first()
    found = row.asDict() if row else {"framework": None, "framework_version": None, "build_tool": None, "state_management": [], "language": [], "router": None, "confidence": 0.25, "evidence": []}
    stack = {"framework": found["framework"], "frameworkVersion": found["framework_version"], "buildTool": found["build_tool"], "stateManagement": list(found["state_management"]), "language": list(found["language"]), "router": found["router"], "confidence": found["confidence"], "evidence": list(found["evidence"])}
    return Analysis(**vars(r), repo_id=repo_id, stack=stack, score=metrics_of(r.metrics.first()))


def plan_query(spark: SparkSession, query: str, planner: Planner | None) -> dict:
    if planner:
        try:
            return planner(query)
        except Exception:  # a planner of the caller's may fail in any way
            return retrieval.parse_query(spark, query)
    return retrieval.parse_query(spark, query)


def narration_context(a: Analysis) -> dict:
    """The summary that a narrator is given."""
    return json.loads(a.contexts().select(F.to_json("context").alias("x")).first()["x"])


def run_analysis(spark: SparkSession, root: str, options: Options | None = None) -> Analysis:
    o = options or Options()
    root = require_folder(root)
    out = o.output or str(Path(root, OUTPUT_FOLDER))
    run_id = uuid.uuid4().hex
    log = EventLog(f"{out}/events", run_id, o.listener)
    with log.step("loadRepository") as s:
        s.detail = root
    with log.step("scanFiles") as s:
        a = tables(spark, root)
        s.detail = f"{a.files.count()} files"
    with log.step("detectStack") as s:
        s.detail = a.stack["framework"] or "unknown"
    with log.step("parseSemantic") as s:
        s.detail = f"{a.symbols.count()} symbols, {a.edges.count()} edges"
        if left := a.unresolved.where("outside").select("spec").distinct().count():
            s.detail += f", {left} modules outside the tree left out"
    with log.step("analyzeArchitecture") as s:
        s.detail = f"{a.directories.count()} modules"
        mermaid = "\n".join(r["line"] for r in architecture.layer_mermaid(a.layers).orderBy("line_no").collect()) or "graph TD"
    with log.step("dependency") as s:
        s.detail = f"{a.cycles.count()} cycles"
    with log.step("quality") as s:
        s.detail = f"score {a.score['score']}"
    with log.step("frontend") as s:
        total = a.findings.count()
        found = [r.asDict() for r in a.findings.withColumn("files", F.slice("files", 1, o.most_files)).orderBy("ordinal", "rule", "files").limit(o.most_findings).collect()]
        s.detail = f"{total} findings"
    with log.step("retrieveContext") as s:
        if o.query:
            a.plan = plan_query(spark, o.query, o.planner)
            a.retrieval = [r.asDict() for r in retrieval.retrieve(a.plan, a.files, a.symbols, a.edges, a.contents).collect()]
        s.detail = f"{len(a.retrieval)} results"
    with log.step("narrate") as s:
        told = None
        if o.narrator:
            try:
                told = o.narrator(narration_context(a))
            except Exception as e:  # the report goes on without
                s.detail = f"skipped: {e}"
    with log.step("render"):
        at = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        listed = [{k: f[k] for k in ("rule", "severity", "message", "files", "evidence")} for f in found]
        a.report = {"root": root, "stack": a.stack, "metrics": a.score, "findings": listed, "mermaid": mermaid, "narration": told, "generatedAt": at, "findingsLeftOut": total - len(found)}
        if o.persist:
            store = Store(spark, f"{out}/store")
            sizes = {"files": a.files.count(), "symbols": a.symbols.count(), "edges": a.edges.count(), "cycles": a.cycles.count(), "findings": total}
            state = summary.snapshot(a.score, a.stack, sizes)
            one = lambda row, schema: spark.createDataFrame([row], schema)
            told_run = one((run_id, at, json.dumps(a.report, ensure_ascii=False), a.repo_id), RUNS + ", repo_id string")
            store.commit(told_run, a.files, one((run_id, log.seq, at, json.dumps(state, ensure_ascii=False)), CHECKPOINTS))
            write_reports(out, a.report)
    return a


class Runs:
    """Analyses in the background: submit gives an id at once, status and result follow it."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.pool, self.futures, self.events = spark, ThreadPoolExecutor(workers), {}, {}

    def submit(self, root: str, **options) -> str:
        require_folder(root)
        run_id = uuid.uuid4().hex
        self.events[run_id] = []
        self.futures[run_id] = self.pool.submit(run_analysis, self.spark, root, Options(listener=self.events[run_id].append, **options))
        return run_id

    def status(self, run_id: str) -> str:
        future: Future = self.futures[run_id]
        return "running" if not future.done() else "failed" if future.exception() else "completed"

    def frames(self, run_id: str, every: float = 0.2) -> Iterator[tuple[str, dict]]:
        """(event name, payload): what has happened first, then what comes, and in any case a closing done."""
        at = 0
        while True:
            status = self.status(run_id)  # before the events: none is missed
            for event in self.events[run_id][at:]:
                at += 1
                yield "progress", event
            if status != "running":
                yield "done", {"run_id": run_id, "status": status}
                return
            time.sleep(every)

    def result(self, run_id: str, timeout: float | None = None) -> Analysis:
        return self.futures[run_id].result(timeout)
