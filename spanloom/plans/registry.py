"""User and native metrics under one contract: a function from `Frames` to result rows."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from spanloom.constants import AGGREGATION_LEVELS
from spanloom.operators import confidence, metrics, population
from spanloom.operators.agents import agent_view
from spanloom.operators.results import (
    missing_requirements,
    result_rows,
    split_work,
    with_bucket,
    with_labels,
    with_session_app,
)
from spanloom.plans.build import Frames, with_session_inputs
from spanloom.runtime import materialize, scratch_root
from spanloom.schemas import METRIC_RESULT_SCHEMA

Compute = Callable[[Frames], DataFrame]


@dataclass(frozen=True)
class Metric:
    name: str
    level: str
    compute: Compute
    requires: tuple[str, ...] = ()
    agent_compute: Compute | None = None

    @property
    def supports_agents(self) -> bool:
        return self.agent_compute is not None


class Registry:
    def __init__(self) -> None:
        self._metrics: dict[str, Metric] = {}

    def metric(self, name: str, level: str, requires: tuple[str, ...] = (), agent: Compute | None = None):
        """Register the decorated function; `agent` is its agent-level variant."""
        if level not in AGGREGATION_LEVELS:
            raise ValueError(f"level must be one of {AGGREGATION_LEVELS}, got {level!r}")

        def register(compute: Compute) -> Compute:
            self._metrics[name] = Metric(name, level, compute, requires, agent)
            return compute

        return register

    def get(self, name: str) -> Metric | None:
        return self._metrics.get(name)

    def computes(self, name: str, level: str) -> Compute | None:
        """How a metric is computed at a level, if it is."""
        m = self._metrics[name]
        return m.compute if level == m.level else m.agent_compute if level == "agent" else None

    def names(self) -> list[str]:
        return sorted(self._metrics)

    def by_level(self) -> dict[str, list[str]]:
        """Names per level; a session metric with an agent variant is listed under both."""
        levels: dict[str, list[str]] = {level: [] for level in AGGREGATION_LEVELS}
        for name in self.names():
            m = self._metrics[name]
            levels[m.level].append(name)
            if m.supports_agents:
                levels["agent"].append(name)
        return levels


native = Registry()


def _rate(frame: DataFrame, level: str) -> DataFrame:
    return result_rows(frame, "ToolErrorRate", level, F.col("tool_error_rate"), unit="%")


@native.metric("ToolErrorRate", "session", agent=lambda f: _rate(agent_view(f.owned), "agent"))
def _tool_error_rate(f: Frames) -> DataFrame:
    return _rate(metrics.tool_error_rate(f.spans), "session")


@native.metric(
    "CyclesCount",
    "session",
    agent=lambda f: result_rows(metrics.agent_cycles(f.owned), "CyclesCount", "agent", F.col("cycles"), unit="cycles"),
)
def _cycles(f: Frames) -> DataFrame:
    found = f.sessions.select("session_id").join(metrics.cycles(f.spans, f.largest_session), "session_id", "left")
    return result_rows(found, "CyclesCount", "session", F.coalesce("cycles", F.lit(0)), unit="cycles")


@native.metric("AgentToAgentInteractions", "session")
def _agent_to_agent(f: Frames) -> DataFrame:
    found = metrics.agent_to_agent(f.transitions, f.sessions)
    return result_rows(found, "AgentToAgentInteractions", "session", value_json=F.col("value_json"), unit="transitions")


@native.metric("AgentToToolInteractions", "session")
def _agent_to_tool(f: Frames) -> DataFrame:
    found = metrics.agent_to_tool(f.spans)
    counted = metrics.count_maps(found.filter("error is null"), "interaction", f.sessions)
    bad = found.filter("error is not null").select("session_id", "error")
    return result_rows(
        counted.join(bad, "session_id", "left"),
        "AgentToToolInteractions",
        "session",
        value_json=F.col("value_json"),
        error=F.col("error"),
        unit="interactions",
    )


@native.metric("GraphDeterminismScore", "population")
def _path_variance(f: Frames) -> DataFrame:
    found = metrics.path_variance(metrics.path_edges(f.spans, f.largest_session), f.sessions)
    return result_rows(
        found, "GraphDeterminismScore", "population", F.col("path_variance"), error=F.col("error"), unit="average_edit_distance"
    )


@native.metric("WorkflowEfficiency", "session")
def _workflow_efficiency(f: Frames) -> DataFrame:
    found = metrics.workflow_efficiency(f.transitions, f.sessions)
    return result_rows(found, "WorkflowEfficiency", "session", F.col("efficiency"), unit="efficiency_score")


@native.metric("PassiveEvalApp", "session")
def _passive_app(f: Frames) -> DataFrame:
    found = metrics.passive_app(f.session_metrics)
    body = F.to_json(F.struct(*[c for c in found.columns if c != "session_id"]))
    return result_rows(found, "PassiveEvalApp", "session", value_json=body, unit="dict_stats")


@native.metric("PassiveEvalAgents", "session")
def _passive_agents(f: Frames) -> DataFrame:
    grid = population.aligned_agent_measures(population.agent_metrics(f.agent_stats), f.sessions)
    found = metrics.passive_agents(grid)
    body = F.to_json(F.struct(*[c for c in found.columns if c not in ("session_id", "agent")]))
    return result_rows(found, "PassiveEvalAgents", "session", value_json=body, unit="dict_stats")


@native.metric("ToolError", "span")
def _tool_status(f: Frames) -> DataFrame:
    found = metrics.tool_status(f.spans)
    error = F.when(F.col("status").isNull(), "no tool status")
    return result_rows(found, "ToolError", "span", value_json=F.to_json(F.struct("status")), error=error, category="agent")


@native.metric("SpanCounter", "session")
def _span_counter(f: Frames) -> DataFrame:
    return result_rows(metrics.span_counts(f.spans), "SpanCounter", "session", F.col("n_spans"), unit="spans")


def _confidence(column: str, name: str, agent: bool) -> Compute:
    def compute(f: Frames) -> DataFrame:
        keys = ["session_id", "agent"] if agent else ["session_id"]
        source, entities = (f.owned, f.agent_stats) if agent else (f.spans, f.sessions)
        found = confidence.confidence(confidence.token_logprobs(source, keys), entities, keys)
        error = F.when(F.col(column) == -1, "no log-probabilities")
        return result_rows(found, name, keys[-1].removesuffix("_id"), F.col(column), error=error)

    return compute


for _name, _column in [
    ("LLMAverageConfidence", "average_confidence"),
    ("LLMMinimumConfidence", "minimum_confidence"),
    ("LLMMaximumConfidence", "maximum_confidence"),
]:
    native.metric(_name, "session", agent=_confidence(_column, _name, True))(_confidence(_column, _name, False))


# Metrics whose jobs run side by side.
PARALLEL = 4

_COLUMNS = [f.name for f in METRIC_RESULT_SCHEMA.fields]


def _error_rows(frames: Frames, name: str, level: str, text: str) -> DataFrame:
    """One failed result that stands for a metric that could not be computed."""
    one = frames.spans.sparkSession.createDataFrame([(text,)], "problem string")
    return result_rows(one, name, level, error=F.col("problem"))


def _problem(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"[:2000]


def _safely(compute: Callable[[], DataFrame], frames: Frames, name: str, level: str) -> DataFrame:
    """A metric whose plan fails gives an error row, and the run goes on."""
    try:
        return compute().select(*_COLUMNS)
    except Exception as problem:  # noqa: BLE001 - whatever a user's metric raises
        return _error_rows(frames, name, level, _problem(problem))


def _isolated(work: list[tuple[str, str, Callable[[], DataFrame]]], frames: Frames, parallel: int) -> list[DataFrame]:
    """The results of every metric, each computed by jobs of a group of its own and committed to
    a folder of its own. One that fails, at whatever stage, gives an error row; what it has begun
    is cancelled and what it has written is not read; the others go on.

    Plans are made one at a time, since they share the stored frames; their jobs run side by side."""
    spark, root, planning = frames.spans.sparkSession, f"{scratch_root(frames.spans.sparkSession)}/spanloom/metrics-{uuid.uuid4().hex}", threading.Lock()

    def run(number: int, name: str, level: str, compute: Callable[[], DataFrame]) -> DataFrame:
        group = f"{root.rsplit('/', 1)[1]}-{number}"
        spark.sparkContext.setJobGroup(group, f"{name} ({level})", interruptOnCancel=True)
        try:
            with planning:
                rows = compute().select(*_COLUMNS)
            place = f"{root}/{number}"
            rows.write.mode("errorifexists").parquet(place)
            return spark.read.schema(METRIC_RESULT_SCHEMA).parquet(place)
        except Exception as problem:  # noqa: BLE001 - whatever a user's metric raises, on the driver or in a task
            spark.sparkContext.cancelJobGroup(group)
            return _error_rows(frames, name, level, _problem(problem))
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                spark.sparkContext.setLocalProperty(key, None)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(run), n, *w) for n, w in enumerate(work)]
        return [a.result() for a in asked]


def _wanted(frames: Frames, name: str, level: str) -> DataFrame:
    if level == "agent":
        who = frames.agent_stats.select("session_id", F.col("agent").alias("agent_id"))
    else:
        who = frames.sessions.select("session_id")
    return who.withColumn("metric_name", F.lit(name))


def skipped_metrics(
    frames: Frames, names: list[str] | None = None, levels: list[str] | None = None, registry: Registry = native
) -> DataFrame:
    """Session and agent metrics that a session lacks inputs for: metric_name,
    aggregation_level, session_id, entity_id, skip_category, missing."""
    levels = levels or ["session"]
    needs: dict[str, list[str]] = {}
    found: list[tuple[str, str]] = []
    for name in names or registry.names():
        m = registry.get(name)
        if m is not None and m.requires:
            needs[name] = list(m.requires)
            found += [(name, level) for level in levels if level in ("session", "agent") and registry.computes(name, level)]
    spark = frames.spans.sparkSession
    shape = "metric_name string, aggregation_level string, session_id string, entity_id string, skip_category string, missing array<string>"
    if not found:
        return spark.createDataFrame([], shape)
    lacking = missing_requirements(with_session_inputs(frames), needs).filter(~F.col("valid"))
    per_metric = {name: [level for n, level in found if n == name] for name, _ in found}
    listed = F.create_map(*[x for n, ls in per_metric.items() for x in (F.lit(n), F.array(*[F.lit(v) for v in ls]))])
    return lacking.withColumn("aggregation_level", F.explode(listed[F.col("metric_name")])).select(
        "metric_name", "aggregation_level", "session_id", F.col("session_id").alias("entity_id"), F.lit("missing_requirements").alias("skip_category"), "missing"
    )


def run_metrics(
    frames: Frames,
    names: list[str] | None = None,
    levels: list[str] | None = None,
    registry: Registry = native,
    stored: DataFrame | None = None,
    isolated: bool = True,
    parallel: int = PARALLEL,
) -> DataFrame:
    """Results of the named metrics at the given levels (session by default), labelled, with
    the bucket each goes to.

    Sessions that lack what a metric requires have no result of it (`skipped_metrics` lists
    them). An unknown name, or a metric that fails, when planned or while it runs, gives one error
    row at its level, and the others go on: each runs by itself, `parallel` at a time, and its
    results are stored. With `isolated` false all metrics are one lazy plan, which is guarded against
    failures of planning only. Stored results are reused; metrics see only the sessions that still
    have work."""
    levels = levels or ["session"]
    asked = [(name, registry.get(name)) for name in names or registry.names()]
    skipped = skipped_metrics(frames, names, levels, registry)
    parts: list[DataFrame] = []
    work: list[tuple[str, str, Compute]] = []
    for name, m in asked:
        if m is None:
            parts.append(_error_rows(frames, name, levels[0], f"unknown metric {name!r}"))
            continue
        work += [(name, level, c) for level in levels if (c := registry.computes(name, level)) is not None]
    if not work and not parts:
        raise ValueError("no metric matches the given levels")

    todo: dict[tuple[str, str], DataFrame] = {}
    if stored is not None:
        for name, level, _ in work:
            if level in ("session", "agent"):
                left, reuse = split_work(_wanted(frames, name, level), stored, level == "agent")
                todo[name, level] = left
                parts.append(reuse.select(*[f.name for f in METRIC_RESULT_SCHEMA.fields]))
    narrowed = frames
    if work and len(todo) == len(work):
        ids = reduce(DataFrame.union, [t.select("session_id") for t in todo.values()]).distinct()
        narrowed = Frames(materialize(frames.spans.join(ids, "session_id", "left_semi"), "spans-with-work"))

    def planned(name: str, level: str, compute: Compute) -> Callable[[], DataFrame]:
        def plan() -> DataFrame:
            rows = compute(narrowed).select(*_COLUMNS)
            if (name, level) in todo:
                rows = rows.join(todo[name, level].select("session_id").distinct(), "session_id", "left_semi").select(*_COLUMNS)
            if registry.get(name).requires and level in ("session", "agent"):
                out = skipped.filter((F.col("metric_name") == name) & (F.col("aggregation_level") == level)).select(F.col("session_id").alias("_out"))
                rows = rows.join(out, rows["session_id"] == out["_out"], "left_anti")
            return rows

        return plan

    plans = [(name, level, planned(name, level, compute)) for name, level, compute in work]
    if isolated:
        parts += _isolated(plans, narrowed, parallel)
    else:
        parts += [_safely(plan, narrowed, name, level) for name, level, plan in plans]
    everything = reduce(DataFrame.unionByName, parts)
    return with_bucket(with_labels(with_session_app(everything, frames.sessions)))
