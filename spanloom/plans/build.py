"""From raw spans to the frames that metrics read, in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import agents, conversation, metrics, population, roles, sessions, tree
from spanloom.operators.ordered import largest_group
from spanloom.operators.parse import in_sessions, parse_spans
from spanloom.runtime import materialize

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Frames:
    """Typed spans of sessions and what is derived from them. Every frame is a plan built on
    first use; those that several metrics share are stored once."""

    spans: DataFrame

    @cached_property
    def largest_session(self) -> int:
        """Spans of the largest session, counted once for all order-dependent operators."""
        return largest_group(self.spans, ["session_id"])

    @cached_property
    def largest_conversation(self) -> int:
        """Elements of the largest conversation."""
        return largest_group(self.elements, ["session_id"])

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.sessions(self.spans)

    @cached_property
    def tree(self) -> DataFrame:
        """Reachable spans with their depth and nested-interval labels."""
        return materialize(tree.labelled_tree(self.spans), "forest")

    @cached_property
    def agent_stats(self) -> DataFrame:
        return materialize(agents.agent_stats(self.spans), "agent-stats")

    @cached_property
    def owned(self) -> DataFrame:
        """Spans of every agent. Who owns what is stored once, narrow; the columns a metric
        reads join when it runs."""
        who = materialize(agents.ownership(self.spans, ordered=True), "ownership")
        return agents.agent_spans(self.spans, who)

    @cached_property
    def elements(self) -> DataFrame:
        return conversation.conversation_elements(self.spans)

    @cached_property
    def agent_elements(self) -> DataFrame:
        found = conversation.conversation_elements(self.owned, ["session_id", "agent"], tools=True)
        return materialize(found, "agent-elements")

    @cached_property
    def conversations(self) -> DataFrame:
        """The elements of each session as JSON, rendered once for all requests."""
        return materialize(conversation.elements_json(self.elements, ["session_id"], largest=self.largest_conversation), "conversations")

    @cached_property
    def agent_transcripts(self) -> DataFrame:
        """The transcript of each agent, rendered once for all requests."""
        return materialize(conversation.transcripts(self.agent_elements, ["session_id", "agent"]), "transcripts")

    @cached_property
    def endpoints(self) -> DataFrame:
        return conversation.endpoints(self.spans)

    @cached_property
    def agent_endpoints(self) -> DataFrame:
        return conversation.endpoints(self.owned, ["session_id", "agent"], min_length=3)

    @cached_property
    def transitions(self) -> DataFrame:
        return metrics.transition_counts(metrics.agent_transitions(self.spans, self.largest_session))

    @cached_property
    def session_metrics(self) -> DataFrame:
        return materialize(population.session_metrics(self.spans), "session-metrics")

    @cached_property
    def roles(self) -> DataFrame:
        behaviour = roles.agent_behaviour(self.agent_elements, self.agent_stats, agents.agent_tools(self.spans))
        return materialize(roles.skip_coordinators(roles.agent_roles(behaviour)), "roles")


def build_sessions(raw: DataFrame, session: str | None = None, steps: list[Step] | None = None) -> Frames:
    """Parse, keep spans of sessions, optionally one session (its exact id, else the first
    id that contains the text), and apply user steps in order. Raises when nothing is left."""
    spans = tree.unique_spans(in_sessions(parse_spans(raw)))
    if session is not None:
        hit = sessions.by_id_text(spans.select("session_id").distinct(), session)
        spans = spans.join(hit, "session_id", "left_semi")
    for step in steps or []:
        before = set(spans.columns)
        spans = spans.transform(step)
        lost = before - set(spans.columns)
        if lost:
            raise ValueError(f"an enrichment step dropped columns: {sorted(lost)}")
    stored = materialize(spans, "spans")
    if stored.isEmpty():
        raise ValueError("no valid spans" if session is None else f"session {session!r} not found")
    return Frames(stored)


def with_session_inputs(frames: Frames) -> DataFrame:
    """Per session the inputs that metrics may require, for `results.missing_requirements`."""
    counts = frames.elements.groupBy("session_id").agg(F.count("*").alias("conversation_data"))
    tools = frames.spans.groupBy("session_id").agg(F.count_if(F.col("entity_type") == "tool").alias("tool_calls"))
    return (
        frames.sessions.select("session_id")
        .join(counts, "session_id", "left")
        .join(tools, "session_id", "left")
        .join(frames.endpoints, "session_id", "left")
        .withColumn("conversation_elements", F.col("conversation_data"))
    )
