from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanloom.runtime import get_spark  # noqa: E402
from spanloom.schemas import SPAN_SCHEMA  # noqa: E402

EPOCH = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def small_groups(spark):
    """Every group above ten rows counts as hot."""
    spark.conf.set("spanloom.maxGroupRows", "10")
    yield
    spark.conf.unset("spanloom.maxGroupRows")


@pytest.fixture(scope="session")
def raw_spans(spark):
    """Build raw spans from short dicts: name, id, session, at (seconds), attrs, ..."""

    def build(rows):
        out = []
        for i, r in enumerate(rows):
            attrs = dict(r.get("attrs", {}))
            if r.get("session", "s1") is not None:
                attrs.setdefault("session.id", r.get("session", "s1"))
            row = dict.fromkeys(f.name for f in SPAN_SCHEMA.fields)
            row.update(
                Timestamp=EPOCH + dt.timedelta(seconds=r.get("at", i)),
                TraceId=r.get("trace", "t1"),
                SpanId=r.get("id", f"span{i:04d}"),
                ParentSpanId=r.get("parent"),
                SpanName=r["name"],
                ServiceName=r.get("service", "svc"),
                ResourceAttributes=r.get("resource", {}),
                SpanAttributes=attrs,
                Duration=r.get("duration", 1_000_000),
                StatusCode=r.get("status", "Ok"),
                EventsName=r.get("events_name"),
                EventsAttributes=r.get("events"),
            )
            out.append(tuple(row[f.name] for f in SPAN_SCHEMA.fields))
        return spark.createDataFrame(out, SPAN_SCHEMA)

    return build


@pytest.fixture(scope="session")
def spans(raw_spans):
    """The same, parsed."""
    from spanloom.operators.parse import parse_spans

    return lambda rows: parse_spans(raw_spans(rows))


def tool(name="search", **kw):
    attrs = {"traceloop.entity.name": name, "ioa_observe.workflow.name": "flow", **kw.pop("attrs", {})}
    return {"name": f"{name}.tool", "attrs": attrs, **kw}


def agent(name, **kw):
    attrs = {"ioa_observe.entity.name": name, **kw.pop("attrs", {})}
    return {"name": f"{name}.agent", "attrs": attrs, **kw}


def model(prompts=(), completions=(), **kw):
    attrs = dict(kw.pop("attrs", {}))
    for kind, messages in (("prompt", prompts), ("completion", completions)):
        for n, (role, content) in enumerate(messages):
            if role is not None:
                attrs[f"gen_ai.{kind}.{n}.role"] = role
            attrs[f"gen_ai.{kind}.{n}.content"] = content
    return {"name": "openai.chat", "attrs": attrs, **kw}
