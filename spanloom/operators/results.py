"""Metric results: building rows, labels, routing by level, reuse, regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.constants import GRADE_LABELS
from spanloom.schemas import METRIC_RESULT_SCHEMA

# Scored by an outside scorer, so labelled by that scorer's own threshold.
THRESHOLD_METRICS = [
    "AnswerRelevancyMetric",
    "RoleAdherenceMetric",
    "TaskCompletionMetric",
    "ConversationCompletenessMetric",
    "BiasMetric",
    "GroundednessMetric",
    "TonalityMetric",
    "ToxicityMetric",
    "GeneralStructureAndStyleMetric",
]


def result_rows(
    df: DataFrame,
    metric: str | Column,
    level: str,
    value: Column | None = None,
    value_json: Column | None = None,
    error: Column | None = None,
    **fields: Column | str,
) -> DataFrame:
    """Rows of the result schema from a frame of entities. A row with an `error` text is a
    failure: value -1, not successful."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    have = set(df.columns)
    failed = F.lit(False) if error is None else error.isNotNull()
    given = {
        "metric_name": lit(metric),
        "aggregation_level": F.lit(level),
        "category": F.lit("application"),
        "source": F.lit("native"),
        "value_num": F.when(failed, -1.0).otherwise(F.lit(None) if value is None else value),
        "value_json": F.when(~failed, F.lit(None) if value_json is None else value_json),
        "success": ~failed,
        "error_message": F.lit(None) if error is None else error,
        "from_cache": F.lit(False),
        "agent_id": F.col("agent") if "agent" in have else F.lit(None),
        **{name: lit(c) for name, c in fields.items()},
    }
    out = []
    for f in METRIC_RESULT_SCHEMA.fields:
        source = given.get(f.name, F.col(f.name) if f.name in have else F.lit(None))
        out.append(source.cast(f.dataType).alias(f.name))
    return df.select(*out)


def label_table(spark: SparkSession) -> DataFrame:
    """(metric, key, label): 42 rows."""
    rows = [(m, k, label) for m, low, high in GRADE_LABELS for k, label in ((0, low), (1, high))]
    return spark.createDataFrame(rows, "metric_name string, key int, grade_label string")


def with_labels(results: DataFrame, threshold: Column | None = None) -> DataFrame:
    """Human labels: 1 from 0.5 up, or from the scorer's own threshold up where it has one; a
    sentiment result takes the largest of neg, neu and pos, in that order on ties."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    own = F.col("metric_name").isin(THRESHOLD_METRICS)
    limit = threshold if threshold is not None else meta("threshold").try_cast("double")
    key = F.when(own, F.when(limit.isNotNull(), (F.col("value_num") >= limit).cast("int"))).otherwise(
        (F.col("value_num") >= 0.5).cast("int")
    )
    mood = F.array_max(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        meta(name).try_cast("double").isNotNull(),
                        F.struct(meta(name).try_cast("double").alias("score"), F.lit(rank).alias("rank"), F.lit(name).alias("name")),
                    )
                    for rank, name in ((2, "neg"), (1, "neu"), (0, "pos"))
                ]
            )
        )
    )["name"]
    # The label table is a constant of this library (42 rows), safe to send to every task.
    labels = F.broadcast(label_table(results.sparkSession))
    keyed = results.withColumn("_key", key)
    return (
        keyed.join(
            labels,
            (keyed["metric_name"] == labels["metric_name"]) & (keyed["_key"] == labels["key"]),
            "left",
        )
        .drop(labels["metric_name"])
        .withColumn("label", F.when(F.col("metric_name") == "Sentiment", mood).otherwise(F.col("grade_label")))
        .drop("_key", "key", "grade_label")
    )


def with_bucket(results: DataFrame) -> DataFrame:
    """Where a result goes: its level, or failed when it is unsuccessful and has no value."""
    empty = (F.col("value_num") == -1) | (F.col("value_json") == "{}") | (
        F.col("value_num").isNull() & F.col("value_json").isNull()
    )
    failed = ~F.col("success") & F.coalesce(empty, F.lit(False))
    return results.withColumn("bucket", F.when(failed, "failed").otherwise(F.col("aggregation_level")))


def with_session_app(results: DataFrame, session_frame: DataFrame) -> DataFrame:
    """App name of the result's session where there is one."""
    apps = session_frame.select("session_id", F.col("app_name").alias("_app"))
    named = results.join(apps, "session_id", "left")
    below_population = F.col("aggregation_level").isin("span", "session", "agent")
    return named.withColumn(
        "app_name", F.when(below_population, F.coalesce("_app", "app_name")).otherwise(F.col("app_name"))
    ).select(*results.columns)


def distinct_failures(failures: DataFrame) -> DataFrame:
    """Failures that differ in any field."""
    return failures.dropDuplicates()


def split_work(wanted: DataFrame, stored: DataFrame, agent_level: bool = False) -> tuple[DataFrame, DataFrame]:
    """(work still to do, results to reuse). `wanted` holds session_id and metric_name, for
    agents also agent_id; `stored` holds stored results, several of a key counting as one.

    For agents a session counts as a whole: its results are reused if every wanted agent of it
    has one, else all of its agents are computed again. Stored agents that are not wanted, being
    no agents of the session, are left out."""
    group = ["session_id", "metric_name"]
    keys = [*group, "agent_id"] if agent_level else group
    level = "agent" if agent_level else "session"
    one = F.max(F.struct(*[F.col(c) for c in stored.columns])).alias("_one")
    usable = stored.filter(F.col("aggregation_level") == level).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(one)
    asked = wanted.select(*keys).distinct()
    matched = asked.join(usable, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    if agent_level:
        counts = matched.groupBy(*[F.col(k).alias(f"_g_{k}") for k in group]).agg(
            (F.count("_one") == F.count(F.lit(1))).alias("_whole")
        )
        matched = matched.join(counts, [F.col(k) == F.col(f"_g_{k}") for k in group])
    else:
        matched = matched.withColumn("_whole", F.col("_one").isNotNull())
    todo = matched.filter(~F.col("_whole")).select(*keys)
    reuse = matched.filter("_whole").select("_one.*").withColumn("from_cache", F.lit(True))
    return todo, reuse.select(*stored.columns) if "from_cache" in stored.columns else reuse


def reused_and_new(reused: DataFrame, computed: DataFrame) -> DataFrame:
    return reused.unionByName(computed)


def entity_key() -> Column:
    """The entity a result belongs to."""
    level = F.col("aggregation_level")
    unknown = F.lit("unknown")
    return (
        F.when(level == "span", F.coalesce("span_id", unknown))
        .when(level == "session", F.coalesce("session_id", unknown))
        .when(level == "agent", F.coalesce("agent_id", unknown))
        .otherwise("all")
    )


def results_by_entity(results: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row per entity: evaluated, failed and skipped counts and metric names, the session and
    app it belongs to, and `items`, each metric with its state, value and reason."""
    state = F.when(F.col("bucket") == "failed", "failed").otherwise("evaluated")
    value = F.coalesce(F.col("value_json"), F.col("value_num").cast("string"))
    rows = with_bucket(results).select(
        "aggregation_level",
        entity_key().alias("entity_id"),
        "session_id",
        "app_name",
        "metric_name",
        state.alias("state"),
        value.alias("value"),
        F.coalesce("error_message", "reasoning").alias("reason"),
    )
    if skipped is not None:
        rows = rows.unionByName(
            skipped.select(
                "aggregation_level",
                F.when(F.col("aggregation_level") == "span", F.col("entity_id")).otherwise(F.col("session_id")).alias("entity_id"),
                "session_id",
                F.lit(None).cast("string").alias("app_name"),
                "metric_name",
                F.lit("skipped").alias("state"),
                F.lit(None).cast("string").alias("value"),
                F.col("skip_category").alias("reason"),
            )
        )
    listed = lambda s: F.collect_set(F.when(F.col("state") == s, F.col("metric_name")))
    return rows.groupBy("aggregation_level", "entity_id").agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("evaluated", "failed", "skipped")],
        *[F.array_join(F.sort_array(listed(s)), ",").alias(s) for s in ("evaluated", "failed", "skipped")],
        F.min("session_id").alias("session_id"),
        F.max("app_name").alias("app_name"),
        F.sort_array(F.collect_set(F.struct("metric_name", "state", "value", "reason"))).alias("items"),
    )


def result_documents(results: DataFrame) -> DataFrame:
    """One JSON document per result, with the list it belongs to; nothing is gathered."""
    body = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    return results.select(
        F.concat(F.col("aggregation_level"), F.lit("_metrics")).alias("level"), entity_key().alias("entity_id"), "metric_name", body.alias("document")
    )


# --- what is computed for what ---------------------------------------------------------------


def _span_metrics(catalog: DataFrame) -> Column:
    """The span metrics of a catalogue as one literal: a stated list of requested metrics."""
    rows = catalog.filter(F.col("aggregation_level") == "span").select("metric_name", "entity_types").collect()
    if not rows:
        return F.expr("cast(array() as array<struct<metric_name:string,entity_types:array<string>>>)")
    return F.array(
        *[
            F.struct(F.lit(r["metric_name"]).alias("metric_name"), F.array(*[F.lit(t) for t in r["entity_types"]]).cast("array<string>").alias("entity_types"))
            for r in rows
        ]
    )


def match_span_metrics(spans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Span × metric by required entity type. The catalogue is matched as a literal inside each
    row, so that spans are not dealt by their few types."""
    fits = F.filter(_span_metrics(catalog), lambda m: F.array_contains(m["entity_types"], F.col("entity_type")))
    return spans.filter("entity_type is not null").withColumn("metric_name", F.explode(F.transform(fits, lambda m: m["metric_name"])))


def unmatched_spans(spans: DataFrame, catalog: DataFrame) -> DataFrame:
    """Spans that no requested span metric applies to, or that are invalid, with the reason."""
    known = F.exists(_span_metrics(catalog), lambda m: F.array_contains(m["entity_types"], F.col("entity_type")))
    category = (
        F.when(F.coalesce("span_id", F.lit("")) == "", "invalid_span")
        .when(F.coalesce("entity_type", F.lit("")) == "", "invalid_span")
        .when(~known, "no_matching_metrics")
    )
    return (
        spans.withColumn("skip_category", category)
        .filter(F.col("skip_category").isNotNull())
        .select(
            F.lit("ALL").alias("metric_name"),
            F.lit("span").alias("aggregation_level"),
            F.col("span_id").alias("entity_id"),
            "entity_type",
            "session_id",
            "skip_category",
        )
    )


def missing_requirements(session_inputs: DataFrame, requirements: dict[str, list[str]]) -> DataFrame:
    """Per session and metric, which required inputs are missing or empty. `session_inputs`
    has one column per input; empty text, zero and empty lists count as missing."""
    types = dict(session_inputs.dtypes)

    def absent(c: str) -> Column:
        if c not in types:
            return F.lit(True)
        kind = types[c]
        if kind.startswith(("array", "map")):
            return F.coalesce(F.size(c), F.lit(0)) <= 0
        if kind == "string":
            return F.coalesce(F.col(c), F.lit("")) == ""
        if kind == "boolean":
            return ~F.coalesce(F.col(c), F.lit(False))
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0

    checks = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric_name"),
                F.array_compact(F.array(*[F.when(absent(c), F.lit(c)) for c in needs])).alias("missing"),
            )
            for metric, needs in requirements.items()
        ]
    )
    return session_inputs.select("session_id", F.inline(checks)).withColumn(
        "valid", F.size("missing") == 0
    )
