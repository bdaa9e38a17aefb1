"""Fixed values that results depend on."""

ENTITY_TYPES = ["agent", "tool", "llm", "workflow", "graph", "task"]
AGGREGATION_LEVELS = ["span", "session", "agent", "population"]
STORED_SCOPES = ["session", "span"]

DEFAULT_APP_NAME = "unknown-app"
DEFAULT_FILE_SESSION = "file_session_default"

# Words that mark an output as failed.
ERROR_WORDS = ["traceback", "exception", "httperror"]

# Span names of the transport metrics.
TRANSPORT_METRIC_NAMES = [
    "connection_events",
    "connection_latency",
    "chain_completion_time",
    "error_rates",
]

# Words counted when an agent's role is worked out.
COORDINATION_WORDS = [
    "next", "finish", "delegate", "route", "assign", "worker", "task", "supervisor",
    "coordinator", "orchestrator", "manager", "dispatch", "workflow", "control", "manage",
]
PROCESSING_WORDS = [
    "calculate", "compute", "analyze", "process", "research", "find", "search", "generate",
    "create", "write", "code", "execute", "run", "solve", "build", "implement", "develop",
]
JSON_MARKS = ["{", "}", '"next"', '"finish"', '"action"', '"response"']
COMPUTING_TOOL_WORDS = [
    "repl", "python", "code", "execute", "compute", "calculator", "terminal", "bash",
    "shell", "sql", "database",
]

# Metric, label for 0, label for 1.
GRADE_LABELS = [
    ("ComponentConflictRate", "not_conflicted", "conflicted"),
    ("Consistency", "not_consistent", "consistent"),
    ("ContextPreservation", "context_not_preserved", "context_preserved"),
    ("GoalSuccessRate", "goal_not_achieved", "goal_achieved"),
    ("Groundedness", "not_grounded", "grounded"),
    ("InformationRetention", "information_not_retained", "information_retained"),
    ("IntentRecognitionAccuracy", "intent_not_recognized", "intent_recognized"),
    ("ResponseCompleteness", "response_not_complete", "response_complete"),
    ("WorkflowCohesionIndex", "workflow_not_cohesive", "workflow_cohesive"),
    ("TaskDelegationAccuracy", "delegation_not_accurate", "delegation_accurate"),
    ("ToolUtilizationAccuracy", "tool_usage_incorrect", "tool_usage_correct"),
    ("Hallucination", "not_hallucinated", "hallucinated"),
    ("AnswerRelevancyMetric", "not_relevant", "relevant"),
    ("RoleAdherenceMetric", "role_not_adherent", "role_adherent"),
    ("TaskCompletionMetric", "task_not_completed", "task_completed"),
    ("ConversationCompletenessMetric", "conversation_not_complete", "conversation_complete"),
    ("BiasMetric", "not_biased", "biased"),
    ("GroundednessMetric", "not_grounded", "grounded"),
    ("TonalityMetric", "tone_not_aligned", "tone_aligned"),
    ("ToxicityMetric", "not_toxic", "toxic"),
    ("GeneralStructureAndStyleMetric", "structure_not_met", "structure_met"),
]

REFERENCE_TOPICS = ["technology", "science", "business", "math"]

# What a relevancy case shows where a session has no such text.
NO_USER_INPUT = "[FALLBACK] No meaningful user input found in session data"
NO_FINAL_RESPONSE = "[FALLBACK] No meaningful final response found in session data"

# What is cut from the ends of a judge reply.
FENCE_START = r"^```[a-zA-Z]*\n?"
FENCE_END = r"```$"
