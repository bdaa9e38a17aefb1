"""Text predicates that keep routing chatter out of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_control_message(text: Column, min_length: int) -> Column:
    """Routing JSON, very short texts and remarks about words rather than answers."""
    low = F.lower(text)
    size = F.length(text)
    routing_word = low.contains("next") | low.contains("finish")
    return (
        text.startswith('{"next":')
        | text.startswith("{'next':")
        | (size < min_length)
        | low.contains("text contains")
        | low.startswith("the word ")
        | (low.startswith("the ") & (size < 50) & routing_word)
        | low.isin("next", "finish")
        | low.endswith(" is mentioned.")
        | low.endswith(" is present.")
        | (low.contains("mentioned") & (size < 100) & routing_word)
    )


def is_system_content(text: Column) -> Column:
    """The stricter form used by evaluation fallbacks; empty counts as system text."""
    bare = F.trim(text)
    low = F.lower(bare)
    routing_word = low.contains("next") | low.contains("finish")
    return F.coalesce(
        bare.startswith('{"next":')
        | (F.length(bare) < 10)
        | low.contains("text contains")
        | low.startswith("the word ")
        | (low.contains("mentioned") & routing_word),
        F.lit(True),
    )
