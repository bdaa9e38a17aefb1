"""Column helpers for text, JSON, numbers and ids. All stay inside Catalyst except the
nested-key search and the quote-swap fallback, which are Arrow-batched."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.constants import ERROR_WORDS, FENCE_END, FENCE_START

# A JSON string token: keys are consumed up to their colon, values captured.
_STRING_TOKENS = r'"(?:[^"\\]|\\.)*+"\s*+:|"((?:[^"\\]|\\.)*+)"'


def truthy(c: Column) -> Column:
    """The text, or null where it is empty: empty text counts as missing everywhere."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Text without any white space (not just blanks) around it."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def decoded_text(c: Column) -> Column:
    """A JSON string as its text; every other value as it stands."""
    plain = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(c.startswith('"'), F.coalesce(plain, c)).otherwise(c)


def attr(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def whole_number(c: Column) -> Column:
    """bigint for text that spells a whole number, else null ('12.0' is not whole)."""
    return F.when(c.rlike(r"^\s*[-+]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))


# What JSON can look like from its two ends: spares the parser (and an exception per row)
# on plain text, which is what most unparsable payloads are.
_JSON_SHAPE = r'(?s)^\s*(?:\{.*\}|\[.*\]|".*"|-?[0-9][-+.0-9eE]*|true|false|null)\s*$'


def lenient_json(c: Column) -> Column:
    """Parsed variant, or null for empty, cut-off or otherwise invalid text."""
    return F.when(c.rlike(_JSON_SHAPE), F.try_parse_json(c))


def json_is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{") & lenient_json(c).isNotNull(), F.lit(False))


def _json_null(c: Column) -> Column:
    return F.trim(c) == F.lit("null")


def payload(raw: Column, parses: Column) -> Column:
    """A payload as the JSON text of an object; `parses` says whether the text is JSON. Text
    that is not is wrapped as {"value": text}, other JSON values as {"value": json}."""
    wrapped_text = F.to_json(F.struct(raw.alias("value")))
    return (
        F.when(raw.isNull(), F.lit(None))
        .when(~parses | _json_null(raw), wrapped_text)
        .when(F.ltrim(raw).startswith("{"), raw)
        .otherwise(F.concat(F.lit('{"value":'), F.trim(raw), F.lit("}")))
    )


def error_words_in_payload(raw: Column, parses: Column, entity_type: Column) -> Column:
    """Error words in an output payload: among the string values of an object, in plain text,
    or (for workflows) in a bare JSON string. Top-level lists and numbers are not searched."""
    head = F.ltrim(raw)
    structured = head.startswith("{") | ((entity_type == "workflow") & head.startswith('"'))
    maybe = has_error_words(raw) | raw.contains("\\u")
    found = F.when(~parses | _json_null(raw), has_error_words(raw)).otherwise(
        structured & json_has_error_words(raw)
    )
    return F.coalesce(F.when(maybe, found).otherwise(False), F.lit(False))


def string_values(json_text: Column) -> Column:
    """Every string value (not key) of a JSON text, at any depth."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text)
    return F.regexp_extract_all(canonical, F.lit(_STRING_TOKENS), F.lit(1))


def has_error_words(text: Column) -> Column:
    return F.lower(text).rlike("|".join(ERROR_WORDS))


def json_has_error_words(json_text: Column) -> Column:
    """Error words among the string values of a JSON text. The cheap test on the whole
    text goes first, so that the tokeniser only sees the few texts that may match."""
    maybe = has_error_words(json_text) | json_text.contains("\\u")
    return F.coalesce(
        F.when(maybe, F.exists(string_values(json_text), has_error_words)).otherwise(False),
        F.lit(False),
    )


def map_has_error_words(values: Column) -> Column:
    """The same over the decoded values of a text map (model completions)."""
    return F.coalesce(
        F.exists(
            F.map_values(values),
            lambda v: has_error_words(v)
            & F.when(
                lenient_json(v).isNotNull(),
                F.exists(string_values(v), has_error_words),
            ).otherwise(True),
        ),
        F.lit(False),
    )


# --- ids ------------------------------------------------------------------------------


def uuid_part(session_id: Column) -> Column:
    """The text after the last '_' when it has 36 characters and four dashes."""
    tail = F.substring_index(session_id, "_", -1)
    dashes = F.length(tail) - F.length(F.replace(tail, F.lit("-")))
    looks_like_uuid = session_id.contains("_") & (F.length(tail) == 36) & (dashes == 4)
    return F.when(looks_like_uuid, tail).otherwise(session_id)


def split_session_id(session_id: Column) -> tuple[Column, Column]:
    """(uuid, app name) around the last underscore, or (id, default name) without one."""
    tail = F.substring_index(session_id, "_", -1)
    cut = F.length(session_id) - F.length(tail) - 1
    has = session_id.contains("_")
    uuid = F.when(has, tail).otherwise(session_id)
    app = F.when(has, F.substring(session_id, F.lit(1), cut)).otherwise("unknown-app")
    return uuid, app


def second_part(session_id: Column) -> Column:
    """The second '_' part, empty text when there is none."""
    return F.split_part(session_id, F.lit("_"), F.lit(2))


# --- scores ---------------------------------------------------------------------------


def per_call(total: Column, calls: Column) -> Column:
    return F.when(calls > 0, total / calls).otherwise(F.lit(0.0))


def probability(logprob: Column) -> Column:
    return F.exp(logprob)


def utc_bound(text: str) -> str:
    """Check a time bound given by a caller: ISO 8601 with the UTC mark."""
    try:
        stamp = pd.Timestamp(text) if text else None
    except ValueError:
        stamp = None
    if stamp is None or not text.endswith("Z") or "T" not in text:
        raise ValueError(f"time bound must be ISO 8601 in UTC, got {text!r}")
    return text


def utc_time(text: Column) -> Column:
    """The same check on a column: null where the text is not ISO 8601 in UTC."""
    well_formed = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$")
    return F.when(well_formed, text.try_cast("timestamp"))


# --- nested JSON ----------------------------------------------------------------------


def _find_in_order(node, key):
    """First value of the key in document order; a match is not searched further."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            return top[0]
        if isinstance(top, dict):
            stack.extend((v,) if k == key else v for k, v in reversed(top.items()))
        elif isinstance(top, list):
            stack.extend(reversed(top))
    return None


def _find_own_first(node, key):
    """First value of the key, a node's own keys before its children."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, dict):
            if key not in top:
                stack.extend(reversed(top.values()))
            elif top[key] is not None:
                return top[key]
        elif isinstance(top, list):
            stack.extend(reversed(top))
    return None


def _find_below(node, key):
    """Like own-first, but a list inside a list is not entered (judge replies)."""
    stack = [node]
    while stack:
        top = stack.pop()
        if not isinstance(top, dict):
            continue
        if key in top:
            if top[key] is not None:
                return top[key]
            continue
        inner = []
        for value in top.values():
            inner.extend(value if isinstance(value, list) else [value])
        stack.extend(reversed(inner))
    return None


_SEARCH = {"document": _find_in_order, "own_first": _find_own_first, "reply": _find_below}


def find_key(json_text: Column, key: str, order: str = "document") -> Column:
    """The first value stored under `key` anywhere in a JSON text, as JSON text; null where the
    text is no JSON or nested beyond what a parser takes. Rows whose text does not name the key
    never reach Python, nor do objects that hold it at the top and name it only there."""
    search = _SEARCH[order]

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                found = search(json.loads(text), key)
                return None if found is None else json.dumps(found)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    # A top-level scalar under a key that is named once needs no search.
    once = F.regexp_count(json_text, F.lit(f'"{key}"')) == 1
    plain = F.try_parse_json(F.when(once & json_text.startswith("{"), json_text))
    top = F.to_json(F.try_variant_get(plain, f"$.{key}", "variant"))
    scalar = F.when(top.rlike(r'^(true|false|"[ !#-\[\]-~]*"|-?[0-9]{1,15})$'), top)
    return F.coalesce(scalar, find(F.when(json_text.contains(f'"{key}"') & scalar.isNull(), json_text)))


def strip_fences(text: Column) -> Column:
    """A judge reply without the code fence around it."""
    opened = F.regexp_replace(F.trim(text), FENCE_START, "")
    return F.regexp_replace(opened, FENCE_END, "")


def reply_json(text: Column) -> Column:
    """A judge reply as JSON text: fences off, JSON as is, a Python literal converted,
    anything else null."""

    @F.pandas_udf("string")
    def from_literal(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(ast.literal_eval(text))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one)

    bare = strip_fences(text)
    parsed = F.try_parse_json(bare).isNotNull()
    return F.coalesce(F.when(parsed, bare), from_literal(F.when(~parsed, bare)))
