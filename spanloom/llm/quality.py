"""Quality rules: a threshold table compiled into one projection of built-in functions.

The measures are column expressions over the whole text; a rule is a row (measure, low, high)
of a table; `quality_verdict` turns the table into one boolean column. Nothing is shuffled and
no user function runs. Repetition within a text is found by sorting the hashes of its word
windows, so the work per text is n log n at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    *("a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "not", "of", "on"),
    *("or", "that", "the", "this", "to", "was", "with", "you"),
    *("au", "dans", "des", "du", "elle", "en", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que"),
    *("qui", "sur", "un", "une"),
    *("auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sie", "und", "von", "zu"),
    *("al", "con", "de", "del", "el", "es", "los", "no", "para", "se", "su", "y"),
)


# A text of more bytes a character is in a script that the list has no words of.
OTHER_SCRIPT = 1.5


@dataclass(frozen=True)
class Rule:
    """A measure must lie between low and high; null bounds are open, a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 1.5, 15),
    Rule("symbol_ratio", None, 0.25),
    Rule("mark_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def let(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(hashes: Column, span: int) -> Column:
    """Words in windows whose hash occurs twice; `hashes` has one hash for each window in order."""

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(span)), F.lit(span)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

    def found(s: Column) -> Column:
        after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        twice = let(after, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda x, y: F.coalesce(x, F.lit(False)) | y))
        places = F.filter(F.zip_with(s, twice, lambda a, d: F.when(d, a["i"])), lambda i: i.isNotNull())
        return let(F.array_sort(places), covered)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.coalesce(let(F.array_sort(pairs), found), F.lit(0))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs` and the measures, each named with `prefix`: n_words, word_chars
    (code points in words), n_symbols, n_marks (exclamation and question marks), n_lines (lines
    with a word), n_dup_lines (those equal to an earlier one), n_repeat_words (words in 3-word
    windows that occur twice or more), n_stop_words, other_script, and the ratios of the rules. No
    measure falls or grows with length alone; the share of stop words is null in other scripts, and so
    judges only texts in Latin letters.

    A null text counts as empty. Counts of empty and wordless texts are 0, their ratios null.
    Columns of `docs` with the name of a measure are replaced."""
    name = f"{prefix}{{}}".format
    body, words, lines, hashes = (f"__{x}" for x in ("body", "words", "lines", "hashes"))
    out = docs.withColumn(body, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    out = out.withColumn(words, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    out = out.withColumn(lines, F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)))
    grams = F.zip_with(
        F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(words, 3, F.greatest(F.size(words), F.lit(1))),
        lambda x, c: F.xxhash64(x["a"], x["b"], c),
    )
    out = out.withColumn(hashes, F.slice(grams, 1, F.greatest(F.size(words) - 2, F.lit(0))))
    without = lambda marks: F.char_length(body) - F.char_length(F.translate(body, marks, ""))
    n = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": without(SYMBOLS).cast("long"),
        "n_marks": without("!?").cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _repeat_words(F.col(hashes), 3)
        ),
        "other_script": F.octet_length(body) > OTHER_SCRIPT * F.char_length(body),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    }
    # Unfolded from one row, so that a filter on the measures stays above and they are worked out once.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in {name(k) for k in n}]
    out = out.select(*others, F.inline(F.array(F.struct(*[v.alias(name(k)) for k, v in n.items()]))))
    c = lambda x: F.col(f"`{name(x)}`")
    per = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    return out.withColumns(
        {
            name("mean_word_chars"): per("word_chars", "n_words"),
            name("symbol_ratio"): per("n_symbols", "n_words"),
            name("mark_ratio"): per("n_marks", "n_words"),
            name("stop_word_ratio"): F.when(~c("other_script"), per("n_stop_words", "n_words")),
            name("dup_line_ratio"): per("n_dup_lines", "n_lines"),
        }
    )


def quality_verdict(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """True where all rules hold. A measure that is null breaks no rule."""
    out = F.lit(True)
    for r in rules:
        m = F.col(f"`{prefix}{r.measure}`")
        for broken in ([m < r.low] if r.low is not None else []) + ([m > r.high] if r.high is not None else []):
            out = out & ~F.coalesce(broken, F.lit(False))
    return out


def base_failed(prefix: str = "", least_words: int = 50, repeat_percent: int = 50) -> Column:
    """Too short, or too much of it repeated."""
    n, repeated = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < least_words) | (100 * repeated > repeat_percent * n)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that neither fail the base rules nor the table, columns unchanged.
    Null, empty and wordless texts are too short; repeated rows are judged alike."""
    own = "__quality_"
    out = measured(docs, text, own)
    return out.where(~base_failed(own) & quality_verdict(rules, own)).select(*[F.col(f"`{c}`") for c in docs.columns])
