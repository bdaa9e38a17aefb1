"""License scans: exact phrases, and short notices within a bounded number of edits.

A notice that occurs with at most k edits, cut into k + 1 pieces, has a piece without an edit.
One pass of an Aho-Corasick automaton over the folded text finds the phrases and all pieces; only
around a piece does the regex library match the whole notice with at most k errors. The folded
text is the lower-case letter words joined by single spaces; texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.rows import ROW, packed, schema_with, unpacked
from spanloom.llm.words import LETTERS_ANY_CASE, texts


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int


# The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices of common licenses, folded, with the edits that are allowed.
NOTICES = (
    Notice("gpl", "gnu general public license", 2),
    Notice("apache", "apache license", 1),
    Notice("mit", "mit license", 1),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("bsd", "bsd license", 1),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms", 7),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("public-domain", "dedicated to the public domain", 2),
    Notice("all-rights-reserved", "all rights reserved", 1),
)

_FOLD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if LETTERS_ANY_CASE[c] else 32 for c in range(256)
)


def fold(raw: bytes) -> str:
    """Letter words in lower case (A-Z), joined by one space, between two spaces; one character
    for each byte."""
    words = raw.translate(_FOLD).split()
    return " " + b" ".join(words).decode("latin-1") + " " if words else ""


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(place, text) of the k + 1 pieces of a notice, of nearly equal length."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: tuple[Notice, ...]):
        self.phrases, self.notices = phrases, notices
        self.patterns = [
            regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.text)}){{e<={n.edits}}}(?= )") for n in notices
        ]
        self.tree = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for phrase in phrases:
            found.setdefault(f" {phrase} ", []).append((-1, phrase))
        for i, n in enumerate(notices):
            for place, piece in pieces(n):
                found.setdefault(piece, []).append((i, place))
        for text, what in found.items():
            self.tree.add_word(text, (len(text), what))
        self.tree.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int]]]:
        """Exact: (place of the phrase, phrase). Fuzzy: (label, start, end, edits)."""
        exact: list[tuple[int, str]] = []
        around: dict[int, list[tuple[int, int]]] = {}
        for end, (length, what) in self.tree.iter(text):
            start = end - length + 1
            for i, place in what:
                if i < 0:
                    exact.append((start + 1, place))
                else:
                    k, n = self.notices[i].edits, len(self.notices[i].text)
                    zone = (max(0, start - place - k - 1), start - place + n + k + 1)
                    zones = around.setdefault(i, [])
                    if zones and zone[0] <= zones[-1][1]:
                        zones[-1] = (zones[-1][0], max(zones[-1][1], zone[1]))
                    else:
                        zones.append(zone)
        fuzzy = []
        for i, zones in around.items():
            for a, b in zones:
                for m in self.patterns[i].finditer(text, a, min(b, len(text))):
                    fuzzy.append((self.notices[i].label, m.start(), m.end(), sum(m.fuzzy_counts)))
        return exact, fuzzy


_SPAN = "struct<label:string,first_word:long,last_word:long,edits:int,text:string>"


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    notices: tuple[Notice, ...] = NOTICES,
    returned: list[str] | None = None,
) -> DataFrame:
    """The columns `returned` (default: all) of each row of `docs`, and n_words, places (label and
    word of each exact phrase), notices (spans matched with edits: label, first and last word,
    edits, folded text) and score (1 for an exact phrase; else the best notice's share of
    characters without an edit; else 0).

    Null, empty and wordless texts have no words and score 0; repeated rows come out alike; an
    empty table gives an empty result; columns named like the four new ones are replaced."""
    new = ("n_words", "places", "notices", "score")
    carried = [c for c in returned or docs.columns if c not in new]
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        for batch in batches:
            counts, places, spans, scores = [], [], [], []
            for lo, hi, data, offsets in texts(batch.column("__text")):
                for t in range(hi - lo):
                    body = fold(data[offsets[t] : offsets[t + 1]].tobytes())
                    exact, fuzzy = scanner.scan(body)
                    blanks = np.flatnonzero(np.frombuffer(body.encode("latin-1"), np.uint8) == 32) if exact or fuzzy else None
                    word = lambda at, blanks=blanks: int(np.searchsorted(blanks, at)) - 1
                    counts.append(max(0, body.count(" ") - 1))
                    places.append([{"label": phrases[p], "word": word(at)} for at, p in exact])
                    spans.append(
                        [
                            {"label": name, "first_word": word(a), "last_word": word(b), "edits": e, "text": body[a:b].encode("latin-1").decode("utf-8", "replace")}
                            for name, a, b, e in fuzzy
                        ]
                    )
                    best = max((1 - e / max(1, b - a) for _, a, b, e in fuzzy), default=0.0)
                    scores.append(1.0 if exact else best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(spans, span_type), pa.array(scores, pa.float64())],
                names=[ROW, *new],
            )

    rows = docs.select(packed(carried), F.col(f"`{text}`").cast("string").alias("__text"))
    own = f"n_words long, places array<struct<label:string,word:long>>, notices array<{_SPAN}>, score double"
    return unpacked(rows.mapInArrow(run, schema_with(rows, own)), carried, list(new))
