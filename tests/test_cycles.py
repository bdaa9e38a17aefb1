import random

import pytest

from spanloom.operators.cycles import count_cycles_long
from spanloom.operators.metrics import count_cycles, cycles
from tests.conftest import agent, tool


def _naive(seq, shortest=2):
    n, at, found = len(seq), 0, 0
    while at < n:
        lengths = [k for k in range(shortest, (n - at) // 2 + 1) if seq[at : at + k] == seq[at + k : at + 2 * k]]
        found += bool(lengths)
        at += lengths[0] if lengths else 1
    return found


def _sequences():
    rnd = random.Random(7)
    out = [[], ["a"], list("abab"), list("aaaaaaaaa"), list("abcabcabc"), list("aab" * 9), list("abcd" * 3 + "abab")]
    for letters in ("ab", "abc", "abcde"):
        out += [[rnd.choice(letters) for _ in range(rnd.randrange(2, 60))] for _ in range(12)]
    out.append([rnd.choice("abcdefgh") for _ in range(20)] * 5)
    return out


@pytest.mark.parametrize("seq", _sequences())
def test_scan_matches_the_definition(seq):
    assert count_cycles(seq) == _naive(seq)


def test_join_form_matches_the_scan(spark):
    seqs = [s for s in _sequences() if s]
    rows = [(f"g{i}", n, name) for i, s in enumerate(seqs) for n, name in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, n int, entity_name string")
    got = {r["g"]: (r["n_events"], r["cycles"]) for r in count_cycles_long(df, ["g"], ["n"]).collect()}
    assert got == {f"g{i}": (len(s), _naive(s)) for i, s in enumerate(seqs)}


def test_names_a_b_a_b_are_one_cycle(spans):
    acts = [agent("A"), tool("B"), agent("A"), tool("B")]
    assert [r["cycles"] for r in cycles(spans(acts)).collect()] == [1]


def test_hot_session_takes_the_join_form(spark, spans, small_groups):
    rnd = random.Random(3)
    names = [rnd.choice("ABC") for _ in range(40)]
    acts = [tool(n, session="hot") for n in names] + [tool("A", session="cold"), tool("B", session="cold")]
    got = {r["session_id"]: (r["n_events"], r["cycles"]) for r in cycles(spans(acts)).collect()}
    assert got == {"hot": (40, _naive(names)), "cold": (2, 0)}
