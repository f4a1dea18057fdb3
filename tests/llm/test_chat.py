"""Chat formatting: round trips, loss masks, turn order, nulls and repeats."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowset.llm import chat

T = chat.Template()
PIECES = [*T.controls, *[c[0] + "\\" + c[1:] for c in T.controls], "\\", "<", "[", "</", "INST]", ">", "text", " ", "\n", "é", "<<", "|>"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(TEXT)
@settings(max_examples=500, deadline=None)
def test_escape(text):
    safe = T.escape(text)
    assert T.unescape(safe) == text
    assert not any(c in safe for c in T.controls)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT), TEXT), max_size=6))
@settings(max_examples=300, deadline=None)
def test_parse_gives_turns_back(turns):
    segments = [s for r, t in turns for s in T.segments(r, t)]
    assert T.parse("".join(t for t, _ in segments)) == turns
    assert [T.unescape(t) for t, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 1, "assistant", "first"), (2, 0, "assistant", "zero"),
    (3, 0, "system", "s"), (3, 1, "user", "u"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, None, "tool", "n"), (4, 5, None, "no role"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found" * 20000),
]


def test_table(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by: dict = {}
    for c, turn, role, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(s) for a, b in turns for s, _ in T.segments(a, b))
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chunks_of_a_long_conversation(spark):
    """A conversation dealt out in chunks gets the states, places and digests of one that isn't."""
    rows = [(5, t, ["user", "assistant", "tool", "system"][t * t * 7 % 5 % 4], f"text {t}") for t in range(200)] + [(5, None, "system", "first"), (6, 3, "user", "u"), (6, 90, "assistant", "a"), (None, 0, "user", "u"), (None, 50, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (chat.format_turns(df, chunk_turns=n) for n in (10**6, 7))
    order = lambda d: sorted(((r["conv_id"], r["turn"], r["role"], r["in_order"]) for r in d.collect()), key=str)
    assert order(whole) == order(cut)
    assert sorted(map(str, chat.read_back(whole).collect())) == sorted(map(str, chat.read_back(cut).collect()))
    assert {r["conv_id"]: r["valid"] for r in chat.read_back(cut).collect()} == {5: False, 6: True, None: True}


@pytest.mark.parametrize("roles", [{"a": ("x", "</a>")}, {"a": ("<a>", "<b"), "b": ("<a>", "</b>")}, {"a": ("<<x", "</a>"), "b": ("<x>", "</b>")}, {"a": ("<a>", "<a>")}, {"a": ("<a\\>", "</a>")}, {"a": ("<", "</a>")}])
def test_ambiguous_templates_are_errors(roles):
    with pytest.raises(ValueError):
        chat.Template(roles={k: chat.Role(*v) for k, v in roles.items()})
