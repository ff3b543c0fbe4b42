from datetime import UTC, datetime

import pytest

from shelfmark.functions.text import fold, highlights
from shelfmark.plans import language as L

NOW = datetime(2024, 3, 31, 12, tzinfo=UTC)


def test_precedence():
    a, b, c = (L.Contains(x) for x in "abc")
    assert L.parse("a b | c") == L.And((a, L.Or((b, c))))
    assert L.parse("!a | b") == L.Or((L.Not(a), b))
    assert L.parse("<a b> | c") == L.Or((L.And((a, b)), c))
    assert L.parse('"a|b !c"') == L.Contains("a|b !c")
    assert L.parse("") == L.All()


@pytest.mark.parametrize("text", ["a |", "<a", "a>", '"x', "unknown:x", "size:bad", "size:9..1", "dm:garbage", 'regex:"["', "!", "case:", "!" * 100, "a" * 4097, "dupe:colour", "content:", ":x", 'regex:"(?=a)"'])
def test_errors(text):
    with pytest.raises(L.QueryError):
        L.parse(text, now=NOW)


def test_terms():
    assert L.parse("foo*") == L.Affix("foo", True)
    assert L.parse("*.rs") == L.Affix(".rs", False)
    assert L.parse("*x*") == L.Contains("x")
    assert L.parse("size:>=1kb") == L.Within("size", 1024, None)
    assert L.parse("size:>1kb") == L.Within("size", 1025, None)
    assert L.parse("ext:.a;b") == L.Ext(("a", "b"))
    assert L.parse("parent:/home/") == L.Parent("/home")
    assert L.parse("dm:2026-10-07") == L.Within("modified", 1791331200, 1791417599)
    assert L.parse("dm:last1months", now=NOW).low == int(datetime(2024, 2, 29, 12, tzinfo=UTC).timestamp())
    assert L.highlight_terms(L.parse("École !x a*")) == ["a", "ecole"]


def test_fold():
    assert fold("Știință École Straße ŁØı") == "stiinta ecole strasse loi"
    assert fold("ΣΑΣ") == "σασ"
    assert highlights("École cole", ["cole"]) == [(1, 5), (6, 10)]
