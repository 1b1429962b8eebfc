from __future__ import annotations

import pytest
from loomwork.functions.regex import literal_of
from loomwork.functions.rules import ENGINE_RULES, STATEMENTS


@pytest.mark.parametrize(
    ("pattern", "need"),
    [(r"\bSET\s+hive\.\w+", "hive."), (r"a|b", ""), (r"(abc)def", "def"), (r"abcd?e", "abc"), (r"x[abc]yz", "yz"), (r"ab*", "a"), (r"\.read\s*\.\s*(csv|json)\s*\(", ".read"), (r"ab{2}cd", "cd"), ("", "")],
)
def test_literal(pattern, need):
    assert literal_of(pattern) == need


def test_nearly_every_rule_has_one():
    assert all(len(literal_of(p)) > 1 for _, p, _ in ENGINE_RULES)
    assert [k for k, p in STATEMENTS if len(literal_of(p)) < 2] == ["join", "describe"]
