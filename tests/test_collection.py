"""Both suites are collected together: test files have names of their own."""

import pathlib
from collections import Counter

HERE = pathlib.Path(__file__).parent


def test_no_two_test_files_share_a_name():
    names = Counter(p.name for p in HERE.rglob("test_*.py"))
    assert max(names.values()) == 1 and {"test_operators.py", "test_queries.py"} <= set(names)
