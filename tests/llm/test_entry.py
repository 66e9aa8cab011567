"""The entry names every dealt operator: its guard must not hide a fault in this subpackage."""

import re

import __spark_entry__


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names
