"""One query for each operator, and the pipeline."""

import re


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    for n in range(1, 14):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names
