"""The functions on single values, without Spark."""

import pytest

from mailsieve import cases


@pytest.mark.parametrize("name", sorted(cases.SHAPES))
def test_shapes(name):
    make, pairs = cases.SHAPES[name]
    fill = lambda x: None if x is None else x.replace("@", "37").replace("(at)", "@")
    for given, wanted in pairs:
        assert make(fill(given)) == fill(wanted), given
