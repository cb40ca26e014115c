"""Signatures of any length that documentation may merely repeat."""

import pytest

from lodestrata.llm.docpairs import documented

NAMES = [f"filler{'x' * k}" for k in range(1, 40)] + ["walrus", "penguin"]


@pytest.mark.parametrize("said, n", [("walrus penguin", 0), ("walrus giraffe", 1)])
def test_parameters_behind_600_bytes_are_known(said, n):
    go = "package a\n\n// Fill " + said + ".\nfunc Fill(\n\t" + ",\n\t".join(f"{x} int" for x in NAMES) + ",\n) int {\n\treturn 1\n}\n"
    py = "def fill(\n    " + ",\n    ".join(NAMES) + ',\n):  # noqa\n    """Fill ' + said + '."""\n    giraffe = 1\n'
    assert len({d[3] for d in documented(go.encode(), "go")}) == n
    assert len({d[3] for d in documented(py.encode(), "python")}) == n
