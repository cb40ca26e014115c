"""Arms of C conditions behind the first one."""

import pytest

from lodestrata.llm.grammars import parse

F = "int f(int x)\n{\n%s\n    return x;\n}\n"


@pytest.mark.parametrize(
    "body, valid",
    [
        ("#ifdef A\n    x = 1;\n#else\n    x = ;\n#endif", False),
        ("#ifdef A\n    x = 1;\n#elif B\n    x = 2;\n#else\n<<<<<<< HEAD\n    x = 3;\n=======\n    x = 4;\n>>>>>>> b\n#endif", False),
        ("#if A\n    x = 1;\n#else\n#if B\n    x = 2;\n#else\n    x = (3;\n#endif\n#endif", False),
        ("#if A\n    x = 1;\n#else\n#if B\n    x = (2;\n#else\n    x = 3;\n#endif\n#endif", False),
        ("#ifdef A\n    x = 1;\n#else\n    x = 2;\n#endif", True),
        ("#ifdef A\n    if (x) {\n#else\n    while (x) {\n#endif\n    x--;\n    }", True),
        ("#ifdef A\n    if (x) {\n#else\n    x = 1;\n#endif\n    x--;\n#ifdef A\n    }\n#endif", True),
        ("#ifdef A\n    x = 1;\n#else\n#error no A\n#endif", True),
    ],
)
def test_every_arm_is_parsed(body, valid):
    assert parse((F % body).encode(), "c")[0] is valid
