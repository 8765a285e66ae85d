"""Small inline inputs for operators that the driver's prose tables do not exercise."""

CODE = [
    (0, "src/add.py", "def add(a, b):\n    # adds\n    if a > b:\n        return a\n    return a + b\n"),
    (1, "tests/test_add.py", 'import pytest\n\ndef test_add():\n    """Adds.\n    Twice.\n    """\n    assert add(1, 2) == 3\n'),
    (2, "lib/app.ts", "export class A {\n  run(x: number) {\n    for (let i = 0; i < x; i++) {\n      if (i && x) { call(i); }\n    }\n  }\n}\n"),
    (3, "dist/app.min.js", "var a=1;"),
    (4, "lib/gen.js", "// @generated by a tool\nconst x = () => 1;\n"),
    (5, "lib/long.js", "x" * 700),
    (6, "lib/wide.js", "\n".join("y" * 170 for _ in range(3))),
    (7, "lib/empty.py", ""),
    (8, "lib/blank.py", " \n\t\n"),
    (9, "lib/bad.py", "def f(:\n    return 'x\n"),
    (10, "lib/bad.js", "function f( { return [1, 2); }"),
    (11, "lib/str.js", 'const s = "a\\"b'),
    (12, "spec/deep.py", "class A:\n    async def f(self):\n        while True:\n            try:\n                await g()\n            except E:\n                pass\n"),
    (13, "lib/block.js", "/* one\n two\n three */\nlet a = 1;\n* star\nlet b = 2;\n/* x */\n"),
]
EDITS = [
    (0, "a = 1\nb = 2\n", "[src/a.py]\n<search>\na = 1\n<replace>\na = 5\n<diff_end>"),
    (1, "a = 1\nb = 2\n", "<search>\nb = 2\n<replace>\nb = 3\n<diff_end> and <search>a = 1<replace>a = 2<diff_end>"),
    (2, "x\nx\n", "File: lib/x.ts\n<search>\nx\n<replace>\ny\n<diff_end>"),
    (3, "abc", "no edit here"),
    (4, "l1\r\nl2\r\n", "<search>\r\nl1\r\nl2\n<replace>\nm\n<diff_end>"),
]
CALLS = [
    (0, '{"dialect": "PostgreSQL", "operation": " Insert ", "table": " users ", "constraints": {"a": 1}}'),
    (1, '{"dialect": "oracle", "operation": "select", "table": "t", "constraints": {}}'),
    (2, '{"dialect": "sqlite", "operation": "merge", "table": "t", "constraints": {}}'),
    (3, '{"dialect": "sqlite", "operation": "select"}'),
    (4, "not json at all"),
    (5, "[1, 2]"),
    (6, '{"dialect": "mysql", "operation": "update", "table": "  ", "constraints": {}}'),
    (7, '{"dialect": "mysql", "operation": "update", "table": 5, "constraints": {}}'),
    (8, '{"dialect": "mariadb", "operation": "drop", "table": "t", "constraints": null}'),
    (9, '{"dialect": "mariadb", "operation": "drop", "table": "t", "constraints": [1]}'),
]
TAGGED = [
    (0, "<think>a</think><code>\nx = 1\n</code>"),
    (1, "<think>a<code>b"),
    (2, "text ```python\ny = 2\n``` more"),
    (3, "plain \t text\n"),
    (4, "<tool_call>{}</tool_call><tool_call><tool_response>"),
    (5, "```\nz\n```"),
    (6, "<code></code> then ```js\nq\n```"),
    (7, ""),
]
