"""Definitions in source files and their changes."""

from palimpsest.operators import source_code

OLD = """import x

def first(a):
    return a

class Thing:
    def method(self):
        pass
pub async fn other() {
}
"""
NEW = """import x

class Thing:
    def method(self):
        return 1
def first(a):
    return a

def added():
    pass
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_definitions(spark):
    got = {(r.kind, r.name): (r.first_line, r.last_line, r.n) for r in source_code.definitions(files(spark, ("a.py", OLD), ("b.py", None), ("c.py", ""))).collect()}
    assert got == {("function", "first"): (3, 5, 1), ("class", "Thing"): (6, 6, 1), ("function", "method"): (7, 8, 1), ("function", "other"): (9, 11, 1)}


def test_changes(spark):
    old, new = (source_code.definitions(files(spark, ("a.py", t), ("same.py", "def x():\n  1"))) for t in (OLD, NEW))
    got = {r.path: tuple(r)[1:] for r in source_code.changes(old, new).collect()}
    assert got == {"a.py": (True, "added", "other", "method", 2), "same.py": (False, "", "", "", 1)}
