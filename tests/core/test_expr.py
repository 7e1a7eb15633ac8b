"""The condition language: trees, compile-time errors, and values in rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import expr as X


def value(spark, source, on_error="raise"):
    df = spark.createDataFrame(
        [("eu", 3, True, {"rows": 10, "bad": 0}, ["a", "b"], [3, 1, 2], "Hello", {"b": 2, "a": 1}, [], None)],
        "region string, n long, flag boolean, load map<string,long>, tags array<string>, xs array<long>, text string, obj map<string,long>, empty array<long>, nothing string",
    ).withColumn("params", F.struct("region", "n", "flag")).withColumn("results", F.struct("load"))
    return df.select(X.Compiler(X.environment(df), on_error=on_error).compile(source).col.alias("v")).first().v


CASES = {
    "1 + 2 * 3": 7, "(1 + 2) * 3": 9, "7 // 2": 3, "7 // -2": -4, "-7 // 2": -4, "7 % -3": -2, "-7 % 3": 2, "7 / 2": 3.5, "7.5 // 2": 3.0, "-7.5 % 2": 0.5,
    "2 - 3 - 4": -5, "--3": 3, "+3": 3, "not true": False, "not 0": True, "not not 'x'": True, "1 == 1.0": True, "true == 1": False, "null == null": True, "null == 0": False,
    "'a' < 'b'": True, "2 >= 2": True, "'a' + 'b'": "ab", "[1] + [2]": [1, 2], "null ?? 3": 3, "0 ?? 3": 0, "nothing ?? 'x'": "x", "n and 5": 5, "0 and 5": 0, "0 or 5": 5, "n or 5": 3,
    "'el' in 'hello'": True, "2 in xs": True, "9 not in xs": True, "'a' in obj": True, "true in [1, 2]": False, "params.region == 'eu' and params.n > 2": True, "results.load.rows > 5": True,
    "results['load']['rows']": 10, "xs[0]": 3, "xs[-1]": 2, "text[1]": "e", "text[-1]": "o", "obj['b']": 2, "not text in ['x']": True, "1 < 2 == true": True,
    "len(text)": 5, "len(null)": 0, "len(obj)": 2, "len(empty)": 0, "contains(text, 'ell')": True, "contains(xs, 3)": True, "contains(null, 1)": False, "get(obj, 'z', 7)": 7, "get(xs, 1)": 1, "get(xs, 9)": None,
    "get(null, 1, 2)": 2, "has(obj, 'a')": True, "has(xs, -3)": True, "has(xs, 3)": False, "keys(obj)": ["a", "b"], "values(obj)": [1, 2], "sorted(xs)": [1, 2, 3], "sorted('cab')": ["a", "b", "c"],
    "sum(xs)": 6.0, "sum([])": 0.0, "min(xs)": 1, "max(xs)": 3, "int('42')": 42, "int(' -4_2 ')": -42, "int(2.9)": 2, "int(-2.9)": -2, "int(true)": 1, "number('2.5')": 2.5, "string(2.0)": "2", "string(null)": "",
    "string(true)": "true", "string(1.5)": "1.5", "bool('')": False, "bool(xs)": True, "coalesce(null, nothing, 'z')": "z", "is_null(nothing)": True, "join(tags, '-')": "a-b", "join([1, 2])": "1,2", "join(empty)": "",
    "split('a,b,,c')": ["a", "b", "", "c"], "split('a.b', '.')": ["a", "b"], "lower('ABC')": "abc", "upper('abc')": "ABC", "trim('\\t x \\n')": "x", "starts_with(text, 'He')": True, "ends_with(text, 'lo')": True,
    "replace('aXbX', 'X', '-')": "a-b-", "replace('ab', '', '-')": "-a-b-", "round(2.5)": 2.0, "round(3.5)": 4.0, "round(2.345, 2)": 2.34, "abs(-3)": 3.0, "any([0, 1])": True, "any([])": False, "all([1, 2])": True,
    "all([])": True, "count('banana', 'an')": 2, "count(xs, 3)": 1, "count([1, 1, 2], true)": 2, "duration('1h30m')": 5400.0, "duration(3)": 3.0, "duration(replace('9xm', 'x', ''))": 540.0,
    "'it\\'s'": "it's", "1e3": 1000.0, ".5 + .5": 1.0, "-results.load.rows": -10,
}


def test_values(spark):
    wrong = {}
    for source, want in CASES.items():
        got = value(spark, source)
        if got != want or type(got) is not type(want):
            wrong[source] = got
    assert not wrong


@pytest.mark.parametrize("source", ["", "1 +", "(1", "[1,]", "f(1,)", "1 2", "'open", "'bad \\q'", "1_000", "3abc", "a b", "1 ? 2", "(1)(2)", "a.", "@", "1e", "(" * 70 + "1" + ")" * 70])
def test_syntax_errors(source):
    with pytest.raises(X.ExpressionError):
        X.parse(source)


@pytest.mark.parametrize("source", ["unknown", "nope(1)", "len()", "len(1, 2)", "1 < 'a'", "true < 1", "1 < 2 < 3", "-true", "-'a'", "'a' - 'b'", "1 + 'a'", "results.gone", "text.x", "1 in 'a'", "1 in 2", "xs['a']", "len(1)", "sum(['a'])", "min(3)", "lower(1)", "int([])"])
def test_compile_errors(spark, source):
    with pytest.raises(X.ExpressionError):
        value(spark, source)


@pytest.mark.parametrize("source", ["1 / 0", "1 // 0", "1 % 0", "obj.z", "obj['z']", "xs[3]", "xs[-4]", "text[9]", "min(empty)", "int('x')", "number('x')", "split('a', '')", "nothing + 'a'", "nothing < 'a'", "duration(lower('X'))"])
def test_row_errors(spark, source):
    with pytest.raises(Exception):
        value(spark, source)
    if "duration" not in source:
        assert value(spark, source, on_error="null") is None


def test_trees():
    node = X.parse("results.extract.rows > params.n and len(results['load']) ?? 0 == 1 or not flag")
    assert X.parse(X.render(node)) == node
    assert X.variables(node) == ["results", "params", "flag"] and X.called(node) == ["len"]
    assert X.references(node, "results") == ["extract", "load"] and X.references(node, "params") == ["n"]
    assert X.parse("a.in.true").value == "true" and X.depth(X.parse("1 + 2 * 3")) == 3
    assert X.parse("x") is X.parse("x")
    try:
        X.parse("1 + + ")
    except X.ExpressionError as e:
        assert "^" in e.render()


def test_own_functions(spark):
    double = lambda c, v: X.Value(v.col * 2, v.type)
    df = spark.range(1, 4)
    c = X.Compiler(X.environment(df), functions={"twice": double})
    assert [r[0] for r in df.where(c.test("twice(id) > 2")).collect()] == [2, 3]
    assert isinstance(c.compile("twice(id)").type, T.LongType)
