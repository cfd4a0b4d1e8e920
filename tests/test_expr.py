import pytest

from eventloom.plans.expr import ExpressionError, compile_value, tokens
from eventloom.functions import values as V

ROW = [("Big Lamp", "89.00", 3, "InStock", ["new", "Sale"], "DE", "", None, 2.5, True)]
SCHEMA = "name string, price string, stock int, availability string, tags array<string>, country string, empty string, gone string, half double, live boolean"

CASES = [
    ("price == 89", True), ("price > 100", False), ("stock >= 3 and price < 90", True), ("name == 'big lamp'", False), ("name contains 'LAMP'", True),
    ("tags contains 'sale'", True), ("'new' in tags", True), ("country in ['de', 'at']", True), ("name startswith 'big'", True), ("availability endswith 'STOCK'", True),
    ("name matches '^Big'", True), ("gone matches 'x'", False), ("gone > 1", False), ("gone == null", True), ("nothing == null", True), ("gone != 1", True),
    ("not empty", True), ("exists(empty)", True), ("exists(nothing)", False), ("stock and name", True), ("0 or empty", False), ("live", True),
    ("name < 'C'", True), ("name < 3", False), ("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("-stock", -3), ("price - 9", 80.0), ("stock / 0", None), ("gone + 'x'", None),
    ("'1' + '2'", "12"), ("'n: ' + stock", "n: 3"), ("round(half)", 2), ("round(3.5)", 4), ("round(-half)", -2), ("short(1400000000)", "1.4B"), ("short(7000000)", "7M"), ("short(950)", "950"), ("short(2.50)", "2.5"),
    ("commas(1234567)", "1,234,567"), ("commas(84079.69, 2)", "84,079.69"), ("title(\"o'neill's big-lamp\")", "O'Neill'S Big-Lamp"), ("upper(name)", "BIG LAMP"), ("len(tags)", 2), ("len(name)", 8), ("len(gone)", 0),
    ("replace(name, '(\\\\w+) (\\\\w+)', '\\\\2 \\\\1')", "Lamp Big"), ("default(empty, 'none')", "none"), ("default(name, 'none')", "Big Lamp"), ("max(1, stock, gone)", 3.0), ("min(4, price)", 4.0), ("abs(-4)", 4.0),
    ("number('$1,299.00')", 1299.0), ("number('1.299,00 €')", 1299.0), ("number('1,299')", 1299.0), ("number('12,5')", 12.5), ("number('none')", None), ("number('1.2.3')", None),
    ("date('2024-03-05T10:00:00+02:00')", "2024-03-05T08:00:00Z"), ("date('Tue, 05 Mar 2024 10:00:00 GMT')", "2024-03-05T10:00:00Z"), ("date(1700000000)", "2023-11-14T22:13:20Z"), ("date('1700000000000')", "2023-11-14T22:13:20Z"),
    ("date('soon')", None), ("date('2024-03-05')", "2024-03-05T00:00:00Z"), ("readable('ACME BANK OF OHIO')", "Acme Bank of Ohio"), ("trim('  x ')", "x"), ("tags.1", "Sale"), ("tags.-1", "Sale"),
]


def test_values(spark):
    df = spark.createDataFrame(ROW, SCHEMA)
    got = df.select(*[compile_value(s, df).col.alias(f"c{i}") for i, (s, _) in enumerate(CASES)]).first()
    wrong = [(s, want, got[i]) for i, (s, want) in enumerate(CASES) if got[i] != want or isinstance(want, bool) != isinstance(got[i], bool)]
    assert not wrong


@pytest.mark.parametrize(("source", "says"), [("price >", "expected a value"), ("nope(1)", "unknown function"), ("round()", "takes 1 to 2"), ("a == ;", "unexpected character"), ("1 2", "unexpected text")])
def test_errors_point_at_the_place(spark, source, says):
    with pytest.raises(ExpressionError, match=says):
        compile_value(source, spark.range(1))


def test_bad_regex(spark):
    with pytest.raises(ExpressionError, match="invalid regular expression"):
        compile_value("id matches '('", spark.range(1))


def test_words_hold_dashes_and_dots():
    assert [t[1] for t in tokens("og:title.x-y == `a b`")][:3] == ["og:title.x-y", "==", "a b"]


def test_variant_paths_tell_null_from_absent(spark):
    df = spark.sql("""select parse_json('{"a": null, "b": {"c": [1, "x"]}}') as data""")
    r = df.select(compile_value("exists(a)", df).col.alias("a"), compile_value("exists(z)", df).col.alias("z"), compile_value("b.c.1", df).col.alias("c"), compile_value("b.c.0 == 1", df).col.alias("n")).first()
    assert (r.a, r.z, r.c, r.n) == (True, False, "x", True)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(V.half_even(df.x, 0)).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_short_rounds_the_exact_value_and_ties_to_even(spark):
    numbers = [261_250_000.0, 261_350_000.0, -1250.0, 2_350_000.0, 0.125, 2.675, 999_950.0, 2.5, 950.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(V.short(df.x)).collect()] == ["261.2M", "261.4M", "-1.2K", "2.4M", "0.12", "2.67", f"{999.95:.1f}K".replace(".0K", "K"), "2.5", "950"]
