import pytest
from pyspark.sql import functions as F

from fathom.functions.expressions import ExpressionError, compile_expression, is_template, java_pattern, parse, with_expressions


@pytest.fixture(scope="module")
def one(spark):
    return spark.sql("select 7L as i, 2.5D as f, 'Ab c' as s, cast(null as string) as n, true as b, timestamp_ntz'2024-02-29 13:14:15.678' as t, date'2024-01-31' as d, 0L as z, -7L as m")


CASES = {
    "1 + 2 * 3": 7.0, "(1 + 2) * 3": 9.0, "${i} % 4": 3, "${m} % 4": -3, "${i} % ${z}": None, "${i} / ${z}": None, "-${i} + 1": -6.0, '"a" + "b"': "ab", '${s} + ${n}': None, "!${b} || ${i} > 5": True,
    "null && false": False, "null || true": True, "round(2.5)": 3.0, "round(-2.5)": -3.0, "round(0.285, 2)": 0.28, "min(1, null)": None, "max(3, 2)": 3.0, "clamp(5, 7, 1)": 7.0, "abs(${m})": 7, "ceil(1.2)": 2.0,
    "sqrt(-1)": None, "pow(10, 400)": None, "log(8, 2)": 3.0, "ln(0)": None, "exp(1000)": None, "upper(${s})": "AB C", "${s} |> lower()": "ab c", 'trim("  x ")': "x", "len(${s})": 4, 'concat(${i}, "-", ${f})': "7-2.5",
    "concat(${s}, ${n})": None, "substr(${s}, 1, 2)": "b ", "substr(${s}, -5, 2)": "Ab", "substr(${s}, 9)": "", 'replace("aaa", "a", "b")': "bbb", 'replace("ab", "", "-")': "-a-b-", "left(${s}, -1)": "", "right(${s}, 1)": "c",
    'pad_left("7", 3, "0x")': "007", 'pad_right("long", 2, ".")': "long", 'starts_with(${s}, "A")': True, 'contains(${s}, "z")': False, "cast_int(-2.9)": -2, 'cast_int("12x")': None, 'cast_int(" 12 ")': 12, "cast_float(${i})": 7.0,
    "cast_string(1.0)": "1", "cast_string(1e20)": "100000000000000000000", "cast_string(12345678.25)": "12345678.25", "if(null, 1, 2.5)": 2.5, "if(${b}, 1, 2.5)": 1.0, "coalesce(${n}, ${s})": "Ab c", "nullif(${i}, 7)": None,
    'case(${i} > 9, "x", ${i} > 5, "y")': "y", 'case(false, 1)': None, "year(${t})": 2024, "day_of_week(${t})": 3, "week_of_year(${t})": 9, 'date_diff(${t}, ${d}, "month")': 1, 'date_diff(${t}, ${d}, "day")': 29,
    'format_date(date_add(${d}, 1, "month"), "%Y-%m-%d")': "2024-02-29", 'format_date(start_of(${t}, "week"), "%d")': "26", 'format_date(end_of(${t}, "day"), "%H:%M:%S.%3f")': "23:59:59.999", 'make_duration(2, "month")': 5_184_000_000,
    'format_duration(3723000, "hms")': "01:02:03", 'format_duration(90061000, "human")': "1d 1h 1m 1s", 'format_duration(90061000, "iso")': "P1DT1H1M1S", "make_time(24, 0, 0)": None, 'timezone_offset(${t}, "America/New_York")': "-05:00",
    'to_timezone(${t}, "No/Where")': None, "epoch_seconds(from_epoch(1.5))": 1.5, "make_date(2023, 2, 30)": None, 'format_date(to_datetime("x", "%Y"), "%Y")': None, 'date_add(${t}, 1, "eon")': None, 'start_of(${t}, "eon")': None,
}


def test_values(one):
    got = one.select(*[compile_expression(e, one.schema).alias(f"c{i}") for i, e in enumerate(CASES)]).first()
    bad = {e: (g, w) for (e, w), g in zip(CASES.items(), got, strict=True) if (g != w if not isinstance(w, float) else g is None or abs(g - w) > 1e-12)}
    assert not bad


def test_arguments_and_syntax(one):
    for e in ("1 +", "f(1)", "abs()", "abs(1, 2)", "${nope}", '"open', "1 2", "cast_float(\"x\")", "${param.p}", "row_number()"):
        with pytest.raises(ExpressionError):
            compile_expression(e, one.schema)
    assert one.select(compile_expression("${param.p} * 2", one.schema, {"p": 4})).first()[0] == 8.0
    assert parse("a(1) |> b(2)").value == "b"


def test_random_functions_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    e = lambda d: sorted(d.select("id", compile_expression("random_int(1, 6)", d.schema, row=F.col("id")), compile_expression('random_float(0, 1)', d.schema, row=F.col("id"))).collect())
    a = e(df.repartition(1))
    assert a == e(df.repartition(7)) and {r[1] for r in a} == {1, 2, 3, 4, 5, 6} and 0.45 < sum(r[2] for r in a) / 1000 < 0.55


def test_templates_and_order(spark):
    assert is_template("${a}@${b}") and not is_template("${a} + ${b}") and not is_template("plain")
    df = spark.createDataFrame([(2, 3.0)], "q long, p double")
    got = with_expressions(df, {"label": "q=${q}", "total": "${sub} * 2", "sub": "${q} * ${p}"}).first()
    assert (got.label, got.total, got.sub) == ("q=2", 12.0, 6.0)
    with pytest.raises(ValueError):
        with_expressions(df, {"a": "${b} + 1", "b": "${a} + 1"})


def test_java_pattern():
    assert java_pattern("%d of %B %Y, 100%%") == "dd' of 'MMMM yyyy, 100%"
