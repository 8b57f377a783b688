"""Queries of the expression language, one per function family, each with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.expressions import compile_expression, with_expressions
from fathom.functions.rng import Rng, integer_sql, uniform_sql
from fathom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, source: str, keys: list[str], columns: dict[str, tuple[str, str]], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, view: str | None = None) -> None:
    """Register a query that computes ``columns`` (alias to expression and SQL) beside key columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = prepare(table(spark, sf_dir, source))
        made = [compile_expression(e, df.schema).alias(a) for a, (e, _) in columns.items()]
        rounded = [F.round(c, 9) if df.select(c.alias("x")).dtypes[0][1] == "double" else c for c in made]
        return df.select(*keys, *[c.alias(a) for c, a in zip(rounded, columns, strict=True)])

    QUERIES[name] = run
    SQL[name] = f"select {', '.join(keys)}, {', '.join(f'{s} as {a}' for a, (_, s) in columns.items())} from {view or source}"


_R = "round({}, 9)".format

_query(
    "expr_arithmetic",
    "lineitem",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
    {
        "net": ("${l_extendedprice} * (1 - ${l_discount}) * (1 + ${l_tax})", _R("l_extendedprice * (1 - l_discount) * (1 + l_tax)")),
        "unit": ("${l_extendedprice} / (${l_quantity} - 1)", _R("case when l_quantity = 1 then null else l_extendedprice / (l_quantity - 1) end")),
        "parity": ("${l_orderkey} % 7", "l_orderkey % 7"),
        "undefined": ("${l_orderkey} % (${l_linenumber} - 1)", "case when l_linenumber = 1 then null else l_orderkey % (l_linenumber - 1) end"),
        "negated": ("-${l_quantity} + 2 * 3 - 4 / 8", _R("-l_quantity + 5.5")),
    },
)
_query(
    "expr_logic",
    "lineitem",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
    {
        "big": ("${l_quantity} >= 25 && ${l_discount} < 0.05", "l_quantity >= 25 and l_discount < 0.05"),
        "any_of": ("${l_returnflag} == \"R\" || !(${l_tax} > 0.04)", "l_returnflag = 'R' or not (l_tax > 0.04)"),
        "unknown_or": ("(nullif(${l_returnflag}, \"A\") == \"N\") || ${l_quantity} > 40", "(nullif(l_returnflag, 'A') = 'N') or l_quantity > 40"),
        "unknown_and": ("(nullif(${l_returnflag}, \"A\") == \"N\") && ${l_quantity} > 40", "(nullif(l_returnflag, 'A') = 'N') and l_quantity > 40"),
        "band": ('case(${l_quantity} < 10, "low", ${l_quantity} < 30, "mid", "high")', "case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end"),
        "fee": ("if(${l_discount} > 0.05, 10, 2.5)", "case when l_discount > 0.05 then 10.0 else cast(2.5 as double) end"),
        "filled": ("coalesce(nullif(${l_linenumber}, 1), -1)", "cast(coalesce(nullif(l_linenumber, 1), -1) as bigint)"),
    },
)
_query(
    "expr_math",
    "part",
    ["p_partkey"],
    {
        "a_abs": ("abs(${p_size} - 25)", _R("abs(cast(p_size as double) - 25)")),
        "a_ceil": ("ceil(${p_retailprice} / 7)", "ceil(p_retailprice / 7)"),
        "a_floor": ("floor(${p_retailprice} / 7)", "floor(p_retailprice / 7)"),
        "a_round": ("round(${p_retailprice} / 7, 2)", _R("sign(p_retailprice) * floor(abs(p_retailprice / 7) * 100.0 + 0.5) / 100.0")),
        "a_min": ("min(${p_size}, 20)", "cast(least(p_size, 20) as double)"),
        "a_max": ("max(${p_size}, 20)", "cast(greatest(p_size, 20) as double)"),
        "a_clamp": ("clamp(${p_size}, 10, 30)", "cast(greatest(least(p_size, 30), 10) as double)"),
        "a_sqrt": ("sqrt(${p_size} - 25)", _R("case when p_size >= 25 then sqrt(p_size - 25) end")),
        "a_pow": ("pow(${p_size}, 1.5)", _R("pow(p_size, 1.5)")),
        "a_log": ("log(${p_retailprice}, 10)", _R("ln(p_retailprice) / ln(10)")),
        "a_ln": ("ln(${p_size} - 10)", _R("case when p_size > 10 then ln(p_size - 10) end")),
        "a_exp": ("exp(${p_size} / 10)", _R("exp(p_size / 10.0)")),
        "a_overflow": ("exp(${p_size} * 100)", _R("case when p_size < 8 then exp(p_size * 100.0) end")),
    },
)
_query(
    "expr_text",
    "customer",
    ["c_custkey"],
    {
        "t_upper": ("upper(${c_mktsegment})", "upper(c_mktsegment)"),
        "t_lower": ("${c_mktsegment} |> lower()", "lower(c_mktsegment)"),
        "t_trim": ('trim(concat("  ", ${c_name}, " "))', "c_name"),
        "t_len": ("len(${c_name})", "length(c_name)"),
        "t_concat": ('concat(${c_name}, "/", ${c_custkey})', "c_name || '/' || cast(c_custkey as varchar)"),
        "t_plus": ('${c_name} + "-" + ${c_mktsegment}', "c_name || '-' || c_mktsegment"),
        "t_substr": ("substr(${c_name}, 2, 5)", "substr(c_name, 3, 5)"),
        "t_substr_low": ("substr(${c_name}, -3, 4)", "substr(c_name, 1, 4)"),
        "t_replace": ('replace(${c_name}, "0", "o")', "replace(c_name, '0', 'o')"),
        "t_left": ("left(${c_mktsegment}, 3)", "left(c_mktsegment, 3)"),
        "t_right": ("right(${c_mktsegment}, 4)", "right(c_mktsegment, 4)"),
        "t_pad_left": ('pad_left(${c_custkey}, 6, "0")', "case when length(cast(c_custkey as varchar)) < 6 then lpad(cast(c_custkey as varchar), 6, '0') else cast(c_custkey as varchar) end"),
        "t_pad_right": ('pad_right(${c_mktsegment}, 4, "*")', "c_mktsegment"),
        "t_starts": ('starts_with(${c_mktsegment}, "B")', "starts_with(c_mktsegment, 'B')"),
        "t_ends": ('ends_with(${c_mktsegment}, "G")', "ends_with(c_mktsegment, 'G')"),
        "t_contains": ('contains(${c_mktsegment}, "U")', "contains(c_mktsegment, 'U')"),
    },
)
_query(
    "expr_casts",
    "customer",
    ["c_custkey"],
    {
        "to_int": ("cast_int(${c_acctbal})", "cast(trunc(c_acctbal) as bigint)"),
        "text_int": ('cast_int(right(${c_name}, 4))', "try_cast(right(c_name, 4) as bigint)"),
        "bad_int": ("cast_int(${c_mktsegment})", "cast(null as bigint)"),
        "to_float": ("cast_float(${c_nationkey})", "cast(c_nationkey as double)"),
        "whole_text": ("cast_string(${c_nationkey} * 1)", "cast(c_nationkey as varchar)"),
        "bool_int": ("cast_int(${c_acctbal} > 0)", "cast(c_acctbal > 0 as bigint)"),
    },
)
_DAY = "date_trunc('day', o_orderdate)"
_query(
    "expr_dates",
    "orders",
    ["o_orderkey"],
    {
        "d_year": ("year(${o_orderdate})", "year(o_orderdate)"),
        "d_month": ("month(${o_orderdate})", "month(o_orderdate)"),
        "d_day": ("day(${o_orderdate})", "day(o_orderdate)"),
        "d_hour": ("hour(${o_orderdate})", "hour(o_orderdate)"),
        "d_dow": ("day_of_week(${o_orderdate})", "isodow(o_orderdate) - 1"),
        "d_doy": ("day_of_year(${o_orderdate})", "dayofyear(o_orderdate)"),
        "d_week": ("week_of_year(${o_orderdate})", "weekofyear(o_orderdate)"),
        "d_quarter": ("quarter(${o_orderdate})", "quarter(o_orderdate)"),
        "d_epoch": ("epoch_seconds(${o_orderdate})", "round(epoch_ms(o_orderdate) / 1000.0, 9)"),
        "d_text": ('format_date(${o_orderdate}, "%d.%m.%Y %H:%M")', "strftime(o_orderdate, '%d.%m.%Y %H:%M')"),
        "d_plus_month": ('format_date(date_add(${o_orderdate}, 1, "month"), "%Y-%m-%d")', "strftime(o_orderdate + interval 1 month, '%Y-%m-%d')"),
        "d_minus_days": ('format_date(date_sub(${o_orderdate}, 45, "day"), "%Y-%m-%d")', "strftime(o_orderdate - interval 45 day, '%Y-%m-%d')"),
        "d_week_start": ('format_date(start_of(${o_orderdate}, "week"), "%Y-%m-%d")', "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d')"),
        "d_month_end": ('format_date(end_of(${o_orderdate}, "month"), "%Y-%m-%d %H:%M:%S")', "strftime(last_day(o_orderdate), '%Y-%m-%d') || ' 23:59:59'"),
        "d_months": ('date_diff(${o_orderdate}, make_date(1995, 6, 17), "month")', "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 6"),
        "d_days": ('date_diff(${o_orderdate}, make_date(1995, 6, 17), "day")', "cast(trunc((epoch_ms(o_orderdate) - epoch_ms(timestamp '1995-06-17')) / 86400000.0) as bigint)"),
        "d_offset": ('timezone_offset(${o_orderdate}, "Asia/Kolkata")', "'+05:30'"),
        "d_kolkata": ('format_date(to_timezone(${o_orderdate}, "Asia/Kolkata"), "%Y-%m-%d %H:%M")', "strftime(o_orderdate + interval 330 minute, '%Y-%m-%d %H:%M')"),
    },
)
_query(
    "expr_date_makers",
    "part",
    ["p_partkey"],
    {
        "made": ('format_date(make_date(2024, ${p_size} % 12 + 1, 30), "%Y-%m-%d")', "case when p_size % 12 + 1 = 2 then null else '2024-' || lpad(cast(p_size % 12 + 1 as varchar), 2, '0') || '-30' end"),
        "clock": ("make_time(${p_size} % 24, 30, 15)", "cast((p_size % 24) * 3600000 + 1815000 as bigint)"),
        "moment": ('format_date(make_datetime(2024, 1, 1, ${p_size} % 24, 0, 0), "%Y-%m-%d %H:%M:%S")', "'2024-01-01 ' || lpad(cast(p_size % 24 as varchar), 2, '0') || ':00:00'"),
        "span": ('make_duration(${p_size}, "month")', "cast(p_size as bigint) * 30 * 86400000"),
        "summed": ('duration_add(make_duration(${p_size}, "hour"), make_duration(1, "quarter"))', "cast(p_size as bigint) * 3600000 + 91 * 86400000::bigint"),
        "hms": ('format_duration(make_duration(${p_size} * 61, "second"), "hms")', "lpad(cast(p_size * 61 // 3600 as varchar), 2, '0') || ':' || lpad(cast(p_size * 61 // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(p_size * 61 % 60 as varchar), 2, '0')"),
        "parsed": ('format_date(to_date(concat("2023/", pad_left(${p_size} % 14 + 1, 2, "0"), "/05"), "%Y/%m/%d"), "%Y-%m-%d")', "case when p_size % 14 + 1 > 12 then null else '2023-' || lpad(cast(p_size % 14 + 1 as varchar), 2, '0') || '-05' end"),
        "from_epoch_text": ('format_date(from_epoch(${p_size} * 100000), "%Y-%m-%d %H:%M:%S")', "strftime(to_timestamp(p_size * 100000) at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"),
    },
)


def expr_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random functions: the portable stream, keyed by row."""
    df = table(spark, sf_dir, "part")
    row = F.col("p_partkey")
    rng = Rng(42, "part", row, portable=True)
    c = lambda e: compile_expression(e, df.schema, row=row, rng=rng)
    return df.select("p_partkey", c("random_int(1, 6)").alias("die"), F.round(c("random_float(0, 10)"), 9).alias("level"), c('random_duration(0, make_duration(1, "day"))').alias("wait"))


def expr_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns that depend on each other, and a template."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    out = with_expressions(df, {"label": "L${l_orderkey}-${l_linenumber}", "total": "round(${subtotal} * (1 + ${l_tax}), 2)", "subtotal": "${l_quantity} * ${unit_price}", "unit_price": "round(${l_extendedprice} / ${l_quantity}, 2)"})
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label", *[F.round(c, 4).alias(c) for c in ("unit_price", "subtotal", "total")])


QUERIES |= {"expr_random": expr_random, "expr_derived": expr_derived}
SQL |= {
    "expr_random": f"select p_partkey, {integer_sql(1, 6, 42, 'part', 'p_partkey', 'call', 1)} die, round({uniform_sql(42, 'part', 'p_partkey', 'call', 1)} * 10, 9) as level, {integer_sql(0, 86400000, 42, 'part', 'p_partkey', 'call', 1)} wait from part",
    "expr_derived": "with a as (select *, floor(l_extendedprice / l_quantity * 100.0 + 0.5) / 100.0 u from lineitem), b as (select *, l_quantity * u s from a)"
    " select l_orderkey, l_partkey, l_suppkey, l_linenumber, 'L' || l_orderkey || '-' || l_linenumber as label, round(u, 4) unit_price, round(s, 4) subtotal, round(floor(s * (1 + l_tax) * 100.0 + 0.5) / 100.0, 4) total from b",
}
