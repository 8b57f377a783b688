"""Queries of the general data problems (references, hierarchies, quality), with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.buckets import bucket_sql, value_sql
from fathom.operators import hierarchy, quality, references
from fathom.sources.tables import table

ROW_KEYS = {"employees": "employeeID", "customers": "CustomerId", "requests": "id"}
VERSIONED = {"employees"}
PROFILED = ("requests", "customers")
REFERENCES = (("employees", "reportsTo", "employees", "employeeID"), ("customers", "SupportRepId", "employees", "employeeID"), ("requests", "server_id", "servers", "id"), ("requests", "customer_id", "customers", "CustomerId"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [r.asDict() for r in table(spark, sf_dir, "relationships").select("from_table", "foreign_key", "to_table", "to_column").collect()]
    names = {r[k] for r in listed for k in ("from_table", "to_table")}
    return references.orphans_of({n: table(spark, sf_dir, n) for n in names}, listed, ROW_KEYS, VERSIONED)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("child_table", "child_column", "child_key").distinct()


def p2_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, sf_dir))


def _orphan_sql(select: str) -> str:
    parts = []
    for child, fk, parent, key in REFERENCES:
        rows = f"(select * from (select *, row_number() over (partition by {ROW_KEYS[child]} order by loaded_at desc) rn from {child}) where rn = 1)" if child in VERSIONED else child
        parts.append(
            f"select '{child}' child_table, '{fk}' child_column, cast(c.{ROW_KEYS[child]} as bigint) child_key, strftime(c.loaded_at, '%Y-%m') period,"
            " case when p.arrived is null then 'missing' when p.arrived > c.loaded_at then 'later' else 'deleted' end reason"
            f" from {rows} c left join (select {key} k, min(loaded_at) arrived, arg_max_null(deleted_at, loaded_at) gone from {parent} group by 1) p on c.{fk} = p.k"
            f" where c.{fk} is not null and (p.arrived is null or p.arrived > c.loaded_at or p.gone <= c.loaded_at)"
        )
    return f"with o as ({' union all '.join(parts)}) {select}"


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "employees").select("employeeID", "loaded_at", "reportsTo")
    return hierarchy.forest(references.latest_rows(rows, "employeeID", "loaded_at"), "employeeID", "reportsTo")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "employees").select("employeeID", "loaded_at", "reportsTo")
    found = hierarchy.roots(references.latest_rows(rows, "employeeID", "loaded_at"), "employeeID", "reportsTo", circles_only=True)
    return found.select(F.col("id").alias("employee_id"), "cycle_id")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = _forest(spark, sf_dir)
    below = hierarchy.descendants(solved).groupBy("id").agg(F.count(F.lit(1)).alias("descendants"))
    path = F.when(F.col("cycle_id").isNull(), F.array_join(F.col("trail").cast("array<string>"), "/"))
    # a member of a circle has as descendants all other nodes whose way ends in it
    size = solved.where("cycle_id is not null").groupBy("cycle_id").agg((F.count(F.lit(1)) - 1).alias("around"))
    return (
        solved.join(below, "id", "left")
        .join(size, "cycle_id", "left")
        .select(F.col("id").alias("employee_id"), "root", F.col("depth").cast("long").alias("depth"), path.alias("path"), "cycle_id", F.when(F.col("on_cycle"), F.col("around")).otherwise(F.coalesce("descendants", F.lit(0))).alias("descendants"))
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, sf_dir)).select(F.col("id").alias("employee_id"), F.col("descendant").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


def p3_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that p3_descendants leaves out as ancestors: per circle all employees below it, and whether they are on it. Each of those on it has all
    others of its class as descendants."""
    return _forest(spark, sf_dir).where("cycle_id is not null").select("cycle_id", F.col("id").alias("employee_id"), "on_cycle")


_FOREST_SQL = """with recursive cur as (select employeeID id, arg_max_null(reportsTo, loaded_at) p from employees group by 1),
e as (select c.id, k.id p from cur c left join cur k on k.id = c.p),
reach as (select id, p anc from e where p is not null union select r.id, e.p from reach r join e on e.id = r.anc where e.p is not null),
circle as (select id from reach where id = anc),
loops as (select c.id, least(c.id, min(r.anc)) cycle_id from circle c join reach r using (id) where r.anc in (select id from circle) group by c.id),
found as (select id employee_id, cycle_id from loops union select r.id, l.cycle_id from reach r join loops l on l.id = r.anc)"""


def _stored(spark: SparkSession, sf_dir: str, name: str) -> list[dict]:
    rows = table(spark, sf_dir, "column_profiles").where(F.col("table_name") == name).collect()
    return [r.asDict() for r in rows]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in PROFILED:
        found = quality.departures(table(spark, sf_dir, name), "load_id", _stored(spark, sf_dir, name))
        found = found.select(F.lit(name).alias("table_name"), "column_name", F.col("load_id").cast("int").alias("load_id"), "metric")
        out = found if out is None else out.unionByName(found)
    return out


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in PROFILED:
        patterns = {s["column_name"]: s["pattern"] for s in _stored(spark, sf_dir, name) if s["pattern"]}
        got = quality.profile(table(spark, sf_dir, name), "load_id", patterns)
        rounded = [F.round(c, 6).alias(c) for c in ("null_rate", "empty_string_rate", "cardinality_ratio", "median", "pattern_rate")]
        plain = ["column_name", "load_id", "row_count", "distinct_count", "min_text", "max_text", "min_value", "max_value"]
        got = got.select(F.lit(name).alias("table_name"), *plain, *rounded)
        out = got if out is None else out.unionByName(got)
    return out


def _masks(df: DataFrame) -> DataFrame:
    """Rows per mask of every column but the load."""
    return quality.mask_counts(df, "load_id", [c for c in df.columns if c != "load_id"])


def p4_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare masks per column and load, and how far its masks are from those of all loads and of the load before."""
    out = None
    for name in PROFILED:
        got = quality.mask_divergence(_masks(table(spark, sf_dir, name))).select(F.lit(name).alias("table_name"), "column_name", "load_id", "values", "rare_rows", F.round("divergence", 6).alias("divergence"), F.round("divergence_previous", 6).alias("divergence_previous"))
        out = got if out is None else out.unionByName(got)
    return out


def p4_mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masks of each column and load with their rows, told apart as dominant, rare (whose rows are violations) or neither."""
    out = None
    for name in PROFILED:
        got = quality.mask_report(_masks(table(spark, sf_dir, name)))
        got = got.select(F.lit(name).alias("table_name"), "column_name", "load_id", "mask", "n", F.round("share", 6).alias("share"), F.round("share_all", 6).alias("share_all"), "is_dominant", "is_rare")
        out = got if out is None else out.unionByName(got)
    return out


def p4_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant masks of each column over all loads."""
    out = None
    for name in PROFILED:
        got = quality.dominant_masks(_masks(table(spark, sf_dir, name))).select(F.lit(name).alias("table_name"), "column_name", "mask", "n", F.round("share", 6).alias("share"), "rank")
        out = got if out is None else out.unionByName(got)
    return out


def p4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of rare masks, with the key of their row."""
    out = None
    for name in PROFILED:
        df = table(spark, sf_dir, name)
        got = quality.violations(df, "load_id", ROW_KEYS[name], [c for c in df.columns if c != "load_id"]).select(F.lit(name).alias("table_name"), "*")
        out = got if out is None else out.unionByName(got)
    return out


# The text columns of the two profiled tables.
_MASKED = {"requests": ["client_id", "method", "path", "user_agent"], "customers": ["FirstName", "LastName", "Company", "City", "Country", "PostalCode", "Phone", "Email"]}

# Columns of the two profiled tables, told apart as numbers, times and texts.
_NUMBERS = {"requests": ["id", "server_id", "customer_id", "status_code", "response_time_ms", "bytes_sent"], "customers": ["CustomerId", "SupportRepId"]}
_TIMES = {"requests": ["requested_at", "loaded_at"], "customers": ["created_at", "loaded_at", "deleted_at"]}
_PATTERNS = {
    "requests": {"client_id": "^[0-9a-f]{16}$", "method": "^[A-Z]+$", "path": "^/[a-z0-9/_?=&.-]*$", "user_agent": "^[A-Za-z]+/[0-9]+[.][0-9]+"},
    "customers": {"Email": "^[a-z0-9._-]+@[a-z0-9-]+[.]example$", "Phone": "^[+][0-9]{2} [0-9]{3} [0-9]{4}$", "PostalCode": "^[0-9]{5}$"},
}


def _profile_sql() -> str:
    parts = []
    for name in PROFILED:
        for c in _NUMBERS[name] + _TIMES[name] + _MASKED[name]:
            number, time = c in _NUMBERS[name], c in _TIMES[name]
            text = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if time else c
            empty = "cast(null as double)" if number or time else f"round(count(*) filter ({c} = '') / count(*), 6)"
            pattern = _PATTERNS[name].get(c)
            full = f"{c} is not null" if number or time else f"{c} <> ''"
            rate = f"round(count(*) filter ({full} and regexp_matches({c}, '{pattern}')) / nullif(count(*) filter ({full}), 0), 6)" if pattern else "cast(null as double)"
            lo, hi = (("cast(null as varchar)", "cast(null as varchar)", f"cast(min({c}) as double)", f"cast(max({c}) as double)") if number else (f"min({text})", f"max({text})", "cast(null as double)", "cast(null as double)"))[:2], None
            lo_hi_value = (f"cast(min({c}) as double)", f"cast(max({c}) as double)") if number else ("cast(null as double)", "cast(null as double)")
            b = bucket_sql(c, quality.MEDIAN_ERROR)
            median = f"(select round({value_sql('m.b', quality.MEDIAN_ERROR)}, 6) from (select list_sort(list({b}) filter ({c} is not null)) as l from {name} t where t.load_id is not distinct from s.load_id) q, lateral (select q.l[cast((len(q.l) + 1) // 2 as bigint)] as b) m)" if number else "cast(null as double)"
            parts.append(
                f"select '{name}' table_name, '{c}' column_name, load_id, count(*) row_count, count(distinct {c}) distinct_count, {lo[0]} min_text, {lo[1]} max_text, {lo_hi_value[0]} min_value, {lo_hi_value[1]} max_value,"
                f" round(count(*) filter ({c} is null) / count(*), 6) null_rate, {empty} empty_string_rate, round(count(distinct {c}) / nullif(count({c}), 0), 6) cardinality_ratio, {median} median, {rate} pattern_rate from {name} s group by load_id"
            )
    return " union all ".join(parts)


def _departure_sql() -> str:
    stored = {
        "requests": ["client_id", "method", "path", "user_agent", "status_code", "response_time_ms", "bytes_sent"],
        "customers": ["Email", "Phone", "Company", "City", "Country", "PostalCode"],
    }
    measured, weights = [], []
    for name, columns in stored.items():
        for c in columns:
            number = c in _NUMBERS[name]
            pattern = _PATTERNS[name].get(c)
            empty = "cast(null as double)" if number else f"count(*) filter ({c} = '') / count(*)"
            median = f"median({c})" if number else "cast(null as double)"
            rate = f"count(*) filter ({c} <> '' and regexp_matches({c}, '{pattern}')) / nullif(count(*) filter ({c} <> ''), 0)" if pattern else "cast(null as double)"
            measured.append(f"select '{name}' table_name, '{c}' column_name, load_id, count(*) filter ({c} is null) / count(*) a, {empty} b, count(distinct {c}) / nullif(count({c}), 0) c, {median} d, {rate} e from {name} group by load_id")
            if c in ("method", "status_code", "Country"):
                weights.append(f"select '{name}' table_name, '{c}' column_name, load_id, cast({c} as varchar) item, count(*) n from {name} where {c} is not null group by all")
    return (
        f"with m as ({' union all '.join(measured)}), w as ({' union all '.join(weights)}),"
        " s as (select m.*, p.null_rate pa, p.empty_string_rate pb, p.cardinality_ratio pc, p.median pd, p.pattern_rate pe from m join column_profiles p using (table_name, column_name)),"
        " k as (select table_name, column_name, unnest(map_keys(weights)) item, unnest(map_values(weights)) w from column_profiles where weights is not null),"
        " l as (select table_name, column_name, load_id, sum(n) total from w group by all),"
        " u as (select l.table_name, l.column_name, l.load_id, total, k.item from l join k using (table_name, column_name) union select l.table_name, l.column_name, l.load_id, total, w.item from l join w using (table_name, column_name, load_id)),"
        " tv as (select u.table_name, u.column_name, u.load_id, sum(abs(coalesce(w.n, 0) / u.total - coalesce(k.w, 0))) / 2 tv from u left join w using (table_name, column_name, load_id, item) left join k on k.table_name = u.table_name and k.column_name = u.column_name and k.item = u.item group by all)"
        " select table_name, column_name, load_id, 'null_rate' metric from s where abs(a - pa) > 0.08"
        " union all select table_name, column_name, load_id, 'empty_string_rate' from s where abs(b - pb) > 0.08"
        " union all select table_name, column_name, load_id, 'cardinality_ratio' from s where abs(c - pc) > 0.2"
        " union all select table_name, column_name, load_id, 'median' from s where d > 2 * pd or d < pd / 2"
        " union all select table_name, column_name, load_id, 'pattern_rate' from s where pe - e > 0.08"
        " union all select table_name, column_name, load_id, 'weights' from tv where tv > 0.2"
    )


def _mask_sql(name: str, c: str) -> str:
    if c in _NUMBERS[name]:
        return f"case when {c} < 0 then '-' else '' end || case when isnan(cast({c} as double)) then 'NaN' when {c} = floor({c}) then '9' else '9.9' end"
    return quality.mask_sql(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c in _TIMES[name] else c)


def _all_masks_sql(extra: str = "", value: str = "") -> str:
    """Rows per load, column and mask, or with ``extra`` columns of each value."""
    parts = []
    for n in PROFILED:
        for c in _NUMBERS[n] + _TIMES[n] + _MASKED[n]:
            text = f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c in _TIMES[n] else f"cast({c} as varchar)"
            full = f"{c} <> ''" if c in _MASKED[n] else f"{c} is not null"
            more = f", {ROW_KEYS[n]} row_key, {text} as \"value\"" if value else ""
            parts.append(f"select '{n}' table_name, '{c}' column_name, load_id, {_mask_sql(n, c)} mask{more or ', count(*) n'} from {n} where {full}" + ("" if value else " group by all"))
    return " union all ".join(parts)


def _masks_sql() -> str:
    return (
        f"with m as ({_all_masks_sql()}), s as (select *, n / sum(n) over (partition by table_name, column_name, load_id) p, sum(n) over (partition by table_name, column_name, mask) / sum(n) over (partition by table_name, column_name) q,"
        " dense_rank() over (partition by table_name, column_name order by load_id nulls first) k from m)"
        ' select a.table_name, a.column_name, a.load_id, cast(sum(a.n) as bigint) "values", cast(sum(case when a.q < 0.005 then a.n else 0 end) as bigint) rare_rows, round(1.0 - sum(least(a.p, a.q)), 6) divergence,'
        " case when max(a.k) > 1 then round(1.0 - sum(least(a.p, coalesce(b.p, 0))), 6) end divergence_previous"
        " from s a left join s b on b.table_name = a.table_name and b.column_name = a.column_name and b.mask = a.mask and b.k = a.k - 1 group by a.table_name, a.column_name, a.load_id"
    )


def _report_sql() -> str:
    return (
        f"with m as ({_all_masks_sql()}), s as (select *, n / sum(n) over (partition by table_name, column_name, load_id) p, sum(n) over (partition by table_name, column_name, mask) / sum(n) over (partition by table_name, column_name) q,"
        " max(n) over (partition by table_name, column_name, load_id) top from m) select table_name, column_name, load_id, mask, n, round(p, 6) as \"share\", round(q, 6) share_all, n = top is_dominant, q < 0.005 is_rare from s"
    )


def _dominant_sql() -> str:
    return (
        f"with m as ({_all_masks_sql()}), s as (select table_name, column_name, mask, cast(sum(n) as bigint) n, sum(n) / sum(sum(n)) over (partition by table_name, column_name) p from m group by 1, 2, 3)"
        ' select table_name, column_name, mask, n, round(p, 6) as "share", cast(rank() over (partition by table_name, column_name order by n desc) as int) as "rank" from s where p >= 0.005'
    )


def _violations_sql() -> str:
    keep = f"select table_name, column_name, mask from ({_dominant_sql()})"
    return f"select table_name, load_id, row_key, column_name, \"value\", mask from ({_all_masks_sql(value='value')}) v where not exists (select 1 from ({keep}) k where k.table_name = v.table_name and k.column_name = v.column_name and k.mask = v.mask)"


QUERIES = {"p2_found": p2_found, "p2_orphan_counts": p2_orphan_counts, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p3_circles": p3_circles, "p4_found": p4_found, "p4_profile": p4_profile, "p4_masks": p4_masks, "p4_mask_report": p4_mask_report, "p4_dominant": p4_dominant, "p4_violations": p4_violations}

SQL = {
    "p2_found": _orphan_sql("select distinct child_table, child_column, child_key from o"),
    "p2_orphan_counts": _orphan_sql("select child_table, child_column, period, count(*) orphans, count(*) filter (reason = 'missing') missing_rows, count(*) filter (reason = 'later') later_rows, count(*) filter (reason = 'deleted') deleted_rows from o group by all"),
    "p3_found": f"{_FOREST_SQL} select employee_id, cycle_id from found",
    "p3_hierarchy": f"{_FOREST_SQL}, tree as (select id, id root, cast(0 as bigint) depth, cast(id as varchar) path from e where p is null union all select e.id, t.root, t.depth + 1, t.path || '/' || cast(e.id as varchar) from e join tree t on e.p = t.id),"
    " below as (select anc, count(*) n from reach where anc <> id group by 1)"
    " select e.id employee_id, t.root, t.depth, t.path, f.cycle_id, coalesce(b.n, 0) descendants from e left join tree t on t.id = e.id left join found f on f.employee_id = e.id left join below b on b.anc = e.id",
    "p3_descendants": f"{_FOREST_SQL}, walk as (select id anc, id, cast(0 as bigint) distance from e where id not in (select id from circle) union all select w.anc, e.id, w.distance + 1 from walk w join e on e.p = w.id where e.id not in (select id from circle)) select anc employee_id, id descendant_id, distance from walk where distance > 0",
    "p3_circles": f"{_FOREST_SQL} select cycle_id, employee_id, employee_id in (select id from circle) on_cycle from found",
    "p4_found": _departure_sql(),
    "p4_profile": _profile_sql(),
    "p4_masks": _masks_sql(),
    "p4_mask_report": _report_sql(),
    "p4_dominant": _dominant_sql(),
    "p4_violations": _violations_sql(),
}
