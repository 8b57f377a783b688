"""Queries of the relational building blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import relational as R
from fathom.sources.tables import table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def rel_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate whose nulls count as false, and projected columns."""
    li = table(spark, sf_dir, "lineitem")
    keep = F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("A")) == "R", F.lit(False))
    return li.where(keep & (F.col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def rel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


def rel_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def rel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurring values from a lookup whose size is checked before it is broadcast."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(R.small(n), c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", "n_name")


def rel_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


def rel_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are not shipped before they are ordered."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    o = table(spark, sf_dir, "orders")
    out = R.causal_join(li, "l_orderkey", "l_shipdate", o, "o_orderkey", "o_orderdate")
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def rel_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at least an hour apart."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return R.enforce_gap(e, "user_id", "ts", 3_600_000, ["event_id"]).select("event_id", "user_id", F.unix_millis("ts").alias("at"))


def rel_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since the previous event of a user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return R.lagged(e, ["user_id"], ["ts", "event_id"], "at", "before").select("event_id", (F.col("at") - F.col("before")).alias("delta_ms"))


def rel_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_ranks(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_quantity", "rank")


def rel_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], [1, 25, 50, 75, 99])


def rel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and part of the day, as a pivot."""
    e = table(spark, sf_dir, "events").withColumn("h", F.hour("ts"))
    return e.groupBy("user_id").agg(*[F.count(F.when((F.col("h") >= 6 * i) & (F.col("h") < 6 * i + 6), 1)).alias(n) for i, n in enumerate(("night", "morning", "afternoon", "evening"))])


def rel_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_seen"))


def rel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with copies of some of them appended."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return p.unionByName(p.where("p_size >= 45"))


def rel_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return R.total_variation(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), "l_returnflag").select(F.round("similarity", 9).alias("similarity"))


def rel_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return R.ks_distance(c.select(F.col("c_acctbal").alias("v")), s.select(F.col("s_acctbal").alias("v")), "v").select(F.round("distance", 9).alias("distance"))


def rel_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers and suppliers, and with only one of them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct().withColumn("c", F.lit(True))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).distinct().withColumn("s", F.lit(True))
    side = F.when(F.col("c") & F.col("s"), "both").when(F.col("c"), "customers").otherwise("suppliers")
    return c.join(s, "nation", "full_outer").select("nation", side.alias("side"))


def rel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customer and supplier nation pairs of orders with their reverse, by a self-join of edges."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(R.small(s), F.col("l_suppkey") == F.col("s_suppkey")).join(R.small(c), F.col("o_custkey") == F.col("c_custkey"))
    e = e.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("back"))
    return e.join(back, ["src", "dst"], "left").select("src", "dst", "n", F.coalesce("back", F.lit(0)).alias("back"))


def scan_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 orders by key: a limit is the operator."""
    return R.head_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


def scan_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 200 orders that does not depend on partitioning: sampling is the operator."""
    return R.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 200, ["o_orderkey"], seed=3)


def rel_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and status in sort order, nulls last."""
    o = table(spark, sf_dir, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return o.groupBy("status", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("status").asc_nulls_last(), "o_orderpriority")


QUERIES = {f.__name__: f for f in (rel_filter_project, rel_overlap, rel_anti, rel_lookup, rel_row_index, rel_causal, rel_gaps, rel_deltas, rel_average_rank, rel_percentiles, rel_histogram, rel_first_seen, rel_duplicates, rel_tv, rel_ks, rel_set_ops, rel_edges, scan_head, scan_sample, rel_sorted)}

_PERCENTILE = "list_sort(list(cast({c} as double)))[cast(floor({p} * (count({c}) - 1) / 100.0 + 0.5) as bigint) + 1]"
SQL = {
    "rel_filter_project": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) net from lineitem where l_returnflag = 'R' and l_discount > 0.05",
    "rel_overlap": "with v as (select distinct o_custkey v from orders) select count(*) as \"values\", count(*) filter (v in (select c_custkey from customer)) as found, count(*) filter (v in (select c_custkey from customer)) / count(*) as \"overlap\" from v",
    "rel_anti": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)",
    "rel_lookup": "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey",
    "rel_row_index": "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 row_index from orders",
    "rel_causal": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d %H:%M:%S') l_shipdate from lineitem left join orders on l_orderkey = o_orderkey",
    "rel_gaps": "with a as (select event_id, user_id, (epoch_us(ts) // 1000) t, row_number() over (partition by user_id order by ts, event_id) k from events) select event_id, user_id, max(t - 3600000 * k) over (partition by user_id order by k) + 3600000 * k as \"at\" from a",
    "rel_deltas": "select event_id, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by ts, event_id) delta_ms from events",
    "rel_average_rank": "select l_quantity, avg(k) as rank from (select l_quantity, row_number() over (order by l_quantity) k from lineitem) group by 1",
    "rel_percentiles": " union all ".join(f"select '{c}' column_name, {', '.join(f'{_PERCENTILE.format(c=c, p=p)} p{p}' for p in (1, 25, 50, 75, 99))} from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "rel_histogram": "select user_id, count(*) filter (hour(ts) < 6) night, count(*) filter (hour(ts) between 6 and 11) morning, count(*) filter (hour(ts) between 12 and 17) afternoon, count(*) filter (hour(ts) >= 18) evening from events group by 1",
    "rel_first_seen": "select p_brand, min(p_partkey) first_seen from part group by 1",
    "rel_duplicates": "select p_partkey, p_name, p_size from part union all select p_partkey, p_name, p_size from part where p_size >= 45",
    "rel_tv": "with a as (select l_returnflag v, count(*) / (select count(*) from lineitem where l_linestatus = 'F') p from lineitem where l_linestatus = 'F' group by 1), b as (select l_returnflag v, count(*) / (select count(*) from lineitem where l_linestatus = 'O') q from lineitem where l_linestatus = 'O' group by 1) select round(1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 9) similarity from a full join b using (v)",
    "rel_ks": "with v as (select c_acctbal v from customer union select s_acctbal from supplier) select round(max(abs((select count(*) from customer where c_acctbal <= v.v) / (select count(*) from customer) - (select count(*) from supplier where s_acctbal <= v.v) / (select count(*) from supplier))), 9) distance from v",
    "rel_set_ops": "with c as (select distinct c_nationkey nation from customer), s as (select distinct s_nationkey nation from supplier) select coalesce(c.nation, s.nation) nation, case when s.nation is null then 'customers' when c.nation is null then 'suppliers' else 'both' end side from c full join s on c.nation = s.nation",
    "rel_edges": "with e as (select c_nationkey src, s_nationkey dst, count(*) n from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey group by 1, 2) select e.src, e.dst, e.n, coalesce(b.n, 0) back from e left join e b on b.src = e.dst and b.dst = e.src",
    "scan_head": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100",
    "scan_sample": "select o_orderkey, o_totalprice from orders order by md5('3|' || cast(o_orderkey as varchar)), o_orderkey limit 200",
    "rel_sorted": "select nullif(o_orderstatus, 'P') status, o_orderpriority, count(*) n from orders group by 1, 2",
}
