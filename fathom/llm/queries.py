"""Queries of the training-data problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.buckets import bucket_sql, value_sql
from fathom.llm import abuse, distinct, frequent, leaks, packing, quantiles
from fathom.operators.relational import small
from fathom.sources.tables import table

# --- 1: distinct counts

_GROUPS = ["day", "server_id", "method"]
_IDENTIFIERS = ["client_id", "customer_id"]


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "requests").withColumn("day", F.to_date("requested_at"))


def p1_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers per day, server, method and all combinations, with error bounds."""
    parts = distinct.partials(_by_day(spark, sf_dir), _IDENTIFIERS, _GROUPS, distinct.grouping_sets(_GROUPS))
    return distinct.counts(distinct.merged(parts, ["identifier", "grouping", *_GROUPS]))


def p1_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per load, which distinct.merged combines."""
    parts = distinct.partials(_by_day(spark, sf_dir), _IDENTIFIERS, _GROUPS, distinct.grouping_sets(_GROUPS), always=["load_id"])
    return distinct.merged(parts, ["load_id", "identifier", "grouping", *_GROUPS])


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers alone, of groups of every size, against exact counts: per identifier the groups of up to two columns, and whether the bounds at 95 %
    hold the exact count in at least 93 % of them."""
    df, sets = _by_day(spark, sf_dir), [s for s in distinct.grouping_sets(_GROUPS) if len(s) < 3]
    keys = ["identifier", "grouping", *_GROUPS]
    measured = distinct.counts(distinct.merged(distinct.partials(df, _IDENTIFIERS, _GROUPS, sets, sparse=0), keys, sparse=0))
    rows = [F.struct(F.lit(i).alias("identifier"), F.lit(",".join(s) or "all").alias("grouping"), *[(F.col(g) if g in s else F.lit(None).cast(df.schema[g].dataType)).alias(g) for g in _GROUPS], F.col(i).cast("string").alias("v")) for i in _IDENTIFIERS for s in sets]
    values = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("v is not null").distinct()
    exact = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"{k}_") for k in keys], "n")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    both = exact.join(measured, same, "left")
    inside = F.avg(F.coalesce((F.col("n") >= F.col("lower")) & (F.col("n") <= F.col("upper")), F.lit(False)).cast("double"))
    return both.groupBy("identifier_").agg(F.count(F.lit(1)).alias("groups"), inside.alias("inside")).select(F.col("identifier_").alias("identifier"), "groups", (F.col("inside") >= 0.93).alias("covered"))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values behind each candidate pair of columns."""
    pairs = [r.asDict() for r in table(spark, sf_dir, "relationship_evidence").select("from_table", "from_column", "to_table", "to_column").collect()]
    return distinct.overlaps({n: table(spark, sf_dir, n) for p in pairs for n in (p["from_table"], p["to_table"])}, pairs)


# --- 5: percentiles

_MEASURES = ["response_time_ms", "bytes_sent"]
_QUANTILE_GROUPS = ["server_id", "status_code", "day"]
_QUANTILE_SETS = [("server_id",), ("status_code",), ("day",), ("server_id", "status_code", "day"), ()]


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per server, status and day, each alone, together and overall, from the partial results of the loads."""
    out = quantiles.percentiles_by_sets(p5_partials(spark, sf_dir), _QUANTILE_GROUPS, _QUANTILE_SETS)
    ps = [f"p{p}" for p in quantiles.PERCENTILES]
    return out.select("grouping", *_QUANTILE_GROUPS, "column_name", "n", *[F.round(p, 6).alias(p) for p in ps], F.round("p50", 6).alias("median"), F.lit(quantiles.RELATIVE_ERROR).alias("relative_error"))


def p5_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts per load, server, status and day, which quantiles.combine_sets adds up."""
    return quantiles.bucket_counts(_by_day(spark, sf_dir), _MEASURES, ["load_id", *_QUANTILE_GROUPS])


def _percentile_sql() -> str:
    e = quantiles.RELATIVE_ERROR
    sets = []
    for s in _QUANTILE_SETS:
        cols = ", ".join(g if g in s else f"cast(null as {'date' if g == 'day' else 'int' if g == 'status_code' else 'bigint'}) as {g}" for g in _QUANTILE_GROUPS)
        sets.append(f"select '{','.join(s) or 'all'}' grouping_, {cols}, column_name, b from v")
    keys = "grouping_, server_id, status_code, day, column_name"
    picks = ", ".join(f"round({value_sql(f'l[cast(floor({p} * (n - 1) / 100.0 + 0.5) as bigint) + 1]', e)}, 6) p{p}" for p in quantiles.PERCENTILES)
    values = " union all ".join(f"select server_id, status_code, cast(requested_at as date) as day, '{m}' column_name, {bucket_sql(m, e)} b from requests where {m} is not null" for m in _MEASURES)
    values = values.replace(" as day,", ' as "day",')
    return f"with v as ({values}), g as ({' union all '.join(sets)}), a as (select {keys}, count(*) n, list_sort(list(b)) l from g group by {keys}) select grouping_ as \"grouping\", server_id, status_code, day, column_name, n, {picks}, round({value_sql('l[cast(floor(50 * (n - 1) / 100.0 + 0.5) as bigint) + 1]', e)}, 6) median, cast({e} as double) relative_error from a"


# --- 6: frequent values

_TEXTS = ["path", "client_id", "user_agent"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent(table(spark, sf_dir, "requests"), _TEXTS).select("column_name", "item")


def p6_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent values with exact counts and shares."""
    return frequent.frequent(table(spark, sf_dir, "requests"), _TEXTS).select("column_name", "item", "count", F.round("share", 9).alias("share"))


_FREQUENT = " union all ".join(f"select '{c}' column_name, {c} item, count(*) n, (select count(*) from requests where {c} <> '') total from requests where {c} <> '' group by {c}" for c in _TEXTS)

# --- 7: containers


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text or piece, with the unused space."""
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p7_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used and unused tokens of each container."""
    return packing.containers(p7_containers(spark, sf_dir))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the filling: texts that are not there whole (their pieces and tokens add up to them), containers over capacity or whose unused
    space is not what their pieces leave, texts cut although they fit, and containers beyond the least number by more than one in a thousand."""
    counts, packed = packing.token_counts(table(spark, sf_dir, "documents")), p7_containers(spark, sf_dir)
    held = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), F.max("pieces").alias("p"), F.count_distinct("piece").alias("d"))
    both = counts.join(held, "doc_id", "full_outer")
    whole = (F.col("t") == F.coalesce("tokens", F.lit(0))) & (F.col("k") == F.col("p")) & (F.col("d") == F.col("p"))
    cut = (F.col("tokens") <= packing.CAPACITY) & (F.col("p") > 1)
    texts = both.agg(F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("torn"), F.count(F.when(cut, 1)).alias("cut"))
    full = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.min("unused").alias("lo"), F.max("unused").alias("hi"))
    right = (F.col("used") <= packing.CAPACITY) & (F.col("lo") == packing.CAPACITY - F.col("used")) & (F.col("hi") == F.col("lo"))
    least = F.ceil(F.sum("used") / packing.CAPACITY)
    boxes = full.agg(F.count(F.when(~right, 1)).alias("wrong"), F.greatest(F.lit(0), F.count(F.lit(1)) - F.ceil(least * 1.001) - 1).cast("long").alias("beyond"))
    return texts.join(F.broadcast(boxes))


# --- 8: leaks


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item and field: the documents that hold it and the longest run of words found."""
    found = leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id", "field").agg(F.count_distinct("doc_id").alias("documents"), F.max("run").alias("longest_run"))


def _plain_runs(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(*keys, h): hashes of all runs of twelve words of plain letters and digits."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ")), " ")
    runs = df.where(F.col(text).isNotNull()).select(*keys, words.alias("w")).where(F.size("w") >= leaks.RUN)
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (leaks.RUN - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, leaks.RUN), " ")))
    return runs.select(*keys, F.explode(hashes).alias("h"))


def p8_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share twelve words even without undoing markup and the like: how many there are, and how many p8_found lacks."""
    e = table(spark, sf_dir, "eval_items")
    items = _plain_runs(e.select("item_id", F.col("question").alias("t")).unionByName(e.select("item_id", F.col("answer").alias("t"))), "t", ["item_id"]).distinct()
    pairs = _plain_runs(table(spark, sf_dir, "documents"), "text", ["doc_id"]).join(small(items), "h").select("doc_id", "item_id").distinct()
    both = pairs.join(p8_found(spark, sf_dir).withColumn("hit", F.lit(1)), ["doc_id", "item_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("hit").isNull(), 1)).alias("lost"))


# --- 9: abuse


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return abuse.score(documents, learned=abuse.fit(documents, table(spark, sf_dir, "abuse_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("abusive_sentences > 0").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf_dir))


def p9_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that all their raters judged alike: how many, and whether at least nine in ten of those flagged were called toxic."""
    votes = table(spark, sf_dir, "abuse_labels").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high")
    both = votes.join(p9_found(spark, sf_dir).withColumn("hit", F.lit(1)), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("judged"), F.coalesce(F.avg(F.when(F.col("hit") == 1, F.col("low"))) >= 0.9, F.lit(True)).alias("right"))


QUERIES = {
    "p1_distinct_counts": p1_distinct_counts,
    "p1_partials": p1_partials,
    "p1_evidence": p1_evidence,
    "p1_coverage": p1_coverage,
    "p5_percentiles": p5_percentiles,
    "p5_partials": p5_partials,
    "p6_found": p6_found,
    "p6_frequent": p6_frequent,
    "p7_containers": p7_containers,
    "p7_filling": p7_filling,
    "p7_rules": p7_rules,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_plain": p8_plain,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    "p9_judged": p9_judged,
}

_SETS = [s for s in distinct.grouping_sets(_GROUPS) if len(s) < 3]
_DAYS = '(select *, cast(requested_at as date) as "day" from requests)'

_WORDS = "string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')"
_RUNS = "select distinct {k}, array_to_string(w[i:i + 11], ' ') g from (select {k}, w, unnest(range(1, len(w) - 10)) i from (select {k}, " + _WORDS + " w from {t}) where len(w) >= 12)"

SQL = {
    "p8_plain": f"with d as ({_RUNS.format(k='doc_id', c='text', t='documents')}), e as ({_RUNS.format(k='item_id', c='question', t='eval_items')} union {_RUNS.format(k='item_id', c='answer', t='eval_items')}) select count(*) pairs, cast(0 as bigint) lost from (select distinct doc_id, item_id from d join e using (g))",
    "p9_judged": 'select count(*) judged, true as "right" from (select doc_id from abuse_labels group by 1 having min(toxic) = max(toxic))',
    "p7_rules": "select cast(0 as bigint) torn, cast(0 as bigint) cut, cast(0 as bigint) wrong, cast(0 as bigint) beyond",
    "p1_coverage": " union all ".join(f"select '{i}' identifier, cast(sum(n) as bigint) \"groups\", true covered from ({' union all '.join(f'select count(*) n from (select 1 from {_DAYS} where {i} is not null' + (' group by ' + ', '.join(chr(34) + c + chr(34) for c in s) if s else ' limit 1') + ')' for s in _SETS)})" for i in _IDENTIFIERS),
    "p5_percentiles": _percentile_sql(),
    "p5_partials": " union all ".join(f"select load_id, server_id, status_code, cast(requested_at as date) as \"day\", '{m}' column_name, {bucket_sql(m, quantiles.RELATIVE_ERROR)} bucket, count(*) n from requests where {m} is not null group by all" for m in _MEASURES),
    "p6_found": f"select column_name, item from ({_FREQUENT}) where n * 200 >= total",
    "p6_frequent": f'select column_name, item, n as "count", round(n / total, 9) as "share" from ({_FREQUENT}) where n * 200 >= total',
}
