"""One registered query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.frame import RID, Frame, Vec
from quillframe.functions import ieee
from quillframe.lang.evaluate import evaluate
from quillframe.ml import forest, glm, kmeans
from quillframe.ml.arguments import Case
from quillframe.operators import aggregate, factor, rows, stats, summary
from quillframe.registry import Registry
from quillframe.score.pmml import Pmml
from quillframe.shared import new_path, write_bytes
from quillframe.sources.files import import_path, read_delimited
from quillframe.sources.infer import infer, project

#: What orders each table: unique together.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "events": ["event_id"], "embeddings": ["vec_id"],
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Registry:
    reg = Registry(spark)
    for n in names:
        reg.put_df(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), KEYS[n])
    return reg


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _vector(name: str, expression: str, sql: str, table: str = "orders", digits: int | None = None) -> None:
    """A query of an expression row by row, as (key, x)."""
    key = KEYS[table][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = evaluate(tables(spark, sf_dir, table), expression).only()
        df = out.rows.df.select(key, out.expr.alias("x"))
        return df.withColumn("x", ieee.rounded(F.col("x"), digits)) if digits is not None else df

    QUERIES[name] = run
    SQL[name] = f"select {key}, {f'round({sql}, {digits})' if digits is not None else sql} as x from {table}"


_vector("arith_add", "orders$o_totalprice + orders$o_custkey", "o_totalprice + o_custkey::double")
_vector("arith_sub", "1000 - orders$o_totalprice", "1000.0::double - o_totalprice")
_vector("arith_mul", "orders$o_totalprice * 1.5", "o_totalprice * 1.5::double")
_vector("arith_div", "orders$o_totalprice / (orders$o_custkey % 7)", "case when o_custkey % 7 = 0 then 'inf'::double else o_totalprice / (o_custkey % 7)::double end")
_vector("arith_mod", "orders$o_totalprice % (orders$o_custkey % 5)", "case when o_custkey % 5 = 0 then 'nan'::double else fmod(o_totalprice, (o_custkey % 5)::double) end")
_vector("arith_neg", "-orders$o_totalprice", "-o_totalprice")
_vector("arith_left_to_right", "orders$o_totalprice / 8 * 4 % 1000", "fmod(o_totalprice / 8.0::double * 4.0::double, 1000.0::double)")
_vector("log_vector", "log(orders$o_custkey - 1)", "case when o_custkey = 1 then '-inf'::double else ln((o_custkey - 1)::double) end", digits=9)
for _n, _op in {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _vector(f"compare_{_n}", f"orders$o_custkey {_op} 75", f"(o_custkey {'=' if _op == '==' else '<>' if _op == '!=' else _op} 75)::int::double")
_vector("compare_constant_first", "50 < orders$o_custkey", "(50 < o_custkey)::int::double")
_vector("logic_and", "orders$o_custkey > 20 && orders$o_totalprice < 100000", "(o_custkey > 20 and o_totalprice < 100000)::int::double")
_vector("logic_or", "orders$o_custkey > 100 || orders$o_totalprice < 50000", "(o_custkey > 100 or o_totalprice < 50000)::int::double")
_vector("ternary_vector", "orders$o_custkey % 2 == 0 ? orders$o_totalprice : -1", "case when o_custkey % 2 = 0 then o_totalprice else -1.0::double end")
_vector("ternary_scalar", "1 < 2 ? orders$o_totalprice : nosuchkey", "o_totalprice")
_vector("column_by_index", "orders[3]", "o_totalprice")
_vector("column_by_name", "|orders|$o_custkey", "o_custkey")
_vector("assign_and_reuse", "(t = orders$o_totalprice) * 2", "o_totalprice * 2.0::double")


@query("select round(sum(l_extendedprice), 2) as x from lineitem where l_discount > 0.05")
def exec_sum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = evaluate(tables(spark, sf_dir, "lineitem"), "filter(lineitem, lineitem$l_discount > 0.05)$l_extendedprice")
    return aggregate.aggregates(f.only(), ["sum"]).select(ieee.rounded(F.col("sum"), 2).alias("x"))


@query("select min(l_quantity) as min, max(l_quantity) as max, sum(l_quantity) as sum, round(avg(l_quantity), 8) as mean from lineitem")
def column_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate(tables(spark, sf_dir, "lineitem"), "lineitem$l_quantity").only()
    return aggregate.aggregates(v, ["min", "max", "sum", "mean"]).withColumn("mean", ieee.rounded(F.col("mean"), 8))


@query("""select round(min(x), 8) as min, round(max(x), 8) as max, round(sum(x), 3) as sum, round(avg(x), 8) as mean from
(select case when l_tax = 0 then null else l_quantity / l_tax end as x from lineitem)""")
def aggregates_skip_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate(tables(spark, sf_dir, "lineitem"), "lineitem$l_quantity / lineitem$l_tax * (lineitem$l_tax / lineitem$l_tax)").only()
    out = aggregate.aggregates(v, ["min", "max", "sum", "mean"])
    return out.select(ieee.rounded(F.col("min"), 8).alias("min"), ieee.rounded(F.col("max"), 8).alias("max"), ieee.rounded(F.col("sum"), 3).alias("sum"), ieee.rounded(F.col("mean"), 8).alias("mean"))


@query("""
select 'l_quantity' as name, 'float' as type, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as sigma, count(l_quantity) as n, count(*) - count(l_quantity) as na, 0::bigint as domain from lineitem
union all select 'tax', 'float', min(nullif(l_tax, 0)), max(nullif(l_tax, 0)), round(avg(nullif(l_tax, 0)), 6), round(stddev_pop(nullif(l_tax, 0)), 6), count(nullif(l_tax, 0)), count(*) - count(nullif(l_tax, 0)), 0 from lineitem
union all select 'l_linenumber', 'int', min(l_linenumber), max(l_linenumber), round(avg(l_linenumber), 6), round(stddev_pop(l_linenumber), 6), count(l_linenumber), 0, 0 from lineitem
union all select 'l_returnflag', 'enum', 0, count(distinct l_returnflag) - 1, null, null, count(l_returnflag), 0, count(distinct l_returnflag) from lineitem
""")
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    f = Frame(f.rows, {"l_quantity": f.columns["l_quantity"], "tax": F.nullif(F.col("l_tax"), F.lit(0.0)), "l_linenumber": f.columns["l_linenumber"], "l_returnflag": f.columns["l_returnflag"]})
    return summary.summary(f).withColumn("mean", ieee.rounded(F.col("mean"), 6)).withColumn("sigma", ieee.rounded(F.col("sigma"), 6))


@query("select * from orders where o_totalprice > 200000 and o_custkey % 3 = 0")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables(spark, sf_dir, "orders"), "filter(orders, orders$o_totalprice > 200000 && orders$o_custkey % 3 == 0)").df


@query("select o_orderkey from orders where trunc(o_totalprice / 250000) <> 0")
def filter_truncates_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables(spark, sf_dir, "orders"), "filter(orders, orders$o_totalprice / 250000)").df.select("o_orderkey")


@query("""with a as (select o_orderkey, row_number() over (order by o_orderkey) as r from orders),
b as (select o_totalprice, row_number() over (order by o_custkey, o_orderkey) as r from orders)
select o_orderkey from a join b using (r) where o_totalprice > 150000""")
def filter_by_other_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders by the bits of another frame as long as theirs: the orders by customer, whose rows stand elsewhere."""
    reg = tables(spark, sf_dir, "orders")
    other = reg.put_df("by_customer", spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey", "o_orderkey"])
    bits = Vec(other.rows, ieee.gt(other.columns["o_totalprice"], F.lit(150_000.0)))
    return rows.filter_rows(reg.get("orders"), bits).df.select("o_orderkey")


@query("""select o_orderkey, o_custkey, o_orderstatus, case when o_custkey = 2 then 54321.0::double else o_totalprice * 2.0::double end as o_totalprice, o_orderdate, o_orderpriority from orders""")
def col_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables(spark, sf_dir, "orders"), 'colSwap(orders, "o_totalprice", orders$o_custkey == 2 ? 54321 : orders$o_totalprice * 2)').df


@query("select * exclude (r) from (select *, row_number() over (order by o_orderkey) - 1 as r from orders) where r >= 100 and r < 223")
def slice_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables(spark, sf_dir, "orders"), "slice(orders, 100, 123)").df


@query("select * exclude (r) from (select *, row_number() over (order by c_custkey) - 1 as r from customer) where r >= 17")
def slice_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(tables(spark, sf_dir, "customer"), "slice(customer, 17)").df


@query("""with a as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as r from nation),
b as (select r_regionkey, row_number() over (order by r_regionkey) - 1 as r from region)
select a.r as _rid, (n_nationkey + r_regionkey)::double as x from a join b on a.r % 5 = b.r""")
def recycling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate(tables(spark, sf_dir, "nation", "region"), "nation$n_nationkey + region$r_regionkey").only()
    return v.rows.df.select(RID, v.expr.alias("x"))


@query("""with a as (select o_totalprice, row_number() over (order by o_orderkey) - 1 as r from orders),
b as (select c_acctbal, row_number() over (order by c_custkey) - 1 as r from customer)
select a.r as _rid, o_totalprice - c_acctbal as x from a join b on a.r % (select count(*) from customer) = b.r""")
def recycling_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = evaluate(tables(spark, sf_dir, "orders", "customer"), "orders$o_totalprice - customer$c_acctbal").only()
    return v.rows.df.select(RID, v.expr.alias("x"))


@query("""select r as _rid, cast(c_custkey as varchar) as c_custkey, c_name, coalesce(cast(nullif(c_nationkey, 3) as varchar), 'NA') as c_nationkey from
(select *, row_number() over (order by c_custkey) - 1 as r from customer) where r between 10 and 39""")
def inspect_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "customer").get("customer")
    f = Frame(f.rows, {"c_custkey": f.columns["c_custkey"], "c_name": f.columns["c_name"], "c_nationkey": F.nullif(F.col("c_nationkey"), F.lit(3))})
    return summary.page(f, 10, 30)


@query("select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::double as x from orders")
def factor_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = factor.factor(tables(spark, sf_dir, "orders").get("orders").vec("o_orderpriority"))
    return v.rows.df.select("o_orderkey", v.expr.alias("x"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, (dense_rank() over (order by s) - 1)::double as x from
(select *, cast(l_linenumber * 5 as varchar) as s from lineitem)""")
def factor_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    v = factor.factor(Vec(f.rows, F.col("l_linenumber") * 5))
    return v.rows.df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.expr.alias("x"))


@query("""select p_partkey, (dense_rank() over (order by p_name) - 1)::double as code from part""")
def factor_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.encode_by_join(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", "code").select("p_partkey", "code")


@query("""select o_orderkey, (o_orderstatus = 'F')::int::double as "o_orderstatus.F", (o_orderstatus = 'O')::int::double as "o_orderstatus.O", (o_orderstatus = 'P')::int::double as "o_orderstatus.P" from orders""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "orders").get("orders").select(["o_orderkey", "o_orderstatus"])
    return factor.one_hot(f, "o_orderstatus").df


@query("""select o_orderkey, round((o_totalprice - m) / s, 8) as o_totalprice from orders, (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = factor.standardize(tables(spark, sf_dir, "orders").get("orders").select(["o_orderkey", "o_totalprice"]), ["o_totalprice"])
    return f.df.withColumn("o_totalprice", ieee.rounded(F.col("o_totalprice"), 8))


@query("""select count(*) as n, round(avg(l_quantity), 6) as x_mean, round(avg(l_extendedprice), 4) as y_mean, round(stddev_samp(l_quantity), 6) as x_sd, round(stddev_samp(l_extendedprice), 4) as y_sd,
round(var_samp(l_quantity), 6) as x_var, round(var_samp(l_extendedprice), 0) as y_var, round(covar_samp(l_quantity, l_extendedprice), 2) as covariance, round(corr(l_quantity, l_extendedprice), 8) as correlation from lineitem""")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.covariance(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_quantity"), F.col("l_extendedprice"))
    digits = {"x_mean": 6, "y_mean": 4, "x_sd": 6, "y_sd": 4, "x_var": 6, "y_var": 0, "covariance": 2, "correlation": 8}
    return out.select("n", *(ieee.rounded(F.col(c), d).alias(c) for c, d in digits.items()))


@query("""with a as (select regr_count(y, x) as n, regr_intercept(y, x) as b0, regr_slope(y, x) as b1, regr_r2(y, x) as r2, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, avg(x) as mx
from (select l_quantity as x, case when l_tax = 0 then null else l_extendedprice end as y from lineitem) where y is not null)
select n as rows, round(b0, 5) as beta0, round(b1, 6) as beta1, round(sqrt((syy - b1 * sxy) / (n - 2) * (1.0 / n + mx * mx / sxx)), 5) as beta0_std_err, round(sqrt((syy - b1 * sxy) / (n - 2) / sxx), 6) as beta1_std_err,
round(r2, 8) as r2, round(syy / 1e6, 3) as ssto, round((syy - b1 * sxy) / 1e6, 3) as sse, round(b1 * sxy / 1e6, 3) as ssr from a""")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = stats.linear_regression(df, F.col("l_quantity"), F.when(F.col("l_tax") != 0, F.col("l_extendedprice")))
    return out.select(
        F.col("rows").cast("long").alias("rows"), ieee.rounded(F.col("beta0"), 5).alias("beta0"), ieee.rounded(F.col("beta1"), 6).alias("beta1"), ieee.rounded(F.col("beta0_std_err"), 5).alias("beta0_std_err"),
        ieee.rounded(F.col("beta1_std_err"), 6).alias("beta1_std_err"), ieee.rounded(F.col("r2"), 8).alias("r2"), *(ieee.rounded(F.col(c) / 1e6, 3).alias(c) for c in ("ssto", "sse", "ssr")),
    )


@query("""select class, n as count, round(n / sum(n) over (), 8) as ratio from (select c_nationkey::bigint as class, count(*) as n from customer group by all)""")
def class_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.class_ratios(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey")).withColumn("ratio", ieee.rounded(F.col("ratio"), 8))


@query("select * from customer where c_nationkey in (3, 7)")
def rows_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.rows_of_classes(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_nationkey"), [3, 7])


@query("""with p as (select l_quantity as x, l_tax as y from lineitem), r as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p)
select least(floor((x - x0) / (x1 - x0) * 40), 39)::int as px, least(floor((y - y0) / (y1 - y0) * 30), 29)::int as py, least(count(*), 255) as count from p, r group by all""")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_quantity"), F.col("l_tax"), 40, 30).withColumn("count", F.col("count").cast("long"))


_TS = [k / 10 for k in range(10)]


@query("""with t as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as threshold), p as (select l_returnflag = 'R' as a, l_quantity / 50 as m from lineitem)
select threshold, sum((not a and m < threshold)::int)::bigint as tn, sum((not a and m >= threshold)::int)::bigint as fp, sum((a and m < threshold)::int)::bigint as fn, sum((a and m >= threshold)::int)::bigint as tp from p, t group by all""")
def confusion_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.threshold_counts(df, (F.col("l_returnflag") == "R").cast("double"), F.col("l_quantity") / 50, _TS)


@query("""with t as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as h), p as (select l_returnflag = 'R' as a, l_quantity / 50 as m from lineitem),
c as (select h, sum((not a and m >= h)::int) / sum((not a)::int) as x, sum((a and m >= h)::int) / sum(a::int) as y from p, t group by all),
d as (select x, y, lag(x, 1, 1) over (order by h) as x0, lag(y, 1, 1) over (order by h) as y0, row_number() over (order by h desc) as k from c)
select round(sum((x0 - x) * (y0 + y) / 2) + sum(case when k = 1 then x * y / 2 else 0 end), 8) as auc from d""")
def area_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = confusion_by_threshold(spark, sf_dir).collect()
    return spark.createDataFrame([(round(stats.auc([tuple(r) for r in m]), 8),)], "auc double")


@query("""select l_returnflag as actual, case when l_quantity > 25 then 'R' else 'N' end as predicted, count(*) as count from lineitem group by all""")
def confusion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.confusion(df, F.col("l_returnflag"), F.when(F.col("l_quantity") > 25, "R").otherwise("N"))


@query("""select count(*) as n, sum(l_quantity * l_quantity) as xx_0_0, round(sum(l_quantity * l_tax), 6) as xx_0_1, sum(l_quantity) as xx_0_2, round(sum(l_tax * l_tax), 6) as xx_1_1, round(sum(l_tax), 6) as xx_1_2, count(*)::double as xx_2_2,
round(sum(l_quantity * l_extendedprice), 0) as xy_0, round(sum(l_tax * l_extendedprice), 1) as xy_1, round(sum(l_extendedprice), 1) as xy_2 from lineitem""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = stats.gram(df, [F.col("l_quantity"), F.col("l_tax")], F.col("l_extendedprice")).drop("yy")
    digits = {"xx_0_1": 6, "xx_1_1": 6, "xx_1_2": 6, "xy_0": 0, "xy_1": 1, "xy_2": 1}
    return out.select(*(ieee.rounded(F.col(c), digits[c]).alias(c) if c in digits else c for c in out.columns))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) where (r - 2) % 5 <> 0 or r < 2 and (r + 3) % 5 <> 0")
def fold_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fold(tables(spark, sf_dir, "orders").get("orders"), 5, 2).df.select("o_orderkey")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) where r % 5 = 2")
def fold_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fold(tables(spark, sf_dir, "orders").get("orders"), 5, 2, complement=True).df.select("o_orderkey")


@query("select count(*) // 3 as n, count(*) // 3 as distinct_keys from orders")
def random_filter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "orders").get("orders")
    return rows.random_rows(f, len(f) // 3, 12345).df.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"))


@query("select 1000 as n, 123.0::double as selected")
def random_bit_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(Registry(spark), "randomBitVector(1000, 123, 12345)").df.agg(F.count("*").alias("n"), F.sum("bits").alias("selected"))


@query("select o_orderstatus, least(n, case o_orderstatus when 'F' then 40 when 'O' then 25 else 7 end) as n from (select o_orderstatus, count(*) as n from orders group by o_orderstatus)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.stratified(df, F.col("o_orderstatus"), {"F": 40, "O": 25, "P": 7}, F.col("o_orderkey"), 7).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


#: The uniform number of rows.uniform() for a key and a seed, in SQL.
_UNIFORM = "(('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 13))::bigint / 4503599627370496.0::double)"


@query(f"select * from orders where {_UNIFORM.format(seed=1, key='o_orderkey')} < 0.67")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.bernoulli(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey"), 0.67, 1)


@query(f"""with u as (select *, {_UNIFORM.format(seed=1, key='o_orderkey')} as u from orders),
n as (select *, len(list_filter({rows.poisson_steps(0.67)}, lambda c: u >= c)) as n from u)
select * exclude (u, n, k) from (select *, unnest(range(n)) as k from n)""")
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_replacement(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey"), 0.67, 1)


@query(f"""with u as (select o_orderkey, o_orderstatus, {_UNIFORM.format(seed=7, key='o_orderkey')} as u from orders),
n as (select *, case o_orderstatus when 'F' then len(list_filter({rows.poisson_steps(0.5)}, lambda c: u >= c)) when 'P' then len(list_filter({rows.poisson_steps(2.0)}, lambda c: u >= c)) else 0 end as n from u)
select o_orderkey, o_orderstatus from (select *, unnest(range(n)) as k from n)""")
def stratified_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return rows.stratified_with_replacement(df, F.col("o_orderstatus"), {"F": 0.5, "P": 2.0}, F.col("o_orderkey"), 7)


@query("select 'Intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 4) as beta from lineitem union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) from lineitem")
def glm_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = glm.fit(tables(spark, sf_dir, "lineitem").get("lineitem"), "l_extendedprice", ["l_quantity"], lam=0.0)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in m.coefficients.items()], "term string, beta double")


@query("""select 'F' as term, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 2) as beta from orders union all select 'O', round(avg(o_totalprice) filter (o_orderstatus = 'O'), 2) from orders
union all select 'P', round(avg(o_totalprice) filter (o_orderstatus = 'P'), 2) from orders""")
def glm_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one term for each class the fitted means are the classes' means."""
    m = glm.fit(tables(spark, sf_dir, "orders").get("orders"), "o_totalprice", ["o_orderstatus"], lam=0.0, solver="GenGradient")
    c = m.coefficients
    return spark.createDataFrame([(k, round(c[f"o_orderstatus.{k}"] + c["Intercept"], 2)) for k in "FOP"], "term string, beta double")


@query("""with g as (select l_linestatus = 'O' as z, avg((l_returnflag = 'R')::int) as p from lineitem group by all)
select round((select ln(p / (1 - p)) from g where not z), 5) as intercept, round((select ln(p / (1 - p)) from g where z) - (select ln(p / (1 - p)) from g where not z), 5) as slope""")
def glm_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one 0/1 predictor the log-odds of both groups are known."""
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    f = Frame(f.rows, {"y": f.columns["l_returnflag"], "x": (F.col("l_linestatus") == "O").cast("double")})
    c = glm.fit(f, "y", ["x"], family="binomial", case=Case.parse("=R"), lam=0.0, beta_eps=1e-8).coefficients
    return spark.createDataFrame([(round(c["Intercept"], 5), round(c["x"], 5))], "intercept double, slope double")


@query("""with g as (select l_linestatus = 'O' as z, avg(l_linenumber) as p from lineitem group by all)
select round((select ln(p) from g where not z), 5) as intercept, round((select ln(p) from g where z) - (select ln(p) from g where not z), 5) as slope""")
def glm_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    f = Frame(f.rows, {"y": f.columns["l_linenumber"], "x": (F.col("l_linestatus") == "O").cast("double")})
    c = glm.fit(f, "y", ["x"], family="poisson", lam=0.0, beta_eps=1e-8).coefficients
    return spark.createDataFrame([(round(c["Intercept"], 5), round(c["x"], 5))], "intercept double, slope double")


@query("""with g as (select l_linestatus = 'O' as z, avg(l_quantity) as p from lineitem group by all)
select round((select 1 / p from g where not z), 7) as intercept, round((select 1 / p from g where z) - (select 1 / p from g where not z), 7) as slope""")
def glm_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    f = Frame(f.rows, {"y": f.columns["l_quantity"], "x": (F.col("l_linestatus") == "O").cast("double")})
    c = glm.fit(f, "y", ["x"], family="gamma", lam=0.0, beta_eps=1e-10).coefficients
    return spark.createDataFrame([(round(c["Intercept"], 7), round(c["x"], 7))], "intercept double, slope double")


@query()
def glm_elastic_net_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    models = glm.grid(f, "l_returnflag", "0.001,0.01", "0,0.5", predictors=["l_quantity", "l_extendedprice", "l_tax"], family="binomial", case=Case.parse("=R"), max_iter=8)
    return spark.createDataFrame([(m.lam, m.alpha, m.validation.auc, m.validation.error) for m in models], "lambda double, alpha double, auc double, error double")


@query()
def glm_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "orders").get("orders")
    m = glm.fit(f, "o_totalprice", ["o_custkey", "o_orderstatus"], folds=3, lam=1e-3)
    return spark.createDataFrame([(k, v.n, v.deviance, v.null_deviance) for k, v in enumerate(m.folds)], "fold int, n long, deviance double, null_deviance double")


_CENTRES = [[5.0, 0.01], [25.0, 0.04], [45.0, 0.07]]


@query("""with p as (select l_quantity as x, l_tax as y, (l_quantity - 5) * (l_quantity - 5) + (l_tax - 0.01) * (l_tax - 0.01) as a, (l_quantity - 25) * (l_quantity - 25) + (l_tax - 0.04) * (l_tax - 0.04) as b,
(l_quantity - 45) * (l_quantity - 45) + (l_tax - 0.07) * (l_tax - 0.07) as c from lineitem)
select case when a <= b and a <= c then 0 when b <= c then 1 else 2 end as cluster, count(*) as n, round(avg(x), 8) as l_quantity, round(avg(y), 8) as l_tax from p group by all""")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kmeans.lloyd_step(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_tax"], _CENTRES)
    return out.select("cluster", "n", ieee.rounded(F.col("l_quantity"), 8).alias("l_quantity"), ieee.rounded(F.col("l_tax"), 8).alias("l_tax"))


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem")
    return kmeans.score(kmeans.fit(f, 4, ["l_quantity", "l_extendedprice"], max_iter=15), f)


SCORECARD = """<PMML><DataDictionary><DataField name="quantity" dataType="double"/><DataField name="flag" dataType="string"/><DataField name="tax" dataType="double"/></DataDictionary>
<Scorecard initialScore="10"><Characteristics>
<Characteristic name="q"><Attribute partialScore="-5"><SimplePredicate field="quantity" operator="isMissing"/></Attribute>
<Attribute partialScore="1.5"><SimplePredicate field="quantity" operator="lessOrEqual" value="10"/></Attribute>
<Attribute partialScore="2.25"><CompoundPredicate booleanOperator="and"><SimplePredicate field="quantity" operator="greaterThan" value="10"/><SimplePredicate field="quantity" operator="lessThan" value="30"/></CompoundPredicate></Attribute>
<Attribute partialScore="4"><SimplePredicate field="quantity" operator="greaterOrEqual" value="30"/></Attribute></Characteristic>
<Characteristic name="f"><Attribute partialScore="3"><SimplePredicate field="flag" operator="equal" value="R"/></Attribute>
<Attribute partialScore="-1"><SimpleSetPredicate field="flag" booleanOperator="isIn"><Array type="string">A "N"</Array></SimpleSetPredicate></Attribute></Characteristic>
<Characteristic name="t"><Attribute partialScore="0.5"><SimplePredicate field="tax" operator="equal" value="0.05"/></Attribute></Characteristic>
</Characteristics></Scorecard></PMML>"""


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, 10 + case when l_quantity <= 10 then 1.5 when l_quantity < 30 then 2.25 else 4 end + case when l_returnflag = 'R' then 3 else -1 end
+ case when l_tax = 0.05 then 0.5 else 0 end as score from lineitem""".replace("10 + case", "10::double + case"))
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = Pmml(SCORECARD).score(df, fields={"quantity": "l_quantity", "flag": "l_returnflag", "tax": "l_tax"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score")


_TREE = """<Segment><True/><TreeModel><Node score="low"><True/><Node score="low"><SimplePredicate field="{f}" operator="lessOrEqual" value="{t}"/></Node>
<Node score="high"><SimplePredicate field="{f}" operator="greaterThan" value="{t}"/></Node></Node></TreeModel></Segment>"""
ENSEMBLE = (
    '<PMML><DataDictionary><DataField name="class" dataType="string"/><DataField name="quantity" dataType="double"/><DataField name="price" dataType="double"/></DataDictionary>'
    '<MiningModel><MiningSchema><MiningField name="class" usageType="predicted"/></MiningSchema><Segmentation multipleModelMethod="majorityVote">'
    + "".join(_TREE.format(f=f, t=t) for f, t in (("quantity", 20), ("price", 30000), ("quantity", 35)))
    + "</Segmentation></MiningModel></PMML>"
)


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when (l_quantity > 20)::int + (l_extendedprice > 30000)::int + (l_quantity > 35)::int >= 2 then 'high' else 'low' end as class from lineitem""")
def tree_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = Pmml(ENSEMBLE).score(df, "class", {"quantity": "l_quantity", "price": "l_extendedprice"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "class")


@query("""with v as (select o_orderkey, unnest([o_custkey % 3, o_orderkey % 3, (o_custkey + o_orderkey) % 3]) as c from orders),
n as (select o_orderkey, c, count(*) as n from v group by all)
select o_orderkey, predicted from (select o_orderkey, c as predicted, row_number() over (partition by o_orderkey order by n desc, c) as k from n) where k = 1""")
def forest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    votes = df.select("o_orderkey", F.explode(F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 3, (F.col("o_custkey") + F.col("o_orderkey")) % 3)).alias("c"))
    return forest.majority_vote(votes, "o_orderkey", "c")


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables(spark, sf_dir, "lineitem").get("lineitem").select(["l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_returnflag"])
    m = forest.fit(f, "l_returnflag", ntree=3, depth=5)
    names, counts = forest.confusion(m, f, oob=True)
    return spark.createDataFrame([(a, b, int(counts[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "actual string, predicted string, count long")


@query("""select c_custkey, c_acctbal as number, c_nationkey::bigint as whole, c_mktsegment as segment, case when c_nationkey % 10 = 0 then null else c_nationkey::bigint end as holes, c_acctbal / 100 as percent from customer""")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text, then typed again: numbers, a number with holes and strays, percentages, categories."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = df.select(
        "c_custkey", F.col("c_acctbal").cast("string").alias("number"), F.col("c_nationkey").cast("string").alias("whole"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_nationkey") % 10 == 0, F.when(F.col("c_custkey") % 2 == 0, "?").otherwise("")).otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).alias("holes"),
        F.concat(F.col("c_acctbal").cast("string"), F.lit("%")).alias("percent"),
    )
    names = ["number", "whole", "segment", "holes", "percent"]
    return project(text, infer(text, names), ["c_custkey"])


@query("select x as b, count(*) as n from (select l_linenumber::double as x from lineitem) group by all")
def binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = factor.bin_edges(df, F.col("l_linenumber"))
    edge = F.array(*(F.lit(e) for e in edges))
    return df.select(F.array_min(F.filter(edge, lambda e: e >= F.col("l_linenumber"))).alias("b")).groupBy("b").agg(F.count("*").alias("n"))


def _written(lines: DataFrame, **options) -> str:
    """A folder of text files with the lines of df (value)."""
    path = new_path(lines.sparkSession)
    lines.write.options(**options).text(path)
    return path


@query("select o_orderkey, o_totalprice, o_orderstatus, o_custkey from orders")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a header each, as a table is exported."""
    path = new_path(spark)
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    df.repartition(3, "o_orderkey").write.option("header", True).csv(path)
    return read_delimited(spark, path).df


@query("""select row_number() over (order by c_custkey) - 1 as _rid, c_custkey, c_name || '; "' || c_mktsegment || '"' as name, c_acctbal from customer""")
def csv_quotes_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with separators and quotes inside; rows keep the files' and lines' order."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    lines = df.select(F.format_string('%d;"%s; ""%s""";%s', "c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("value"))
    f = read_delimited(spark, _written(lines), header=False)
    return f.with_rid.select("_rid", F.col("0").alias("c_custkey"), F.col("1").alias("name"), F.col("2").alias("c_acctbal"))


@query("""select p_partkey, p_size, case when p_partkey % 3 = 0 or p_partkey % 5 = 0 then null else p_retailprice end as p_retailprice from part""")
def csv_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows, surplus and empty fields, blank lines, carriage returns, and comments before the header."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").coalesce(1).sortWithinPartitions("p_partkey")
    end = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 5 == 0, "|").otherwise(F.concat(F.lit("|"), F.col("p_retailprice").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "|surplus").otherwise("")))
    body = df.select(F.concat(F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_size").cast("string"), end, F.lit("\r")).alias("value"))
    top = spark.createDataFrame([("# a 'note\r",), ("@relation\r",), ("p_partkey|p_size|p_retailprice\r",), ("-1|0|0.5\r",), ("\r",)], "value string").coalesce(1)
    lines = top.unionByName(body).coalesce(1)
    return read_delimited(spark, _written(lines), separator="|").df.filter("p_partkey >= 0")


@query("""select event_id, ts_text as ts, case when event_id % 4 = 0 then null else value end as value from (select *, date_trunc('second', ts) as ts_text from events)""")
def csv_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, and numbers with strays below the share at which a column is given up; tabs separate."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 8 == 0, "?").when(F.col("event_id") % 4 == 0, "").otherwise(F.col("value").cast("string"))
    lines = df.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), value).alias("value"))
    return read_delimited(spark, _written(lines), header=False, separator="\t").df.select(F.col("0").alias("event_id"), F.col("1").alias("ts"), F.col("2").alias("value"))


@query("select s_suppkey, null::double as tossed, s_acctbal from supplier")
def csv_bad_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric column of which half the values are no numbers is given up."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = df.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("17"), F.col("s_acctbal").cast("string")).alias("value"))
    f = read_delimited(spark, _written(lines), header=False)
    return f.df.select(F.col("0").alias("s_suppkey"), F.col("1").alias("tossed"), F.col("2").alias("s_acctbal"))


@query("select c_custkey, c_nationkey, c_acctbal from customer")
def gzip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed text with runs of blanks between its fields."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lines = df.select(F.format_string(" %d   %d  %s", "c_custkey", "c_nationkey", F.col("c_acctbal").cast("string")).alias("value"))
    f = import_path(spark, _written(lines, compression="gzip"), header=False)
    return f.df.select(*(F.col(str(k)).alias(c) for k, c in enumerate(("c_custkey", "c_nationkey", "c_acctbal"))))


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The nations, of which there are 25 whatever the scale."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()


@query("select n_nationkey, n_name, n_regionkey from nation")
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "n_nationkey,n_name,n_regionkey\n" + "".join(f"{r['n_nationkey']},'{r['n_name']}',{r['n_regionkey']}\n" for r in _nations(spark, sf_dir))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("nations.csv", text)
    write_bytes(spark, path := f"{new_path(spark)}/nations.zip", buf.getvalue())
    return import_path(spark, path).df


@query("select row_number() over (order by n_nationkey) - 1 as _rid, n_nationkey, n_name, n_regionkey from nation")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of two sheets, numbers in cells, names in them or shared."""
    found = _nations(spark, sf_dir)
    name = lambda k, r: f'<c r="B{k}" t="s"><v>{r["n_nationkey"]}</v></c>' if r["n_nationkey"] % 2 else f'<c r="B{k}" t="inlineStr"><is><t>{r["n_name"]}</t></is></c>'
    row = lambda k, r: f'<row r="{k}"><c r="A{k}"><v>{r["n_nationkey"]}</v></c>{name(k, r)}<c r="C{k}"><v>{r["n_regionkey"]}</v></c></row>'
    head = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABC", ("n_nationkey", "n_name", "n_regionkey"), strict=True)) + "</row>"
    sheet = '<worksheet xmlns="x"><sheetData>{}</sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x">' + "".join(f"<si><t>{r['n_name']}</t></si>" for r in found) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(head + "".join(row(k, r) for k, r in enumerate(found[:10], 2))))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format("".join(row(k, r) for k, r in enumerate(found[10:], 1))))
    write_bytes(spark, path := f"{new_path(spark)}/nations.xlsx", buf.getvalue())
    return import_path(spark, path).with_rid


@query("select * from orders")
def parquet_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_path(spark, f"{sf_dir}/orders.parquet").df
