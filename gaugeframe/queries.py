"""Registered queries: each applies an operator to whole tables; ``ORACLES`` has their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import table_queries as table_queries  # registers its own
from .functions import columns as fx
from .operators import joins, learn, matrix, profiles, search, series, space, stats
from .plans import verify
from .plans.spec import Panel
from .registry import ORACLES as ORACLES
from .registry import QUERIES as QUERIES
from .registry import query
from .registry import rounded as _r
from .registry import table as _t
from .streaming import windows


def _seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'2020-01-01 00:00:00', {c})")


def _series(spark, d):
    """Events as series: hours since 2020, numbered within each user; one row per user and second."""
    e = _t(spark, d, "events").select("user_id", "event_id", _seconds("ts").alias("s"), "value")
    return e.groupBy("user_id", "s").agg(F.max_by("value", "event_id").alias("value")).withColumn("hours", F.col("s") / 3600.0)


SERIES = "series as (select user_id, s, s / 3600.0 as hours, arg_max(value, event_id) as value from (select user_id, event_id, value, date_diff('second', timestamp '2020-01-01', ts) as s from events) group by user_id, s)"


# --- profiles ---------------------------------------------------------------------------------


@query("""select l_returnflag, cast(floor(l_quantity / 10) as bigint) as bin, round(avg(l_extendedprice), 4) as mean,
  round(coalesce(stddev_samp(l_extendedprice), 0), 4) as sd, round(coalesce(stddev_samp(l_extendedprice), 0) / sqrt(count(l_extendedprice)), 4) as sem, count(l_extendedprice) as n
  from lineitem group by 1, 2""")
def profile(spark, d):
    return _r(profiles.binned_profile(_t(spark, d, "lineitem"), F.col("l_quantity"), "l_extendedprice", 10.0, ["l_returnflag"]), "mean", "sd", "sem")


@query("select l_returnflag, cast(count(*) as double) as n, round(avg(l_extendedprice), 3) as mean, round(stddev_samp(l_extendedprice), 3) as sd from lineitem group by 1")
def weighted_merge(spark, d):
    parts = profiles.binned_profile(_t(spark, d, "lineitem"), F.col("l_quantity"), "l_extendedprice", 10.0, ["l_returnflag"])
    return _r(profiles.pooled(parts, ["l_returnflag"], "n", "mean", "sd").withColumn("n", F.col("n").cast("double")), "mean", "sd", digits=3)


@query("""with r as (select l_suppkey, l_quantity, l_extendedprice, cast(floor((row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber, l_extendedprice) - 1) / 50) as bigint) as bin from lineitem)
  select l_suppkey, bin, min(l_quantity) as "start", max(l_quantity) as "end", round(avg(l_extendedprice), 4) as mean, count(*) as n from r group by 1, 2""")
def equal_support(spark, d):
    return _r(profiles.equal_support(_t(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice"], 50, "l_quantity", "l_extendedprice"), "mean")


@query("""with i as (select p_partkey, p_retailprice - 5 as lo, p_retailprice + 5 as hi from part where p_size = 1)
  select o_orderkey, p_partkey from orders join i on o_totalprice / 100 >= lo - 1e-9 and o_totalprice / 100 <= hi + 1e-9""")
def range_join(spark, d):
    i = _t(spark, d, "part").where("p_size = 1").select("p_partkey", (F.col("p_retailprice") - 5).alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    return profiles.in_intervals(o, i, "at", "lo", "hi", 10.0).select("o_orderkey", "p_partkey")


@query("""select l_returnflag, least(cast(floor((l_extendedprice - 0) / 2000) as bigint), 49) as bin, count(*) as n from lineitem where l_extendedprice between 0 and 100000 group by 1, 2""")
def histogram(spark, d):
    return profiles.histogram(_t(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 50, ["l_returnflag"])


@query("""with h as (select l_returnflag as g, least(cast(floor(l_extendedprice / 2000) as bigint), 49) as bin, count(*) as n from lineitem where l_extendedprice between 0 and 100000 group by 1, 2),
  c as (select g, bin, sum(n) over u as w0, sum(n) over (partition by g) - sum(n) over u as w1, sum(n * bin) over u as s0, sum(n * bin) over (partition by g) - sum(n * bin) over u as s1 from h window u as (partition by g order by bin))
  select g as l_returnflag, arg_max(bin, (round(w0 * w1 * (s0 / w0 - s1 / w1) * (s0 / w0 - s1 / w1), 3), -bin)) as cut from (select g, bin, cast(w0 as double) as w0, cast(w1 as double) as w1, cast(s0 as double) as s0, cast(s1 as double) as s1 from c where w1 > 0) group by 1""")
def otsu_cut(spark, d):
    h = profiles.histogram(_t(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 50, ["l_returnflag"])
    return profiles.otsu(h, ["l_returnflag"])


@query("""with h as (select event_type, least(cast(floor(value / 5) as bigint), 99) as bin, count(*) as n from events where value between 0 and 500 group by 1, 2),
  c as (select event_type, bin, sum(n) over (partition by event_type order by bin) as running, sum(n) over (partition by event_type) as total from h)
  select event_type, min(bin) as bin from c where running >= 0.9 * total group by 1""")
def histogram_quantile(spark, d):
    return profiles.histogram_quantile(profiles.histogram(_t(spark, d, "events"), "value", 0.0, 500.0, 100, ["event_type"]), ["event_type"], 0.9)


@query("""with c as (select l_returnflag, l_linestatus, l_suppkey % 20 as stack, cast(floor(l_quantity / 10) as bigint) as x, cast(floor(l_extendedprice / 10000) as bigint) as y, count(*) as n from lineitem group by all),
  s as (select l_returnflag, l_linestatus, stack, sum(n) as size from c group by all), t as (select l_returnflag, l_linestatus, sum(size) as total, count(*) as stacks from s group by all)
  select l_returnflag, l_linestatus, x, y, cast(sum(n) as bigint) as n, count(*) as present, round(sum(n) / max(total), 8) as pooled, round(sum(n / size) / max(stacks), 8) as balanced
  from c join s using (l_returnflag, l_linestatus, stack) join t using (l_returnflag, l_linestatus) group by 1, 2, 3, 4""")
def density_2d(spark, d):
    li = _t(spark, d, "lineitem").withColumn("stack", F.col("l_suppkey") % 20)
    return _r(profiles.density_2d(li, fx.bin_index(F.col("l_quantity"), 10.0), fx.bin_index(F.col("l_extendedprice"), 10000.0), ["l_returnflag", "l_linestatus"], "stack"), "pooled", "balanced", digits=8)


@query("""with c as (select l_shipdate is not null and l_quantity > 25 as a, l_discount > 0.05 as b, l_returnflag from lineitem)
  select l_returnflag, count(*) filter (a and b) as "both", count(*) filter (a and not b) as only_a, count(*) filter (not a and b) as only_b, count(*) filter (not a and not b) as neither,
  round(count(*) filter (a and b) / count(*) filter (a or b), 8) as jaccard, round(count(*) filter (a and b) / count(*) filter (a), 8) as b_given_a, round(count(*) filter (a and b) / count(*) filter (b), 8) as a_given_b from c group by 1""")
def quadrants(spark, d):
    return _r(profiles.quadrants(_t(spark, d, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, ["l_returnflag"]), "jaccard", "b_given_a", "a_given_b", digits=8)


@query("""with w as (select event_type, greatest(value, 0) as w, radians(((user_id * 7) % 360)) as a from events)
  select event_type, round(degrees(atan2(sum(w * sin(a)), sum(w * cos(a)))), 4) + 0 as direction, round(sqrt(sum(w * sin(a)) ** 2 + sum(w * cos(a)) ** 2) / sum(w), 6) as strength from w group by 1""")
def circular(spark, d):
    return _r(_r(profiles.first_moment(_t(spark, d, "events"), (F.col("user_id") * 7) % 360, F.col("value"), ["event_type"]), "direction"), "strength", digits=6)


@query("""select l_suppkey, count(*) filter (l_quantity - 25 > 0.5) as "right", count(*) filter (l_quantity - 25 < -0.5) as "left",
  round(1 - abs(count(*) filter (l_quantity - 25 > 0.5) - count(*) filter (l_quantity - 25 < -0.5)) / nullif(count(*) filter (l_quantity - 25 > 0.5 or l_quantity - 25 < -0.5), 0), 8) as bilaterality from lineitem group by 1""")
def bilaterality(spark, d):
    return _r(profiles.bilaterality(_t(spark, d, "lineitem"), F.col("l_quantity") - 25, ["l_suppkey"]), "bilaterality", digits=8)


@query("""with p as (select l_suppkey, cast(floor(l_quantity / 5) as bigint) as bin, count(*) as n from lineitem group by 1, 2),
  k as (select *, max(case when n >= 8 then 1 else 0 end) over (partition by l_suppkey order by bin) as f, max(case when n >= 8 then 1 else 0 end) over (partition by l_suppkey order by bin rows between current row and unbounded following) as t, max(case when n >= 8 then 1 else 0 end) over (partition by l_suppkey) as a from p)
  select l_suppkey, bin, n from k where a = 0 or (f = 1 and t = 1)""")
def edge_trim(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_suppkey", fx.bin_index(F.col("l_quantity"), 5.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return profiles.trim_edges(p, ["l_suppkey"], "bin", F.col("n") >= 8)


@query("""with r as (select l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as k, count(*) over (partition by l_suppkey) as c from lineitem)
  select l_suppkey, round(avg(l_extendedprice), 4) as mean, count(*) as n from r where k <= greatest(ceil(c * 0.1), 1) group by 1""")
def top_fraction(spark, d):
    return _r(profiles.top_fraction(_t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "l_extendedprice", 0.1), "mean")


@query("""with h as (select event_type, least(cast(floor(value / 5) as bigint), 99) as bin, count(*) as n from events where value between 0 and 500 group by 1, 2),
  s as (select event_type, bin, n, round(avg(n) over (partition by event_type order by bin rows between 2 preceding and 2 following), 6) as s from h), m as (select event_type, arg_min(bin, (-s, bin)) as level from s group by 1),
  l as (select event_type, level, greatest(sqrt(sum(n * (bin - level) * (bin - level)) / sum(n)), 1.0) as spread from s join m using (event_type) where bin <= level group by 1, 2)
  select event_type, level, round(spread, 6) as spread, round(level + 2.5 * spread, 6) as threshold from l""")
def background(spark, d):
    h = profiles.histogram(_t(spark, d, "events"), "value", 0.0, 500.0, 100, ["event_type"])
    return _r(profiles.background(h, ["event_type"], 2, 2.5), "spread", "threshold", digits=6)


@query("""select l_suppkey, l_linenumber, count(*) as area, round(avg(l_quantity), 5) as cx, round(avg(l_discount), 5) as cy, round(avg(l_extendedprice), 3) as mean, max(l_extendedprice) as "max" from lineitem where l_linenumber <> 0 group by 1, 2""")
def region_table(spark, d):
    return _r(_r(profiles.region_table(_t(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"), "cx", "cy", digits=5), "mean", digits=3)


@query("""with m as (select l_returnflag, median(l_extendedprice) as m from lineitem group by 1) select l_quantity, l_linenumber, round(median(l_extendedprice / m), 5) as field from lineitem join m using (l_returnflag) group by 1, 2""")
def illumination(spark, d):
    return _r(profiles.illumination(_t(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber", "l_extendedprice"), "field", digits=5)


@query("""with p as (select distinct user_id % 10 as g, date_diff('day', timestamp '2020-01-01', ts) // 7 as week, user_id as px from events), a as (select g, week, count(*) as area, lead(week) over w as nxt, lead(count(*)) over w as na from p group by 1, 2 window w as (partition by g order by week)),
  s as (select g, week, nxt, count(*) as k from (select g, week, lead(week) over (partition by g, px order by week) as nxt from p) where nxt is not null group by 1, 2, 3)
  select a.g, a.week, a.nxt as "next", round(coalesce(k, 0) / (area + na - coalesce(k, 0)), 6) as jaccard, round(na / area - 1, 6) + 0 as growth from a left join s on a.g = s.g and a.week = s.week and a.nxt = s.nxt where a.nxt is not null""")
def mask_overlap(spark, d):
    p = _t(spark, d, "events").select((F.col("user_id") % 10).alias("g"), F.expr("timestampdiff(DAY, timestamp_ntz'2020-01-01 00:00:00', ts) div 7").alias("week"), F.col("user_id").alias("px")).distinct()
    return _r(profiles.mask_overlap(p, ["g"], "week", "px"), "jaccard", "growth", digits=6)


# --- matrices: suppliers by brands of their parts, the value being a quantity --------------------


def _matrix(spark, d):
    li = _t(spark, d, "lineitem").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").where("l_quantity > 20")
    return li.groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("v"))


MATRIX = "x as (select l_suppkey, p_brand, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey where l_quantity > 20 group by 1, 2)"


@query(f"""with {MATRIX} select l_suppkey, round(sum(v), 3) as total, count(*) filter (v > 0) as n_features, round(100 * sum(case when p_brand like '%1' then v else 0 end) / sum(v), 6) as pct_ones from x group by 1""")
def row_metrics(spark, d):
    return _r(_r(matrix.row_metrics(_matrix(spark, d), "l_suppkey", "v", {"pct_ones": F.col("p_brand").endswith("1")}), "total", digits=3), "pct_ones", digits=6)


@query(f"""with {MATRIX}, m as (select l_suppkey, sum(v) as total, count(*) as k from x group by 1)
  select count(*) as n, count(*) filter (total >= 500 and k between 5 and 24) as passed, count(*) filter (not total >= 500) as failed_total, count(*) filter (not k between 5 and 24) as failed_features from m""")
def qc_audit(spark, d):
    m = matrix.row_metrics(_matrix(spark, d), "l_suppkey", "v", {})
    return matrix.audit(m, {"total": F.col("total") >= 500, "features": F.col("n_features").between(5, 24)})


@query(f"""with {MATRIX}, n as (select count(*) as n from supplier), m as (select p_brand, count(*) filter (v <> 0) as nnz, sum(v) / max(n) as mean, sqrt(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) ** 2, 0)) as sd from x, n group by 1)
  select p_brand, nnz, round(mean, 5) as mean, round(sd, 5) as sd from m where mean > 1 and sd > 1""")
def feature_filter(spark, d):
    return _r(matrix.feature_filter(_matrix(spark, d), _t(spark, d, "supplier"), "p_brand", "v", 1.0, 1.0), "mean", "sd", digits=5)


@query(f"""with {MATRIX}, n as (select count(*) as n from supplier), m as (select p_brand, sqrt(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) ** 2, 0)) as sd from x, n group by 1)
  select l_suppkey, p_brand, round(v / case when sd = 0 then 1 else sd end, 6) as v from x join m using (p_brand)""")
def unit_variance(spark, d):
    return _r(matrix.unit_variance(_matrix(spark, d), _t(spark, d, "supplier"), "p_brand", "v"), "v", digits=6)


@query(f"""with {MATRIX}, t as (select l_suppkey, sum(v) as total from x group by 1), m as (select median(total) as target from t)
  select l_suppkey, p_brand, round(v * target / total, 6) as v from x join t using (l_suppkey), m""")
def normalize_total(spark, d):
    return _r(matrix.normalize_total(_matrix(spark, d), "l_suppkey", "v"), "v", digits=6)


@query(f"""with {MATRIX}, g as (select s_nationkey, count(*) as n from supplier group by 1), s as (select s_nationkey, p_brand, sum(v) as s, count(*) filter (v > 0) as p from x join supplier on l_suppkey = s_suppkey group by 1, 2)
  select g.s_nationkey, f.p_brand, round(coalesce(s, 0) / n, 6) as mean, round(coalesce(p, 0) / n, 6) as fraction from g cross join (select distinct p_brand from x) f left join s on s.s_nationkey = g.s_nationkey and s.p_brand = f.p_brand""")
def group_means(spark, d):
    labels = _t(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return _r(matrix.group_means(_matrix(spark, d), labels, "l_suppkey", "p_brand", "v", "s_nationkey"), "mean", "fraction", digits=6)


@query(f"""with {MATRIX}, n as (select count(*) as n from supplier), m as (select p_brand, sum(v) / max(n) as m, sqrt(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) ** 2, 0)) as sd from x, n group by 1),
  p as (select a.p_brand as a, b.p_brand as b, sum(a.v * b.v) as s from x a join x b using (l_suppkey) where a.p_brand < b.p_brand group by 1, 2)
  select ma.p_brand as a, mb.p_brand as b, round((coalesce(s, 0) / n - ma.m * mb.m) / (ma.sd * mb.sd), 6) + 0 as r from m ma join m mb on ma.p_brand < mb.p_brand and ma.sd > 0 and mb.sd > 0 left join p on a = ma.p_brand and b = mb.p_brand, n""")
def feature_correlations(spark, d):
    return _r(matrix.feature_correlations(_matrix(spark, d), _t(spark, d, "supplier"), "l_suppkey", "p_brand", "v"), "r", digits=6)


@query(f"""with {MATRIX}, g as (select s_nationkey as k, p_brand, sum(v) as v from x join supplier on l_suppkey = s_suppkey group by 1, 2)
  select a.k as a, b.k as b, round(corr(a.v, b.v), 6) + 0 as r, count(*) as n from g a join g b using (p_brand) where a.k < 10 and b.k >= 10 group by 1, 2 having count(*) > 20""")
def profile_correlations(spark, d):
    g = _matrix(spark, d).join(_t(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").groupBy(F.col("s_nationkey").alias("k"), "p_brand").agg(F.sum("v").alias("v"))
    return _r(matrix.profile_correlations(g.where("k < 10"), g.where("k >= 10"), "k", "p_brand", "v").where("n > 20"), "r", digits=6)


@query("""select c_mktsegment, n_name, count(*) as n, round(count(*) / sum(count(*)) over (partition by c_mktsegment), 8) as row_share, round(count(*) / sum(count(*)) over (partition by n_name), 8) as column_share
  from customer join nation on c_nationkey = n_nationkey group by 1, 2""")
def crosstab(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _r(matrix.crosstab(c, "c_mktsegment", "n_name"), "row_share", "column_share", digits=8)


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2)
  select c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) as mode, round(max(n) / sum(n), 8) as share from c group by 1""")
def mode_share(spark, d):
    return _r(matrix.mode_share(_t(spark, d, "customer"), "c_nationkey", "c_mktsegment"), "share", digits=8)


@query("""select cast(3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) as bigint) as level, r_name, n_name, c_mktsegment, round(sum(c_acctbal), 2) as balance, cast(count(*) as bigint) as n, round(sum(c_acctbal) / count(*), 4) as ratio
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)""")
def rollup4(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.withColumns({"balance": F.col("c_acctbal"), "n": F.lit(1).cast("long")})
    return _r(_r(matrix.rollup_levels(c, ["r_name", "n_name", "c_mktsegment"], ["balance", "n"], ("balance", "n")), "ratio"), "balance", digits=2)


@query("""with i as (select l_suppkey, l_returnflag, median(l_extendedprice) as m from lineitem group by 1, 2 having count(l_extendedprice) >= 5)
  select l_returnflag, round(median(m), 4) as median, count(*) as n_groups from i group by 1""")
def nested_median(spark, d):
    return _r(matrix.nested_median(_t(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_returnflag"], "l_extendedprice", 5), "median")


@query("""with m as (select l_suppkey, median(l_quantity) as med from lineitem group by 1)
  select l_suppkey, round(max(med), 4) as median, round(greatest(1.4826 * median(abs(l_quantity - med)), 13.0), 4) as sigma from lineitem join m using (l_suppkey) group by 1""")
def robust_sigma(spark, d):
    return _r(matrix.robust_sigma(_t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 13.0), "median", "sigma")


@query(f"""with {MATRIX}, z as (select l_suppkey, p_brand, coalesce((v - avg(v) over w) / nullif(stddev_pop(v) over w, 0), 0) as z from x window w as (partition by p_brand)), b as (select distinct p_brand, p_brand[-1] as "set" from part)
  select l_suppkey, "set", round(avg(z), 6) + 0 as score from z join b using (p_brand) group by 1, 2""")
def set_scores(spark, d):
    members = _t(spark, d, "part").select("p_brand", F.substring("p_brand", -1, 1).alias("set")).distinct()
    return _r(matrix.set_scores(_matrix(spark, d), members, "l_suppkey", "p_brand", "v"), "score", digits=6)


@query(f"""with {MATRIX} select l_suppkey, p_brand, round(coalesce((v - avg(v) over w) / nullif(stddev_samp(v) over w, 0), 0), 5) + 0 as z from x window w as (partition by l_suppkey)""")
def row_zscores(spark, d):
    return _r(matrix.row_zscores(_matrix(spark, d), "l_suppkey", "v"), "z", digits=5).select("l_suppkey", "p_brand", "z")


# --- joins --------------------------------------------------------------------------------------


@query("""with t as (select distinct cast(l_partkey % 50 as varchar) as token from lineitem union select distinct p_name from part union select distinct p_brand from part union select 'none'),
  m as (select cast(p_partkey as varchar) as name, 0 as r, p_partkey as id from part union all select p_name, 1, p_partkey from part union all select p_brand, 2, p_partkey from part),
  b as (select name, min((r, id)) as x from m group by 1) select token, x[2] as resolved, cast(x[1] as bigint) as "by" from t left join b on token = name""")
def symbol_resolve(spark, d):
    p = _t(spark, d, "part")
    tokens = _t(spark, d, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("token"))
    tokens = tokens.union(p.select("p_name")).union(p.select("p_brand")).union(p.select(F.lit("none"))).distinct()
    return joins.resolve_symbols(tokens, "token", p, "p_partkey", ["p_name", "p_brand"])


@query("""select c_custkey, case when c_acctbal < 0 then 'OVERDRAWN' else c_mktsegment end as c_mktsegment from customer""")
def override_label(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    over = c.where("c_acctbal < 0").select("c_custkey", F.lit("OVERDRAWN").alias("c_mktsegment"))
    return joins.override_labels(c.drop("c_acctbal"), "c_custkey", "c_mktsegment", over)


@query("""with a as (select c_nationkey as k, count(*) as v from customer where c_nationkey < 20 group by 1), b as (select s_nationkey as k, count(*) as v from supplier where s_nationkey > 3 group by 1)
  select k, a.v as "left", b.v as "right", case when b.v is null then 'left_only' when a.v is null then 'right_only' else 'both' end as side from a full join b using (k)""")
def full_indicator(spark, d):
    a = _t(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = _t(spark, d, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return joins.reconcile(a, b, ["k"], "v")


@query("""with w as (select distinct p_size as k from part where p_retailprice > 1200), h as (select distinct cast(l_quantity as integer) as k from lineitem where l_discount > 0.02 and l_quantity >= 5)
  select k, 'missing' as status from w where not exists (select 1 from h where h.k = w.k) union all select k, 'unused' from h where not exists (select 1 from w where h.k = w.k)""")
def missing_unused(spark, d):
    wanted = _t(spark, d, "part").where("p_retailprice > 1200").select(F.col("p_size").alias("k"))
    known = _t(spark, d, "lineitem").where("l_discount > 0.02 and l_quantity >= 5").select(F.col("l_quantity").cast("int").alias("k"))
    return joins.missing_and_unused(wanted, known, "k")


@query("""with s as (select distinct c_nationkey as k, 'customers' as s from customer where c_acctbal > 5000 union select distinct s_nationkey, 'suppliers' from supplier where s_acctbal > 5000)
  select k, bool_or(s = 'customers') as in_customers, bool_or(s = 'suppliers') as in_suppliers, count(distinct s) as n_sources from s group by 1""")
def union_sources(spark, d):
    return joins.union_sources({"customers": _t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), "suppliers": _t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))}, "k")


@query(f"""with {SERIES}, t as (select user_id, min(s) + 3600 * 24 * 3 as target from series group by 1),
  e as (select user_id, s, min(event_id) as event_id from (select user_id, event_id, date_diff('second', timestamp '2020-01-01', ts) as s from events) group by 1, 2),
  r as (select t.user_id, target, s, event_id, row_number() over (partition by t.user_id order by abs(s - target), s) as k from t join e using (user_id))
  select user_id, target, s as event_time, event_id as event from r where k = 1""")
def nearest_time(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", _seconds("ts").alias("s"))
    t = e.groupBy("user_id").agg((F.min("s") + 3600 * 24 * 3).alias("target"))
    return joins.nearest_time(t, e, ["user_id"], "target", "s", "event_id")


@query("""with q as (select vec_id as q, embedding as v from embeddings where vec_id % 50 = 0 and embedding is not null),
  n as (select q, e.vec_id as r, row_number() over (partition by q order by round(sqrt(list_sum(list_transform(list_zip(v, e.embedding), lambda x: (cast(x[1] as double) - x[2]) * (cast(x[1] as double) - x[2])))), 9), e.vec_id) as k from q, embeddings e where e.vec_id <> q and e.embedding is not null),
  c as (select q, label, count(*) as n from n join embeddings on r = vec_id where k <= 15 group by 1, 2), p as (select q, label, n / sum(n) over (partition by q) as share, row_number() over (partition by q order by n desc, label) as k from c)
  select q, max(label) filter (k = 1) as label, round(max(share) filter (k = 1), 6) as share, round(max(share) filter (k = 1) - coalesce(max(share) filter (k = 2), 0), 6) as margin from p group by 1""")
def knn_vote(spark, d):
    e = _t(spark, d, "embeddings")
    near = joins.knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 16).where("q != r")
    from pyspark.sql import Window

    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where("rank <= 15")
    return _r(joins.vote(near, e, "vec_id", "label"), "share", "margin", digits=6)


@query("""with p as (select vec_id, label, unnest(range(len(embedding))) as i, cast(unnest(embedding) as double) as v from embeddings), c as (select label as centre, i, avg(v) as c from p group by 1, 2),
  r as (select vec_id, label, centre, round(corr(v, c), 9) as r from p join c using (i) group by 1, 2, 3) select vec_id, label, arg_min(centre, (-r, centre)) as nearest, round(max(r), 5) as r from r group by 1, 2""")
def nearest_centroid(spark, d):
    return _r(joins.nearest_centroid(_t(spark, d, "embeddings"), "vec_id", "embedding", "label"), "r", digits=5)


@query()
def label_transfer(spark, d):
    e = _t(spark, d, "embeddings")
    return learn.transfer_labels(e.where("vec_id % 50 = 0"), e.where("vec_id % 50 != 0"), "vec_id", "embedding", "label", 8, 15)


@query()
def marker_weights(spark, d):
    return learn.marker_weights(_t(spark, d, "embeddings"), "embedding", "label")


@query()
def batch_neighbours(spark, d):
    e = _t(spark, d, "embeddings").withColumn("batch", (F.col("vec_id") % 100 < 50).cast("int"))
    return learn.batch_neighbours(e, "vec_id", "batch", "embedding", [0, 1], 3, e.where("vec_id % 50 = 0"))


@query()
def communities(spark, d):
    e = _t(spark, d, "embeddings")
    near = joins.indexed_knn(e, e, "vec_id", "embedding", 6).where("q != r")
    return learn.communities(near.select(F.col("q").alias("a"), F.col("r").alias("b"), (1 / (1 + F.col("distance"))).alias("weight")), 4)


@query()
def chosen_features(spark, d):
    labels = _t(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return learn.chosen_features(_matrix(spark, d), labels, "l_suppkey", "p_brand", "v", "s_nationkey", 60, 0.8)


# --- series -------------------------------------------------------------------------------------


@query(f"with {SERIES} select user_id, s, round(avg(value) over (partition by user_id order by s rows between 2 preceding and 2 following), 5) as smooth from series")
def rolling_mean(spark, d):
    return _r(series.rolling_mean(_series(spark, d), ["user_id"], "s", "value", 5), "smooth", digits=5).select("user_id", "s", "smooth")


@query(f"""with {SERIES}, r as (select user_id, s, count(value) over w as n, median(value) over w as m from series window w as (partition by user_id order by s rows between 3 preceding and 3 following))
  select user_id, s, case when n >= 4 then round(m, 5) end as median from r""")
def rolling_median(spark, d):
    return _r(series.rolling_median(_series(spark, d), ["user_id"], "s", "value", 7, 4), "median", digits=5).select("user_id", "s", "median")


@query(f"""with {SERIES}, n as (select user_id, s, value as f, hours - lag(hours) over w as hs, lead(hours) over w - hours as hd, lag(value) over w as b, lead(value) over w as a from series window w as (partition by user_id order by s))
  select user_id, s, round(case when hs is null then (a - f) / hd when hd is null then (f - b) / hs else (hs * hs * a + (hd * hd - hs * hs) * f - hd * hd * b) / (hs * hd * (hs + hd)) end, 4) + 0 as slope from n""")
def gradient(spark, d):
    return _r(series.gradient(_series(spark, d), ["user_id"], "hours", "value"), "slope").select("user_id", "s", "slope")


@query(f"""with {SERIES}, n as (select user_id, hours as t0, lead(hours) over w as t1, value as y0, lead(value) over w as y1 from series window w as (partition by user_id order by s))
  select user_id, round((t0 + t1) / 2, 5) as mid, round((y1 - y0) / (t1 - t0), 4) + 0 as velocity from n where t1 > t0""")
def velocity(spark, d):
    return _r(_r(series.velocity(_series(spark, d), ["user_id"], "hours", "value"), "velocity"), "mid", digits=5)


NORMAL = f"""{SERIES}, k as (select *, row_number() over (partition by user_id order by s) as k from series), st as (select user_id, median(value) filter (k <= 3) as baseline, max(value) as peak from k group by 1),
  nm as (select user_id, s, hours, case when peak > baseline then (value - baseline) / (peak - baseline) end as scaled from series join st using (user_id))"""


@query(f"with {NORMAL} select user_id, s, round(scaled, 6) + 0 as scaled from nm")
def baseline_norm(spark, d):
    return _r(series.normalise(_series(spark, d), ["user_id"], "hours", "value", 3), "scaled", digits=6).select("user_id", "s", "scaled")


@query(f"""with {NORMAL}, g as (select user_id, hours as t1, scaled as y1, lag(hours) over w as t0, lag(scaled) over w as y0 from nm where scaled is not null window w as (partition by user_id order by s)),
  c as (select user_id, t1, y1, case when t0 is null or abs(y1 - y0) < 1e-12 then t1 else t0 + (0.5 - y0) * (t1 - t0) / (y1 - y0) end as hit from g)
  select user_id, case when count(*) >= 12 then round(arg_min(hit, t1) filter (y1 >= 0.5), 5) end as crossing from c group by 1""")
def half_max(spark, d):
    return _r(series.half_max(_series(spark, d), ["user_id"], "hours", "value"), "crossing", digits=5)


@query(f"""with {SERIES}, k as (select user_id, row_number() over (partition by user_id order by s) as i, value > 50 as f from series), r as (select user_id, i, f and lead(f, 1) over w and lead(f, 2) over w as ok from k window w as (partition by user_id order by i))
  select user_id, min(i) filter (ok) as onset from r group by 1""")
def onset(spark, d):
    from pyspark.sql import Window

    s = _series(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("s")).cast("long"))
    return series.onset(s, ["user_id"], "i", F.col("value") > 50, 3)


@query(f"""with {SERIES}, k as (select user_id, s, value > 50 as f, row_number() over (partition by user_id order by s) as i from series), j as (select user_id, s, i - row_number() over (partition by user_id order by s) as g from k where f),
  r as (select user_id, g, count(*) as n, min(s) as a, max(s) as b from j group by 1, 2), o as (select *, row_number() over (partition by user_id order by n desc, a) as k from r)
  select user_id, n as length, a as "start", b as "end" from o where k = 1""")
def longest_run(spark, d):
    return series.longest_run(_series(spark, d), ["user_id"], "s", F.col("value") > 50)


@query(f"""with {SERIES}, e as (select user_id, hours as event from series qualify row_number() over (partition by user_id order by value desc, s) = 1), m as (select user_id, hours - event as rel, value from series join e using (user_id)),
  c as (select user_id from m group by 1 having min(rel) <= -24 and max(rel) >= 24), g as (select user_id, -24 + i * 6.0 as p from c, range(9) t(i)),
  l as (select user_id, rel as t0, value as y0, lead(rel) over (partition by user_id order by rel) as t1, lead(value) over (partition by user_id order by rel) as y1 from m)
  select g.user_id, cast(p as double) as "at", round(case when t0 = p or t1 is null then y0 else y0 + (y1 - y0) * (p - t0) / (t1 - t0) end, 4) as value from g join l on l.user_id = g.user_id and t0 <= p and (p < t1 or (t1 is null and t0 = p))""")
def align_grid(spark, d):
    from pyspark.sql import Window

    s = _series(spark, d)
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "s"))
    e = s.withColumn("k", first).where("k = 1").select("user_id", F.col("hours").alias("event"))
    return _r(series.align(s.select("user_id", "hours", "value"), ["user_id"], "hours", "value", e, "event", -24.0, 24.0, 6.0), "value")


@query(f"""with {SERIES}, k as (select *, row_number() over (partition by user_id order by s) as u, row_number() over (partition by user_id order by s desc) as v from series)
  select user_id, round(median(value) filter (u <= 5), 5) as early, round(median(value) filter (v <= 5), 5) as late, round(max(value), 5) as peak, arg_min(s, (-value, s)) as peak_time from k group by 1""")
def ends_summary(spark, d):
    return _r(series.ends_summary(_series(spark, d), ["user_id"], "s", "value", 5), "early", "late", "peak", digits=5)


@query(f"""with {SERIES}, k as (select user_id, value - lag(value) over (partition by user_id order by s) as dv, arg_max(value, s) over (partition by user_id) - arg_min(value, s) over (partition by user_id) as net from series)
  select user_id, round(max(abs(dv)), 5) as max_step, round(any_value(net), 5) + 0 as net, round(avg(case when sign(dv) = sign(net) then 1.0 when dv is not null then 0.0 end), 6) as consistency from k group by 1""")
def step_summary(spark, d):
    return _r(_r(series.step_summary(_series(spark, d), ["user_id"], "s", "value"), "max_step", "net", digits=5), "consistency", digits=6)


@query(f"""with {SERIES}, b as (select user_id, cast(floor(hours / 24) as bigint) as day, avg(value) as v from series group by 1, 2), m as (select day, median(v) as m from b group by 1), o as (select user_id, day, v - m as off from b join m using (day)), p as (select day, 1.4826 * median(abs(off)) as sp from o group by 1)
  select user_id, day, round(off / nullif(sp, 0), 5) + 0 as z from o join p using (day)""")
def population_z(spark, d):
    b = _series(spark, d).groupBy("user_id", F.floor(F.col("hours") / 24).cast("long").alias("day")).agg(F.avg("value").alias("v"))
    return _r(series.population_z(b, ["user_id", "day"], ["day"], "v"), "z", digits=5)


@query("""select user_id, count(distinct event_type) as seen, 10 - count(distinct event_type) as missing, count(*) - count(distinct event_type) as repeated from events group by 1""")
def completeness(spark, d):
    return series.completeness(_t(spark, d, "events"), ["user_id"], "event_type", 10)


@query("""select o_orderkey, round(cume_dist() over (partition by o_orderpriority order by o_totalprice), 8) as share from orders""")
def ecdf(spark, d):
    return _r(series.ecdf(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "share", digits=8).select("o_orderkey", "share")


@query("""with b as (select l_returnflag as g, cast(l_quantity as double) as x, avg(l_extendedprice) as y from lineitem group by 1, 2),
  r as (select g, x, count(*) over u as n, sum(x) over u as sx, sum(y) over u as sy, sum(x * x) over u as sxx, sum(x * y) over u as sxy, sum(y * y) over u as syy, count(*) over v as m, sum(y) over v as ry, sum(y * y) over v as ryy from b
    window u as (partition by g order by x rows unbounded preceding), v as (partition by g order by x rows between 1 following and unbounded following)),
  e as (select g, x, (sxy - sx * sy / n) / (sxx - sx * sx / n) as slope, round(syy - sy * sy / n - (sxy - sx * sy / n) ** 2 / (sxx - sx * sx / n) + ryy - ry * ry / m, 3) as sse from r where n >= 3 and m >= 3)
  select g as l_returnflag, x as cut, round(slope, 4) as slope, round(sse / 1e6, 4) as sse from e qualify row_number() over (partition by g order by sse, x) = 1""")
def split_scan(spark, d):
    b = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.avg("l_extendedprice").alias("y"))
    return _r(series.split_scan(b, ["l_returnflag"], "l_quantity", "y").withColumn("sse", F.col("sse") / 1e6), "slope", "sse")


@query(f"""with {SERIES}, l as (select user_id, hours as t0, value as y0, lead(hours) over w as t1, lead(value) over w as y1 from series window w as (partition by user_id order by s)),
  g as (select user_id, s, hours, d, hours + d as p from series, (select unnest([-12.0, 12.0]) as d)),
  v as (select g.user_id, s, d, max(case when t0 = p then y0 else y0 + (y1 - y0) * (p - t0) / (t1 - t0) end) as y from g left join l on l.user_id = g.user_id and t0 <= p and (p < t1 or t0 = p) group by 1, 2, 3)
  select user_id, s, round((max(y) filter (d > 0) - max(y) filter (d < 0)) / 24, 5) + 0 as slope from v group by 1, 2""")
def centred_slope(spark, d):
    s = _series(spark, d)
    return _r(series.centred_slope(s, ["user_id"], "hours", "value", 24.0).join(s.select("user_id", "hours", "s"), ["user_id", "hours"]), "slope", digits=5).select("user_id", "s", "slope")


@query(f"""with {SERIES}, r as (select user_id, hours as x, value as v, least(floor((row_number() over (partition by user_id order by hours, value) - 1) * 5 / count(*) over (partition by user_id)), 4) as fold from series),
  f as (select a.user_id, a.fold, regr_slope(b.v, b.x) as m, regr_intercept(b.v, b.x) as c from (select distinct user_id, fold from r) a join r b on a.user_id = b.user_id and a.fold <> b.fold group by 1, 2)
  select user_id, round(sqrt(avg((v - c - m * x) ** 2)), 3) as rmse from r join f using (user_id, fold) group by 1""")
def blocked_error(spark, d):
    return _r(series.blocked_error(_series(spark, d), ["user_id"], "hours", "value", 5), "rmse", digits=3)


POINTS = "p as (select p_brand as g, p_partkey as id, cast(p_size as double) as x, p_retailprice / 50 as y from part)"


def _points(spark, d):
    return _t(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"))


@query(f"""with {POINTS} select a.g, a.id, round(min(case when sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 4 then sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) end), 6) as distance from p a left join p b on a.g = b.g and b.id % 10 = 0 where a.id % 10 <> 0 group by 1, 2""")
def near_distance(spark, d):
    p = _points(spark, d)
    return _r(space.near_distance(p.where("id % 10 != 0"), p.where("id % 10 = 0"), ["g"], "x", "y", 4.0), "distance", digits=6).select("g", "id", "distance")


@query()
def tracks(spark, d):
    p = _points(spark, d).withColumn("frame", F.col("id") % 7)
    return space.tracks(p, ["g"], "frame", "id", ["x", "y"], 3.0)


@query()
def regions(spark, d):
    return space.regions(_points(spark, d).withColumn("y", F.floor("y")), ["g"], "x", "y")


@query("""with r as (select l_suppkey, l_orderkey * 10 + l_linenumber as n, l_linenumber = 1 as title from lineitem qualify row_number() over (partition by l_suppkey, l_orderkey * 10 + l_linenumber) = 1)
  select l_suppkey, n, cast(sum(case when title then 1 else 0 end) over (partition by l_suppkey order by n) as bigint) as block from r""")
def title_blocks(spark, d):
    r = _t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), (F.col("l_linenumber") == 1).alias("title")).distinct()
    return space.title_blocks(r, ["l_suppkey"], "n", F.col("title")).drop("title")


@query("""select k, bool_or(s = 1) and bool_or(s = 2) as shared from (select distinct p_size as k, 1 as s from part where p_retailprice > 1200 union all select distinct cast(l_quantity as integer), 2 from lineitem where l_discount > 0.05) group by 1""")
def feature_sets(spark, d):
    a, b = _t(spark, d, "part").where("p_retailprice > 1200").select(F.col("p_size").alias("k")), _t(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_quantity").cast("int").alias("k"))
    return a.intersect(b).withColumn("shared", F.lit(True)).unionByName(a.union(b).distinct().exceptAll(a.intersect(b)).withColumn("shared", F.lit(False)))


# --- statistics ---------------------------------------------------------------------------------

WELCH = """select p_brand, avg(v) filter (f = 'A') - avg(v) filter (f = 'R') as difference, var_samp(v) filter (f = 'A') / count(*) filter (f = 'A') as ea, var_samp(v) filter (f = 'R') / count(*) filter (f = 'R') as eb, count(*) filter (f = 'A') as na, count(*) filter (f = 'R') as nb
  from (select p_brand, l_returnflag as f, l_extendedprice as v from lineitem join part on l_partkey = p_partkey) group by 1"""


def _branded(spark, d):
    return _t(spark, d, "lineitem").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")


@query(f"with m as ({WELCH}) select p_brand, round(difference, 4) as difference, round(difference / sqrt(ea + eb), 6) as t, round((ea + eb) ** 2 / (ea * ea / (na - 1) + eb * eb / (nb - 1)), 4) as df from m")
def welch(spark, d):
    return _r(_r(stats.welch(_branded(spark, d), ["p_brand"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", "l_extendedprice"), "difference", "df"), "t", digits=6)


@query("""with g as (select p_brand, l_returnflag, count(*) as n, avg(l_extendedprice) as m, var_samp(l_extendedprice) as v from lineitem join part on l_partkey = p_partkey group by 1, 2),
  s as (select p_brand, sum(n * m * m) - sum(n * m) ** 2 / sum(n) as b, sum((n - 1) * coalesce(v, 0)) as w, count(*) as k, sum(n) as n from g group by 1)
  select p_brand, round((b / (k - 1)) / (w / (n - k)), 5) as f, k - 1 as df1, cast(n - k as bigint) as df2 from s""")
def anova(spark, d):
    return _r(stats.anova(_branded(spark, d), ["p_brand"], "l_returnflag", "l_extendedprice"), "f", digits=5)


@query()
def welch_p(spark, d):
    t = stats.welch(_branded(spark, d), ["p_brand"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", "l_extendedprice")
    return stats.with_p(t, "t", ["df"], "t")


@query("""with r as (select l_returnflag, l_linestatus, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as k, l_suppkey % 2 = 0 as a from lineitem)
  select l_returnflag, count(*) filter (a) as na, count(*) filter (not a) as nb, round(sum(k) filter (a) - count(*) filter (a) * (count(*) filter (a) + 1) / 2.0, 1) as u from r group by 1""")
def rank_sum(spark, d):
    return _r(stats.rank_sum(_t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_suppkey") % 2 == 0, "l_quantity"), "u", digits=1)


@query("""with r as (select o_orderpriority as g, rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 as a, rank() over (partition by o_orderpriority order by o_custkey) + (count(*) over (partition by o_orderpriority, o_custkey) - 1) / 2.0 as b from orders)
  select g as o_orderpriority, round(corr(a, b), 6) + 0 as rho, count(*) as n from r group by 1""")
def spearman(spark, d):
    return _r(stats.spearman(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey"), "rho", digits=6)


@query("select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def line_fit(spark, d):
    return _r(_r(_r(stats.line_fit(_t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), "slope"), "intercept", digits=3), "r2", digits=6)


@query("select l_suppkey, round(corr(l_quantity, l_extendedprice) ** 2, 6) as r2 from lineitem group by 1")
def pearson2_sums(spark, d):
    return _r(stats.pearson2_from_sums(_t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice")), "r2", digits=6)


@query("""with p as (select o_orderkey, o_orderpriority as g, case when o_orderkey % 11 <> 0 then o_totalprice / 1e6 end as p from orders), r as (select *, count(p) over (partition by g) as n, row_number() over (partition by g order by p nulls last, o_orderkey) as k from p)
  select o_orderkey, case when p is not null then round(least(min(p * n / k) over (partition by g order by k desc rows unbounded preceding), 1), 8) end as q from r""")
def bh(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1e6).alias("p"))
    return _r(stats.benjamini_hochberg(o, ["o_orderpriority"], "p", "o_orderkey"), "q", digits=8).select("o_orderkey", "q")


@query("""with p as (select o_orderkey, o_orderpriority as g, case when o_orderkey % 11 <> 0 then o_totalprice / 1e9 end as p from orders), r as (select *, count(p) over (partition by g) as n, row_number() over (partition by g order by p nulls last, o_orderkey) as k from p)
  select o_orderkey, case when p is not null then round(least(max((n - k + 1) * p) over (partition by g order by k rows unbounded preceding), 1), 11) end as q from r""")
def holm(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1e9).alias("p"))
    return _r(stats.holm(o, ["o_orderpriority"], "p", "o_orderkey"), "q", digits=11).select("o_orderkey", "q")


@query()
def permutation(spark, d):
    return stats.permutation(_t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), ["c_nationkey"], F.col("c_mktsegment") == "BUILDING", "c_acctbal", 200)


@query()
def bootstrap(spark, d):
    return stats.bootstrap_median(_t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", 200)


@query()
def curve_fits(spark, d):
    return stats.fit_curves(_series(spark, d), ["user_id"], "hours", "value")


@query()
def nnls_mixtures(spark, d):
    g = _matrix(spark, d).join(_t(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").groupBy(F.col("s_nationkey").alias("k"), "p_brand").agg(F.avg("v").alias("v"))
    return stats.mixtures(g.where("k >= 5"), "k", "p_brand", "v", g.where("k < 5"))


@query()
def greedy_bins(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_suppkey", fx.bin_index(F.col("l_quantity"), 2.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return stats.greedy_merge(p, ["l_suppkey"], "bin", "n", 60)


@query()
def downsampled_counts(spark, d):
    return stats.downsample_counts(_matrix(spark, d), "l_suppkey", "p_brand", "v", 1000)


# --- search -------------------------------------------------------------------------------------

PAIRS = "p as (select o_orderpriority as a, c_nationkey as b, avg(o_totalprice) as s from orders join customer on o_custkey = c_custkey group by 1, 2)"


def _pairs(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("a"), F.col("c_nationkey").alias("b")).agg(F.avg("o_totalprice").alias("s"))


@query(f"""with {PAIRS}, r as (select *, row_number() over (partition by a order by s desc, b) as k from p)
  select a, max(b) filter (k = 1) as best, round(max(s) filter (k = 1), 3) as best_score, max(b) filter (k = 2) as second, round(max(s) filter (k = 1) - max(s) filter (k = 2), 3) as margin from r group by 1""")
def top2_margin(spark, d):
    return _r(search.top_two(_pairs(spark, d), "a", "b", "s"), "best_score", "margin", digits=3)


@query(f"""with {PAIRS}, r as (select *, row_number() over (partition by a order by s desc, b) as k, row_number() over (partition by b order by s desc, a) as l from p) select a, b, round(s, 3) as s from r where k = 1 and l = 1""")
def reciprocal_best(spark, d):
    return _r(search.reciprocal_best(_pairs(spark, d), "a", "b", "s"), "s", digits=3)


@query("""select p_partkey from part p where not exists (select 1 from part o where o.p_brand = p.p_brand and o.p_size >= p.p_size and o.p_retailprice >= p.p_retailprice and (o.p_size > p.p_size or o.p_retailprice > p.p_retailprice))""")
def skyline(spark, d):
    return search.skyline(_t(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_partkey")


@query("""select s_suppkey, round((sum(s_acctbal) over w - s_acctbal) / nullif(count(s_acctbal) over w - 1, 0), 4) as without from supplier window w as (partition by s_nationkey)""")
def leave_one_out(spark, d):
    return _r(search.leave_one_out(_t(spark, d, "supplier"), ["s_nationkey"], "s_acctbal"), "without").select("s_suppkey", "without")


@query("""with c as (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2), e as (select *, n * 100.0::double / sum(n) over (partition by c_mktsegment) as x from c),
  f as (select *, floor(x) as fl, round(x - floor(x), 9) as rest from e), k as (select *, 100 - sum(fl) over (partition by c_mktsegment) as extra, row_number() over (partition by c_mktsegment order by rest desc, c_nationkey) as k from f)
  select c_mktsegment, c_nationkey, n, cast(fl + case when k <= extra then 1 else 0 end as bigint) as share from k""")
def allocation(spark, d):
    sizes = _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return search.largest_remainders(sizes, "c_nationkey", "n", 100, ["c_mktsegment"])


@query("""with k as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5(concat(c_custkey, ':7')), c_custkey) as k from customer) select c_custkey, c_mktsegment from k where k <= 20""")
def balanced_sample(spark, d):
    return search.balanced_sample(_t(spark, d, "customer"), "c_mktsegment", "c_custkey", 20).select("c_custkey", "c_mktsegment")


@query("""with a as (select l_quantity as q, avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s from lineitem group by 1 having count(*) >= 5), f as (select quantile_cont(s, 0.2) as fl from a)
  select l_suppkey, round(avg(abs((l_extendedprice - m) / greatest(s, fl))), 6) as mean_z, round(max(abs((l_extendedprice - m) / greatest(s, fl))), 6) as max_z from lineitem join a on l_quantity = q, f group by 1""")
def outliers(spark, d):
    return _r(search.outliers(_t(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice", 5), "mean_z", "max_z", digits=6)


@query()
def matched_points(spark, d):
    p = _t(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"))
    return search.match(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["s_nationkey"], "id", ["x"], 20.0)


# --- verification, panels, windows ---------------------------------------------------------------


@query("""with a as (select c_nationkey as k, c_mktsegment as l from customer qualify row_number() over (partition by c_nationkey order by c_custkey) = 1), b as (select c_nationkey as k, c_mktsegment as l from customer qualify row_number() over (partition by c_nationkey order by c_custkey desc) = 1)
  select round(avg(case when a.l = b.l then 1.0 else 0.0 end), 6) as agreement, count(*) as n from a join b using (k)""")
def label_agreement(spark, d):
    c = _t(spark, d, "customer")
    one, other = (c.groupBy(F.col("c_nationkey").alias("k")).agg(f("c_mktsegment", "c_custkey").alias("l")) for f in (F.min_by, F.max_by))
    return _r(verify.agreement(one, other, "k", "l"), "agreement", digits=6)


@query("select l_orderkey, cast(l_linenumber as bigint) as line, l_quantity as amount from lineitem where l_returnflag in ('A', 'R') and l_discount > 0.05")
def panel_rows(spark, d):
    panel = Panel("returned", "lineitem", ("l_orderkey", "line"), "amount", (lambda df: df.withColumn("l_linenumber", F.col("l_linenumber").cast("long")),), F.col("l_returnflag").isin("A", "R") & (F.col("l_discount") > 0.05), {"l_linenumber": "line", "l_quantity": "amount"})
    return panel.rows(spark, d)


@query("""with q as (select p_brand, quantile_cont(p_retailprice, 1 / 3.0::double) as q1, quantile_cont(p_retailprice, 2 / 3.0::double) as q2 from part group by 1)
  select p_partkey, case when p_retailprice is null then 'undetermined' when p_retailprice <= q1 then 'low' when p_retailprice <= q2 then 'middle' else 'high' end as note from part join q using (p_brand)""")
def tertiles(spark, d):
    p = _t(spark, d, "part")
    q = p.groupBy("p_brand").agg(F.percentile("p_retailprice", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    return p.join(q, "p_brand").select("p_partkey", fx.tertile(F.col("p_retailprice"), F.col("q")[0], F.col("q")[1]).alias("note"))


@query("""select user_id, max(case when event_type = 'click' then value end) - max(case when event_type = 'view' then value end) as lag from events group by 1""")
def pivot_lag(spark, d):
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("value")))
    return _t(spark, d, "events").groupBy("user_id").agg((of("click") - of("view")).alias("lag"))


@query("""select event_type, time_bucket(interval '4 hours', ts, timestamp '1970-01-01') as "start", time_bucket(interval '4 hours', ts, timestamp '1970-01-01') + interval '4 hours' as "end", round(avg(value), 8) as mean, count(value) as n from events group by 1, 2, 3""")
def tumbling(spark, d):
    return _r(windows.fixed_bins(_t(spark, d, "events"), "ts", "event_type", "value", "4 hours"), "mean", digits=8)


@query("""with g as (select user_id, ts, case when ts >= lag(ts) over w + interval '6 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
  i as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as "start", max(ts) + interval '6 hours' as "end", count(*) as n from i group by user_id, k""")
def session_runs(spark, d):
    return windows.sessions(_t(spark, d, "events"), "ts", "user_id", "6 hours")
