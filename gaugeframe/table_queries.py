"""Registered queries on plain tables: filters, joins, shapes, verification and exact statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import columns as fx
from .operators import exact, filters, joins, matrix, modularity, panels, partition, polyline, profiles, reshape, search, stats
from .plans import verify
from .registry import query
from .registry import rounded as _r
from .registry import table as _t
from .sources import tables
from .streaming import windows

# --- filters, order and lookups ---------------------------------------------------------------


@query("""select l_suppkey, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 8) as cv from lineitem group by 1 having stddev_pop(l_extendedprice) / avg(l_extendedprice) > 0.57 and avg(l_extendedprice) > 0""")
def spread_filter(spark, d):
    m = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("sd"))
    return _r(filters.spread_filter(m, 0.57).select("l_suppkey", "cv"), "cv", digits=8)


@query("""select l_suppkey, round(max(m), 6) as highest from (select l_suppkey, l_returnflag, avg(l_quantity) as m from lineitem group by 1, 2) group by 1 having max(m) >= 26""")
def expressed_features(spark, d):
    m = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return _r(filters.expressed(m, "l_suppkey", "m", 26.0), "highest", digits=6)


@query("""with w as (select distinct lower(n_name) as k from nation union select distinct lower(c_mktsegment) from customer) select o_orderkey from (select o_orderkey, o_orderpriority as a, c_mktsegment as b from orders join customer on o_custkey = c_custkey) where lower(a) in (select k from w) or lower(b) in (select k from w)""")
def in_either_key(spark, d):
    c = _t(spark, d, "customer")
    rows = _t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.upper("o_orderpriority").alias("a"), F.upper("c_mktsegment").alias("b"))
    wanted = _t(spark, d, "nation").select(F.col("n_name").alias("k")).unionByName(c.select(F.col("c_mktsegment").alias("k")))
    return filters.in_either(rows, ["a", "b"], wanted, "k").select("o_orderkey")


@query("""select o_custkey, o_orderkey from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) <= 2""")
def manifest_head(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return filters.first_rows(o, ["o_custkey"], [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("""select p_partkey, p_retailprice from part order by p_retailprice nulls last, p_partkey limit 25""")
def smallest_rows(spark, d):
    return filters.first_rows(_t(spark, d, "part").select("p_partkey", "p_retailprice"), [], [F.col("p_retailprice").asc_nulls_last(), F.col("p_partkey")], 25)


@query("""select o_custkey, o_orderstatus, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice, o_orderkey) = 1""")
def keep_first(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return filters.keep_first(o, ["o_custkey", "o_orderstatus"], ["o_totalprice", "o_orderkey"])


@query("""with r as (select o_orderpriority as label, count(*) as n from orders group by 1) select label, n, row_number() over (order by case label when '3-MEDIUM' then 1 when '1-URGENT' then 2 else 3 end, label) as place from r""")
def display_order(spark, d):
    from pyspark.sql import Window

    r = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(filters.display_rank(F.col("label"), ["3-MEDIUM", "1-URGENT"]))).cast("long"))  # one row a label


@query("""select c_mktsegment, c_custkey, dense_rank() over (partition by c_mktsegment order by c_nationkey desc, floor(c_acctbal / 1000)) as place from customer""")
def tuple_rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_nationkey"), F.floor(F.col("c_acctbal") / 1000))
    return _t(spark, d, "customer").select("c_mktsegment", "c_custkey", F.dense_rank().over(w).cast("long").alias("place"))


@query("""select p_partkey, case when p_retailprice is null then null when p_retailprice < 1000 then 'low' when p_retailprice < 1500 then 'middle' else 'high' end as level,
  case when p_size between 1 and 50 then (p_size >= 10)::int + (p_size >= 25)::int end::bigint as part, lpad(p_size::varchar, 4, '0') as padded, round(ln(1 + p_retailprice), 8) as logged, round(log2((p_retailprice + 1) / (p_size + 1)), 8) as ratio from part""")
def labelled_parts(spark, d):
    p = _t(spark, d, "part")
    price = F.col("p_retailprice")
    rows = p.select("p_partkey", fx.threshold_label(price, [1000, 1500], ["low", "middle", "high"]).alias("level"), fx.cut_edges(F.col("p_size"), [1, 10, 25, 50]).alias("part"), fx.padded(F.col("p_size"), 4).alias("padded"), F.log1p(price).alias("logged"), fx.log_ratio(price, F.col("p_size"), 1.0).alias("ratio"))
    return _r(rows, "logged", "ratio", digits=8)


@query("""select l_orderkey, l_linenumber::bigint as line, c_mktsegment, n_name, r_name from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def star_join(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    steps = [
        (_t(spark, d, "orders"), {"o_orderkey": "l_orderkey"}, ["o_custkey"]), (_t(spark, d, "customer"), {"c_custkey": "o_custkey"}, ["c_mktsegment", "c_nationkey"]),
        (_t(spark, d, "nation"), {"n_nationkey": "c_nationkey"}, ["n_name", "n_regionkey"]), (_t(spark, d, "region"), {"r_regionkey": "n_regionkey"}, ["r_name"]),
    ]
    return filters.star_join(li, steps).select("l_orderkey", "line", "c_mktsegment", "n_name", "r_name")


@query("""with n as (select s_nationkey as k, count(*) as n, min(s_suppkey) as s from supplier group by 1) select c_custkey, case when n = 1 then s end as s_suppkey, case when n is null then 'missing' when n = 1 then 'found' else 'ambiguous' end as match from customer left join n on c_nationkey = k""")
def only_match(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return filters.only_match(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), s, "c_nationkey").select("c_custkey", "s_suppkey", "match")


@query("""select o_orderkey as place, c_custkey, c_acctbal, c_custkey is null or c_acctbal is null and c_custkey not in (select c_custkey from customer) as absent from (select o_orderkey, o_custkey as c_custkey from orders) left join customer using (c_custkey)""")
def reindexed(spark, d):
    wanted = _t(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("c_custkey"))
    return filters.reindexed(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", wanted, "place")


@query("""select l_orderkey, max(l_quantity) filter (l_linenumber = 1) as "start", max(l_quantity) filter (l_linenumber = 4) as "end", max(l_quantity) filter (l_linenumber = 4) - max(l_quantity) filter (l_linenumber = 1) as change from lineitem group by 1 having max(l_quantity) filter (l_linenumber = 1) is not null and max(l_quantity) filter (l_linenumber = 4) is not null""")
def end_points(spark, d):
    return filters.end_points(_t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", 1, 4, "l_quantity")


@query("""with m as (select l_suppkey, l_returnflag as n, avg(l_quantity) as v from lineitem group by 1, 2) select a.l_suppkey, a.n as one, b.n as other, round(b.v - a.v, 8) + 0 as difference from m a join m b on a.l_suppkey = b.l_suppkey and a.n < b.n""")
def pairs_by_name(spark, d):
    m = _t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return _r(filters.pairs_by_name(m, ["l_suppkey"], "l_returnflag", "v"), "difference", digits=8)


@query("""select l_suppkey, round(avg(l_extendedprice), 4) as mean, round(median(l_extendedprice), 4) as median, round(stddev_samp(l_extendedprice), 4) as sd, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 4) as sem,
  round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, count(l_extendedprice) as n from lineitem group by 1""")
def quartile_summary(spark, d):
    return _r(filters.summary(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice"), "mean", "median", "sd", "sem", "q25", "q75")


@query("""with u as (select l_returnflag, l_suppkey, count(*) filter (l_discount > 0.05) as h, count(*) as n from lineitem group by 1, 2) select l_returnflag, round(sum(h) / sum(n), 8) as micro, round(avg(h / n), 8) as macro, count(*) as units from u group by 1""")
def micro_macro(spark, d):
    return _r(filters.rates(_t(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_discount") > 0.05), "micro", "macro", digits=8)


@query("""with w as (select doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) as item from documents) select item, count(*) as times, count(distinct doc_id) as lists from w group by 1""")
def item_counts(spark, d):
    return filters.item_counts(_t(spark, d, "documents"), "doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), " ", -1))


@query("""with q as (select l_suppkey, quantile_cont(l_extendedprice, 0.95) as q from lineitem group by 1) select l_suppkey, count(*) filter (l_extendedprice > q) as n, round(max(q), 4) as threshold from lineitem join q using (l_suppkey) group by 1""")
def own_quantile(spark, d):
    rows = filters.above_own_quantile(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.95)
    return _r(rows.groupBy("l_suppkey").agg(F.count_if("above").alias("n"), F.max("threshold").alias("threshold")), "threshold")


@query("""with f as (select l_suppkey, regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem group by 1), o as (select l.*, l_extendedprice - i - s * l_quantity as residual from lineitem l join f using (l_suppkey)),
  q as (select l_suppkey, quantile_cont(abs(residual), 0.98) as q from o group by 1) select l_orderkey, l_linenumber::bigint as line, round(residual, 2) + 0 as residual from o join q using (l_suppkey) where abs(residual) > q""")
def residual_rank(spark, d):
    rows = filters.residual_rank(_t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 0.98)
    return _r(rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "residual"), "residual", digits=2)


@query("""select event_id, user_id, (date_diff('second', timestamp '2020-01-01', ts) // 864000)::bigint as stratum from events qualify row_number() over (partition by user_id, date_diff('second', timestamp '2020-01-01', ts) // 864000 order by md5(event_id::varchar || ':7'), event_id) <= 3""")
def time_sample(spark, d):
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2020-01-01 00:00:00', ts)")
    return filters.time_sample(_t(spark, d, "events"), ["user_id"], F.floor(s / 864000).cast("long"), "event_id", 3).select("event_id", "user_id", "stratum")


@query("""with c as (select user_id, min(ts) as cut from events where event_type = 'purchase' group by 1) select event_id from events left join c using (user_id) where cut is null or ts < cut""")
def cut_at_events(spark, d):
    e = _t(spark, d, "events")
    cuts = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("cut"))
    return filters.cut_at_events(e, cuts, "user_id", "ts", "cut").select("event_id")


@query("""with p as (select l_suppkey, floor(l_quantity / 5)::bigint as bin, count(*) as n from lineitem group by 1, 2) select * from p where n >= 6 or not bin between 2 and 8""")
def inner_support(spark, d):
    p = _t(spark, d, "lineitem").groupBy("l_suppkey", fx.bin_index(F.col("l_quantity"), 5.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return filters.supported(p, "n", 6, F.lit(2), F.lit(8))


@query("""with k as (select event_id, user_id, value, row_number() over (partition by user_id order by event_id) as k from events), b as (select user_id, median(value) as b from k where k <= 5 group by 1) select event_id, case when b <> 0 then round((value - b) / b, 5) + 0 end as relative from k join b using (user_id)""")
def relative_change(spark, d):
    return _r(filters.relative_change(_t(spark, d, "events"), ["user_id"], "event_id", "value", 5).select("event_id", "relative"), "relative", digits=5)


# --- shapes -------------------------------------------------------------------------------------


@query("""with w as (select l_suppkey, avg(l_quantity) as quantity, avg(l_discount) as discount, avg(l_tax) as tax from lineitem group by 1), u as (unpivot w on quantity, discount, tax into name name value value) select l_suppkey, name, round(value, 8) as value from u""")
def to_long(spark, d):
    w = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return _r(reshape.to_long(w, ["l_suppkey"], ["quantity", "discount", "tax"]), "value", digits=8)


@query("""select o_custkey, max(o_totalprice) filter (o_orderstatus = 'F') as F, max(o_totalprice) filter (o_orderstatus = 'O') as O, max(o_totalprice) filter (o_orderstatus = 'P') as P from orders group by 1""")
def to_wide(spark, d):
    return reshape.to_wide(_t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "o_totalprice")


GRID = """h as (select l_suppkey as g, floor(l_quantity / 10)::int as x, floor(l_discount * 50)::int as y, count(*) as n from lineitem group by 1, 2, 3), c as (select g, x, y from (select distinct g from h), range(6) r(x), range(6) s(y)),
  f as (select c.g, c.x::int as x, c.y::int as y, coalesce(n, 0) as n from c left join h on h.g = c.g and h.x = c.x and h.y = c.y)"""


@query(f"with {GRID} select * from f")
def dense_grid(spark, d):
    return _grid(spark, d)


def _grid(spark, d):
    h = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_discount") * 50).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.dense_grid(h, ["g"], "x", "y", "n", 6, 6)


@query(f"with {GRID}, t as (select g, max(n) as m, quantile_cont(n, 0.9) filter (n > 0) as q from f group by 1) select g, x, y, round(n / m, 8) as scaled, round(least(n / q, 1), 8) as clipped from f join t using (g)")
def display_scale(spark, d):
    return _r(reshape.display_scale(_grid(spark, d), ["g"], "n", 0.9).drop("n"), "scaled", "clipped", digits=8)


@query("""select event_type, coalesce(nullif(round(quantile_cont(value, 0.995) filter (value >= 0), 6), 0), 1.0) as top from events group by 1""")
def axis_top(spark, d):
    return _r(reshape.axis_top(_t(spark, d, "events"), ["event_type"], "value"), "top", digits=6)


@query("""with m as (select (l_suppkey % 12)::bigint as r, (l_partkey % 12)::bigint as c, count(*)::double as v from lineitem group by 1, 2) select r, c, coalesce(a.v, 0) - coalesce(b.v, 0) as difference from m a full join (select c as r, r as c, v from m) b using (r, c) where coalesce(a.v, 0) <> coalesce(b.v, 0)""")
def transposed_differences(spark, d):
    m = _t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 12).cast("long").alias("r"), (F.col("l_partkey") % 12).cast("long").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return reshape.transposed_differences(m, m, "r", "c", "v")


@query("""select s_nationkey as k, s_acctbal as balance, null::varchar as segment, 'supplier' as source from supplier union all select c_nationkey, c_acctbal, c_mktsegment, 'customer' from customer""")
def stacked(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("balance"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return reshape.stacked({"supplier": s, "customer": c})


@query("""with a as (select l_suppkey, l_linestatus as f, count(*) as v from lineitem group by 1, 2), b as (select o_custkey, o_orderstatus as f, count(*) as v from orders group by 1, 2),
  s as (select f from a intersect select f from b) select l_suppkey || '-a' as row, f, v from a semi join s using (f) union all select o_custkey || '-b', f, v from b semi join s using (f)""")
def joined_matrices(spark, d):
    a = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linestatus").alias("f")).agg(F.count(F.lit(1)).alias("v"))
    b = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("row"), F.col("o_orderstatus").alias("f")).agg(F.count(F.lit(1)).alias("v"))
    return reshape.joined_matrices(a, b, "row", "f", "v", ("a", "b"), inner=True)


@query("""with f as (select l_orderkey, l_returnflag as item, min(l_linenumber) as o from lineitem group by 1, 2) select l_orderkey, string_agg(item, ',' order by o, item) as items from f group by 1""")
def ordered_distinct(spark, d):
    rows = reshape.ordered_distinct(_t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag")
    return rows.select("l_orderkey", F.array_join("items", ",").alias("items"))


# --- statistics ---------------------------------------------------------------------------------


@query()
def exact_permutation(spark, d):
    li = _t(spark, d, "lineitem")
    return _r(exact.exact_permutation(li, ["l_orderkey"], "l_linestatus", F.col("l_suppkey") % 2 == 0, "l_extendedprice"), "difference", "p", "low", "high", digits=6)


@query()
def exact_u(spark, d):
    u = stats.rank_sum(_t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_suppkey") % 2 == 0, "l_extendedprice")
    return _r(exact.exact_u(u, "u", "na", "nb"), "p", digits=9)


@query()
def welch_interval(spark, d):
    return _r(exact.welch_interval(_t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R", "l_extendedprice"), "difference", "t", "df", "p", "low", "high")


@query("""with g as (select l_suppkey, l_returnflag as g, avg(l_extendedprice) as m, var_samp(l_extendedprice) / count(l_extendedprice) as e, count(l_extendedprice) as n from lineitem group by 1, 2),
  x as (select l_suppkey, arg_min(g, (m, g)) as lowest, arg_min(g, (-m, g)) as highest from g group by 1)
  select l_suppkey, a.g as one, b.g as other, round((a.m - b.m) / sqrt(a.e + b.e), 6) + 0 as t, round((a.e + b.e) ** 2 / (a.e * a.e / (a.n - 1) + b.e * b.e / (b.n - 1)), 4) as df, lowest, highest from g a join g b using (l_suppkey) join x using (l_suppkey) where a.g < b.g""")
def pairwise_welch(spark, d):
    rows = exact.pairwise_welch(_t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return _r(_r(rows, "t", digits=6), "df")


@query("""with x as (select l_suppkey, p_brand, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey group by 1, 2), f as (select distinct p_brand from x), a as (select s_suppkey, s_nationkey, f.p_brand, coalesce(v, 0) as v from supplier cross join f left join x on l_suppkey = s_suppkey and x.p_brand = f.p_brand),
  r as (select *, rank() over (partition by p_brand order by v) + (count(*) over (partition by p_brand, v) - 1) / 2.0 as k, count(*) over (partition by p_brand, v) as t, count(*) over (partition by p_brand) as n from a),
  s as (select p_brand, max(n) as n, sum(t * t - 1.0) as ties from r group by 1) select p_brand, s_nationkey, round((sum(k) - count(*) * (max(s.n) + 1) / 2.0) / sqrt(count(*) * (max(s.n) - count(*)) / 12.0 * (max(s.n) + 1 - max(s.ties) / (max(s.n) * (max(s.n) - 1.0)))), 5) + 0 as z from r join s using (p_brand) group by 1, 2""")
def wilcoxon_markers(spark, d):
    x = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("v"))
    labels = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return _r(exact.wilcoxon_markers(x, labels, "l_suppkey", "p_brand", "v", "s_nationkey"), "z", digits=5)


@query()
def cluster_bootstrap(spark, d):
    e = _t(spark, d, "events").withColumn("day", F.date_format("ts", "EEE"))
    return _r(exact.cluster_bootstrap(e, "user_id", "day", "value", 200), "low", "high")


@query()
def ramp_fit(spark, d):
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2020-01-01 00:00:00', ts)") / 3600.0
    return _r(exact.ramp_fit(_t(spark, d, "events").withColumn("hours", s), ["user_id"], "hours", "value"), "onset", "offset", "low", "high", "sse")


@query()
def block_bootstrap(spark, d):
    return _r(exact.block_bootstrap(_t(spark, d, "events"), ["user_id"], "event_id", "value", 4, 200), "observed", "p", digits=6)


# --- sources, verification, streams and functions that had no query ------------------------------------


@query("""with a as (select * from supplier), n as (select s_suppkey, s_acctbal + 1 as s_acctbal from supplier where s_acctbal < 0) select s_suppkey, coalesce(n.s_acctbal, a.s_acctbal) as s_acctbal from a left join n using (s_suppkey)""")
def upsert(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return tables.upsert(s, s.where("s_acctbal < 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@query("""select c_custkey, coalesce(case when c_acctbal >= 0 then c_acctbal end, 0.0) as balance from customer""")
def fill_defaults(spark, d):
    c = _t(spark, d, "customer")
    return tables.fill_defaults(c.where("c_acctbal >= 0").select("c_custkey", F.col("c_acctbal").alias("balance")), c.select("c_custkey", F.lit(0.0).alias("balance")), ["c_custkey"])


@query("""select string_agg(n_name || '=' || n_nationkey, ',' order by n_name) as entries from nation""")
def key_values(spark, d):
    one = tables.key_values(_t(spark, d, "nation"), "n_name", "n_nationkey")
    return one.select(F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


@query("""with a as (select o_custkey as k, round(sum(o_totalprice), 2) as v from orders group by 1), b as (select o_custkey as k, round(sum(o_totalprice), 2) + case when o_custkey % 10 = 0 then 1 else 0 end as v from orders where o_custkey % 7 <> 0 group by 1)
  select count(*) filter (a.k is not null and b.k is not null) as matched, count(*) filter (b.k is null) as only_left, count(*) filter (a.k is null) as only_right, count(*) filter (abs(a.v - b.v) > 0.005) as over from a full join b on a.k = b.k""")
def keyed_difference(spark, d):
    v = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    other = v.where("k % 7 != 0").withColumn("v", F.col("v") + F.when(F.col("k") % 10 == 0, 1).otherwise(0))
    found = verify.keyed_difference(v, other, ["k"], "v", allowed=0.005)
    return spark.createDataFrame([(found.matched, found.only_left, found.only_right, found.over)], "matched long, only_left long, only_right long, over long")


@query("""select user_id from (select user_id, count(*) as n from events group by 1) where n > 5 and user_id in (select user_id from events where event_type = 'error')""")
def reappearing(spark, d):
    e = _t(spark, d, "events")
    return verify.reappearing(e.groupBy("user_id").count().where("count > 5"), e.where("event_type = 'error'").select("user_id").distinct(), ["user_id"])


@query("""with p as (select p_partkey, p_retailprice / 20000 as p, p_size - 25.0 as d from part) select p_partkey, case when p <= 0.0001 then '****' when p <= 0.001 then '***' when p <= 0.01 then '**' when p <= 0.05 then '*' when p is not null then 'ns' end as stars,
  round(((d * 30 + 180) % 360 + 360) % 360 - 180, 6) as angle, case when p_size < 5 and p_size * 2.0 < 5 then 'none' else 'donor' end as side from (select p.*, p_size from p join part using (p_partkey))""")
def marked_parts(spark, d):
    p = _t(spark, d, "part")
    rows = p.select("p_partkey", fx.stars(F.col("p_retailprice") / 20000).alias("stars"), fx.wrap_degrees((F.col("p_size") - 25.0) * 30).alias("angle"), fx.dominance(F.col("p_size").cast("double"), F.col("p_size") * 2.0, 5.0, 0.9).alias("side"))
    return _r(rows, "angle", digits=6)


@query("""select o_orderkey, sha1(array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), chr(10)))[1:16] as signature from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def signatures(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("x"))
    return rows.select("o_orderkey", fx.signature(F.col("x")).alias("signature"))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as n from events) select user_id, event_id from r where n <= 5 or k in (select unnest([0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1]))""")
def every_kth(spark, d):
    return search.every_kth(_t(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("""select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > (select avg(c_acctbal) from customer))""")
def semi_where(spark, d):
    c = _t(spark, d, "customer")
    gate = c.crossJoin(F.broadcast(c.agg(F.avg("c_acctbal").alias("mean")))).select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "mean")  # one row on the right
    return joins.semi_where(_t(spark, d, "orders"), gate, "o_custkey", F.col("c_acctbal") > F.col("mean")).select("o_orderkey")


@query("""select p_partkey, unnest(range(p_size, p_size + 4))::int as place from part""")
def expand_ranges(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("a"), (F.col("p_size") + 3).cast("int").alias("b"))
    return profiles.expand_ranges(p, "a", "b", "place").select("p_partkey", "place")


@query("""with w as (select event_type, value, time_bucket(interval '2 hours', ts, timestamp '1970-01-01') - interval '2 hours' * k as s from events, range(2) r(k)) select event_type, s as "start", s + interval '4 hours' as "end", round(avg(value), 8) as mean, count(value) as n from w group by 1, 2""")
def sliding(spark, d):
    return _r(windows.fixed_bins(_t(spark, d, "events"), "ts", "event_type", "value", "4 hours", "2 hours"), "mean", digits=8)


# --- what the library has had without a query -------------------------------------------------


@query("""with cells as (select c_mktsegment as g, c_nationkey % 5 as s, c_nationkey as k, avg(c_acctbal) as v, c_nationkey < 10 as a from customer group by 1, 2, 3),
  strata as (select g, s, list(v order by k) as vs, list(a order by k) as own, count(*) as n, count(*) filter (a) as na, sum(v) as t from cells group by 1, 2 having count(*) filter (a) between 1 and count(*) - 1),
  told as (select g, sum(n) as total, sum(na)::bigint as na, (sum(n) - sum(na))::bigint as nb from strata group by 1),
  ways as (select g, s, n, na, t, list_sum(list_transform(range(1, n + 1), lambda i: case when (m >> (i - 1)) & 1 = 1 then vs[i] else 0 end)) as x, len(list_filter(range(1, n + 1), lambda i: ((m >> (i - 1)) & 1 = 1) <> own[i])) = 0 as seen
    from strata, range(32) r(m) where m < 1 << n and bit_count(m) = na),
  moves as (select g, s, n / total * (x / w.na - (t - x) / (n - w.na)) as d, seen, n / total * t / (n - w.na) as middle from ways w join told using (g)
    union all select g, s, 0, true, 0 from (select distinct g from cells), range(5) r(s) where (g, s) not in (select (g, s) from strata)),
  five as (select g, a.d + b.d + c.d + d.d + e.d as d, a.seen and b.seen and c.seen and d.seen and e.seen as seen, a.middle + b.middle + c.middle + d.middle + e.middle as middle
    from moves a join moves b using (g) join moves c using (g) join moves d using (g) join moves e using (g) where a.s = 0 and b.s = 1 and c.s = 2 and d.s = 3 and e.s = 4),
  observed as (select g, max(d) as o, 1e-9 * greatest(1, abs(max(middle))) as slack from five where seen group by 1)
  select g as c_mktsegment, na, nb, round(o, 6) as difference, round(count(*) filter (abs(d) >= abs(o) - slack) / count(*), 9) as p from five join observed using (g) join told using (g) group by g, na, nb, o""")
def nation_exact(spark, d):
    cells = _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("v")).withColumn("region", F.col("c_nationkey") % 5)
    rows = exact.exact_permutation(cells, ["c_mktsegment"], "region", F.col("c_nationkey") < 10, "v", interval=False)
    return _r(_r(rows, "difference", digits=6), "p", digits=9)


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), d as (select q.vec_id as q, r.vec_id as r, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - r.e[i]) * (q.e[i] - r.e[i])))) as x from v q, v r where q.vec_id % 50 = 0)
  select q, r, round(x, 6) as distance, k as "rank", true as certified from (select *, row_number() over (partition by q order by round(x, 9), r) as k from d) where k <= 4""")
def certified_neighbours(spark, d):
    e = _t(spark, d, "embeddings")
    return _r(joins.indexed_knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 4, exact=True), "distance", digits=6)


@query()
def resolution_scan(spark, d):
    bought = _t(spark, d, "lineitem").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    trade = bought.join(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("w"))
    return modularity.communities(trade, "c_nationkey", "s_nationkey", "w", (0.9, 1.0, 1.1))[1]


@query("""select p_partkey, lower(substr(p_brand, 7, 1)) in ('1', 'true', 'yes') as first_line, try_cast(substr(p_brand, 7) as double) as line, least(greatest(p_size, 10), 40) as size, list_filter(list_transform(string_split_regex(p_brand || ';' || p_size || ',' || p_partkey, '[;,]'), lambda x: try_cast(trim(x) as int)), lambda x: x is not null) as numbers from part""")
def coerced(spark, d):
    p = _t(spark, d, "part")
    told = F.concat_ws(",", F.concat_ws(";", "p_brand", F.col("p_size").cast("string")), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", fx.truthy(F.substring("p_brand", 7, 1)).alias("first_line"), fx.number(F.expr("substr(p_brand, 7)")).alias("line"), fx.clip(F.col("p_size"), 10, 40).alias("size"), fx.list_of_ints(told).alias("numbers"))


@query("""with t as (select o_custkey, case when o_orderkey % 9 = 0 then 'x' || o_orderkey else (o_orderkey % 40) || '-' || (o_orderkey % 17) end as id from orders)
  select o_custkey, id, row_number() over (partition by o_custkey order by coalesce(try_cast(regexp_extract(id, '^(\\d+)-(\\d+)$', 1) as int), 1000000000), coalesce(try_cast(regexp_extract(id, '^(\\d+)-(\\d+)$', 2) as int), 1000000000), id) as place from t""")
def natural_order(spark, d):
    key = F.col("o_orderkey")
    t = _t(spark, d, "orders").select("o_custkey", F.when(key % 9 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(F.concat_ws("-", (key % 40).cast("string"), (key % 17).cast("string"))).alias("id"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*fx.natural_key(F.col("id")))).cast("long"))


@query("""with c as (select 'l_discount' as name, l_discount::double as v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem union all select 'l_quantity', l_quantity from lineitem union all select 'third', l_quantity / 3 from lineitem),
  f as (select name, k, bool_and(abs(round_even(v, k::int) - v) <= greatest(abs(v) * pow(2, -23), 1e-15)) as fits from c, range(13) r(k) group by 1, 2), top as (select name, max(abs(v)) as m from c group by 1)
  select name, min(k) filter (fits) as decimals, round(greatest(coalesce(0.5 * pow(10, -min(k) filter (fits)), 0), 1e-12 * max(m), 1e-15), 12) as tolerance from f join top using (name) group by 1""")
def carried_decimals(spark, d):
    li = _t(spark, d, "lineitem").withColumn("third", F.col("l_quantity") / 3)
    rows = [(c, verify.decimals(li, c), round(verify.tolerance(li, c), 12)) for c in ("l_discount", "l_extendedprice", "l_quantity", "third")]  # a row a column
    return spark.createDataFrame(rows, "name string, decimals long, tolerance double")


@query("""with a as (select l_returnflag as f, l_quantity as v, row_number() over (partition by l_returnflag order by l_quantity) as k from lineitem), b as (select f, w as v, row_number() over (partition by f order by w) as k from (select l_returnflag as f, l_quantity + case when l_suppkey % 3 = 0 then 1 else 0 end as w from lineitem where l_linenumber < 7))
  select count(*) filter (a.k is not null and b.k is not null) as matched, count(*) filter (b.k is null) as only_left, count(*) filter (a.k is null) as only_right, count(*) filter (abs(a.v - b.v) > 0.5) as over from a full join b on a.f = b.f and a.k = b.k""")
def sorted_difference(spark, d):
    li = _t(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("double").alias("v"))
    other = li.where("l_linenumber < 7").withColumn("v", F.col("v") + F.when(F.col("l_suppkey") % 3 == 0, 1).otherwise(0))
    found = verify.sorted_difference(li.select("l_returnflag", "v"), other.select("l_returnflag", "v"), ["l_returnflag"], "v", allowed=0.5)
    return spark.createDataFrame([(found.matched, found.only_left, found.only_right, found.over)], "matched long, only_left long, only_right long, over long")


@query("""with x as (select l_suppkey, l_partkey % 40 as f, sum(l_quantity - 25) as v from lineitem group by 1, 2), n as (select count(*) as n from supplier), m as (select f, count(*) filter (v <> 0) as nnz, sum(v) / max(n) as mean, sqrt(greatest(sum(v * v) / max(n) - (sum(v) / max(n)) ** 2, 0)) as sd from x, n group by 1)
  select f, nnz, round(mean, 5) as mean, round(sd, 5) as sd from m where mean > 0.5 and sd > 1""")
def dense_features(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 40).alias("f")).agg(F.sum(F.col("l_quantity") - 25).alias("v"))
    return _r(matrix.feature_filter(x, _t(spark, d, "supplier"), "f", "v", 0.5, 1.0, any_value=False), "mean", "sd", digits=5)


@query("""with r as (select l_orderkey as g, l_linenumber as i, l_suppkey % 2 = 0 as a, rank() over w + (count(*) over (partition by l_orderkey, l_quantity) - 1) / 2.0 as r from lineitem window w as (partition by l_orderkey order by l_quantity)),
  o as (select g, list(r order by i, r, a) as rs, list(a order by i, r, a) as own, count(*) as n, count(*) filter (a) as k, sum(r) filter (a) as seen from r group by 1 having count(*) filter (a) between 1 and count(*) - 1),
  x as (select g, n, k, seen, list_sum(list_transform(range(1, n + 1), lambda i: case when (m >> (i - 1)) & 1 = 1 then rs[i] else 0 end)) as s from (select *, unnest(range(1 << n)) as m from o) where bit_count(m) = k)
  select g as l_orderkey, k as na, n - k as nb, round(seen / k - (n * (n + 1) / 2.0 - seen) / (n - k), 6) as difference, round(count(*) filter (abs(s - k * (n + 1) / 2.0) >= abs(seen - k * (n + 1) / 2.0) - 1e-9) / count(*), 9) as p from x group by g, n, k, seen""")
def exact_ranks(spark, d):
    rows = exact.exact_rank_sum(_t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_suppkey") % 2 == 0, "l_quantity")
    return _r(_r(rows, "difference", digits=6), "p", digits=9)


# --- partitions of a domain, lines and marks -----------------------------------------------------

CELLS = "cells as (select l_returnflag as g, l_suppkey as x, l_partkey % 100 as y, avg(l_quantity) as a, avg(l_discount) * 500 as b from lineitem group by 1, 2, 3)"


def _cells(spark, d):
    """Pixel rows: a place for each supplier and remainder of parts, with two scores."""
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y")).agg(F.avg("l_quantity").alias("a"), (F.avg("l_discount") * 500).alias("b"))


def _cells_in_order(spark, d):
    """The cells of ``_cells``, figures added up in the order of the table's rows.

    Means of a few decimals are often equal but for their last bit, and which is above hangs on the order of the sum;
    DuckDB takes rows in this order where it runs on one thread.
    """
    li = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y"), "l_quantity", "l_discount", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    w = Window.partitionBy("g", "x", "y").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = li.select("g", "x", "y", "_at", *(f(c).over(w).alias(f"{n}_{c}") for c in ("l_quantity", "l_discount") for n, f in (("sum", F.sum), ("n", F.count))))
    mean = lambda c: F.try_divide(F.max_by(f"sum_{c}", "_at"), F.max(f"n_{c}"))
    return rows.groupBy("g", "x", "y").agg(mean("l_quantity").alias("a"), (mean("l_discount") * 500).alias("b"))


@query()
def flood_partition(spark, d):
    seeds = F.when((F.col("x") % 25 == 0) & (F.col("y") % 25 == 0), F.col("x") * 100 + F.col("y"))
    return partition.flood(_cells(spark, d).withColumn("seed", seeds).withColumn("level", F.floor(F.col("a") / 10).cast("double")), ["g"], "x", "y", "seed", "level")


@query(f"""with {CELLS}, s as (select g, x, y, x * 100 + y as seed from cells where x % 25 = 0 and y % 25 = 0)
  select c.g, c.x, c.y, round(min(sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2)), 6) as distance, arg_min(s.seed, struct_pack(d := (c.x - s.x) ** 2 + (c.y - s.y) ** 2, k := s.seed)) as owner from cells c left join s on c.g = s.g group by 1, 2, 3""")
def distance_partition(spark, d):
    seeds = F.when((F.col("x") % 25 == 0) & (F.col("y") % 25 == 0), F.col("x") * 100 + F.col("y"))
    return _r(partition.by_distance(_cells(spark, d).withColumn("seed", seeds), ["g"], "x", "y", "seed"), "distance", digits=6).select("g", "x", "y", "distance", "owner")


@query(f"""with recursive {CELLS}, c as (select *, case when x % 20 = 0 and y % 20 = 0 then 1 when x % 20 = 10 and y % 20 = 10 then 2 end as seed from cells),
  side(i, j) as (values (0, 1), (0, -1), (1, 0), (-1, 0)),
  two as (select g, x, y from c where seed = 2 union select c.g, c.x, c.y from two, side, c where c.g = two.g and c.x = two.x + i and c.y = two.y + j and (c.b > c.a or c.seed = 2)),
  rest as (select c.g, c.x, c.y, c.seed from c left join two using (g, x, y) where two.g is null or c.seed = 1),
  one as (select g, x, y from rest where seed = 1 union select r.g, r.x, r.y from one, side, rest r where r.g = one.g and r.x = one.x + i and r.y = one.y + j),
  kinds as (select g, bool_or(seed = 1) as k1, bool_or(seed = 2) as k2 from c group by 1)
  select g, c.x, c.y, case when k1 and k2 then case when one.g is not null then 1 else 2 end when k1 then 1 when k2 then 2 end::bigint as owner from c join kinds using (g) left join one using (g, x, y)""")
def score_partition(spark, d):
    seeds = F.when((F.col("x") % 20 == 0) & (F.col("y") % 20 == 0), 1).when((F.col("x") % 20 == 10) & (F.col("y") % 20 == 10), 2)
    return partition.by_scores(_cells_in_order(spark, d).withColumn("seed", seeds), ["g"], "x", "y", "seed", "a", "b")


LINE = """v as (select l_returnflag as g, date_trunc('month', l_shipdate) as k, avg(l_quantity) as x, avg(l_extendedprice) / 1000 as y from lineitem group by 1, 2),
  l as (select g, row_number() over w - 1 as item, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from v window w as (partition by g order by k)),
  n as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as len from l where x1 is not null),
  segs as (select *, coalesce(sum(len) over (partition by g order by item rows between unbounded preceding and 1 preceding), 0) as start, sum(len) over (partition by g) as total from n)"""


def _line(spark, d):
    """A line for each flag: its mean quantity and price month by month."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.date_trunc("month", "l_shipdate").alias("k"))
    return li.agg(F.avg("l_quantity").alias("x"), (F.avg("l_extendedprice") / 1000).alias("y"))


@query(f"""with {LINE}, p as (select l_orderkey, l_linenumber, l_returnflag as g, l_quantity as px, l_extendedprice / 1000 as py from lineitem),
  m as (select p.*, s.*, least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (len * len), 0), 1) as u from (select distinct g, px, py from p) p join segs s using (g) where len > 0),
  e as (select *, px - case when u >= 1 then x1 else x0 + u * (x1 - x0) end as ox, py - case when u >= 1 then y1 else y0 + u * (y1 - y0) end as oy from m),
  best as (select g, px, py, sqrt(ox * ox + oy * oy) as distance, start + u * len as arc, ((x1 - x0) * oy - (y1 - y0) * ox) / len as off from e qualify row_number() over (partition by g, px, py order by ox * ox + oy * oy, item) = 1)
  select l_orderkey, l_linenumber, round(distance, 6) as distance, round(arc, 4) as arc, round(off, 4) as "offset" from p left join best using (g, px, py)""")
def line_projection(spark, d):
    p = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    found = polyline.project(p, _line(spark, d), ["g"], "k", "x", "y")
    return _r(_r(found, "distance", digits=6), "arc", "offset").select("l_orderkey", "l_linenumber", "distance", "arc", "offset")


@query(f"""with {LINE}, t as (select distinct g, total, step, total * step / 100 as arc from segs, range(101) r(step)),
  s as (select t.g, step, t.arc, x0, y0, x1, y1, least(greatest((t.arc - start) / len, 0), 1) as u from t asof join (select * from segs where len > 0) segs on t.g = segs.g and t.arc >= segs.start)
  select g, step, round(arc, 5) as arc, round(x0 + u * (x1 - x0), 5) as x, round(y0 + u * (y1 - y0), 5) as y from s""")
def line_steps(spark, d):
    return _r(polyline.resample(_line(spark, d), ["g"], "k", "x", "y", 101), "arc", "x", "y", digits=5)


@query("""with p as (select p_brand as g, p_partkey as id, cast(p_size as double) as x, p_retailprice / 50 as y from part)
  select a.g, a.id, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as distance, arg_min(b.id, struct_pack(d := sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), k := b.id)) as nearest from p a left join p b on a.g = b.g and b.id % 10 = 0 where a.id % 10 <> 0 group by 1, 2""")
def nearest_marks(spark, d):
    p = _t(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"))
    return _r(polyline.nearest_mark(p.where("id % 10 != 0"), p.where("id % 10 = 0"), ["g"], "id", "x", "y"), "distance", digits=6).select("g", "id", "distance", "nearest")


# --- panels of features --------------------------------------------------------------------------


def _panel_tables(spark, d):
    """Terms of 24 features for lines of an order against groups of suppliers, and which should match which."""
    li = _t(spark, d, "lineitem").withColumn("f", (F.col("l_partkey") % 24).cast("string"))
    mean = lambda k: li.groupBy(k.cast("string").alias("l"), "f").agg(F.avg("l_extendedprice").alias("v"))
    told = panels.terms(mean(F.col("l_linenumber")), mean(F.col("l_suppkey") % 8), "l", "f", "v")
    pairs = told.select("a", "b").distinct()
    apart = F.pmod(F.col("b").cast("int") - F.col("a").cast("int"), F.lit(8))
    kinds = pairs.select("a", "b", F.when(apart == 0, "preferred").when(apart <= 2, "soft").when(apart == 3, "family").alias("kind"))
    return told, kinds.where("kind is not null")


@query("""with li as (select *, l_partkey % 24 as f from lineitem), one as (select l_linenumber as a, f, avg(l_extendedprice) as x from li group by 1, 2), other as (select l_suppkey % 8 as b, f, avg(l_extendedprice) as y from li group by 1, 2),
  fs as (select range as f from range(24)), moves as (select f as dropped, null as added from fs where f < 12 union all select null, f from fs where f >= 12 union all select p.f, q.f from fs p, fs q where p.f < 12 and q.f >= 12),
  members as (select dropped, added, f from moves, fs where (f < 12 and f is distinct from dropped) or f = added),
  r as (select dropped, added, a, b, count(*) as n, round(corr(x, y), 9) as r, (b - a + 8) % 8 as apart from members join one using (f) join other using (f) group by 1, 2, 3, 4),
  m as (select dropped, added, a, max(n) as n, list(struct_pack(r := -r, b := b, apart := apart) order by r desc, b) as top, max(r) filter (apart = 0) as own, max(r) filter (apart <> 0) as others, max(r) filter (apart > 3) as bad_ from r group by 1, 2, 3)
  select dropped::varchar as dropped, added::varchar as added, max(n) as "size", count(*) filter (own is not null and top[1].apart > 3) as bad, count(*) filter (own is not null and top[1].apart in (1, 2)) as soft, count(*) filter (own is not null and top[1].apart = 3) as family,
  round(quantile_cont(own - bad_, 0.5), 6) as margin_bad, round(quantile_cont(own - others, 0.5), 6) as margin_all, round(quantile_cont(top[2].r - top[1].r, 0.5), 6) as gap, round(avg(-top[1].r), 6) as correlation from m group by dropped, added""")
def panel_moves(spark, d):
    told, kinds = _panel_tables(spark, d)
    beam = panels.keyed(spark, [[str(f) for f in range(12)]])
    sums = panels.summed(told, beam.select("panel", F.explode("features").alias("feature")))
    moves = panels.all_moves(beam, [str(f) for f in range(24)])
    found = panels.scores(panels.moved(told, sums, moves), kinds).join(moves, "panel")
    return _r(found, "margin_bad", "margin_all", "gap", "correlation", digits=6).select("dropped", "added", "size", "bad", "soft", "family", "margin_bad", "margin_all", "gap", "correlation")


@query()
def panel_search(spark, d):
    told, kinds = _panel_tables(spark, d)
    return panels.search(told, kinds, [str(f) for f in range(12)], [str(f) for f in range(24)], width=4, rounds=2)
