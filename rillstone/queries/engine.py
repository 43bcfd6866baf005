"""Queries over the engine's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import computed as C
from rillstone.functions import measures as M
from rillstone.functions import predicates as P
from rillstone.operators import crdt
from rillstone.operators import datasets as D
from rillstone.plans import grid
from rillstone.plans.cube import Attribute, Cube, CubeQuery, Rollup
from rillstone.scratch import new_dir
from rillstone.sources import logs
from rillstone.sources.rollups import RollupStore
from rillstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- sources, rows, sets


@query("select * from (values (1, 'a'), (2, 'b'), (3, null)) t(id, name)")
def scan_values(spark, d):
    return D.of(spark, [(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("select 1 as id, 'x' as name where false")
def scan_empty(spark, d):
    return D.empty(spark, "id int, name string")


@query("select range as id, range * range as square from range(1000)")
def range_generate(spark, d):
    return D.generate(spark, 1000, id=F.col("id"), square=F.col("id") * F.col("id"))


@query("select c_custkey as id, 0 as part from customer union all select s_suppkey, 1 from supplier")
def concat_ordered(spark, d):
    return D.concat(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("select c_nationkey as id from customer union all select s_nationkey from supplier")
def union_bag(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("id")).unionAll(table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))


@query("""select id, arg_min(name, row(part, name)) as name from (select c_nationkey as id, c_name as name, 0 as part from customer
union all select s_nationkey, s_name, 1 from supplier) group by id""")
def union_distinct_by_key(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"))
    return D.merge([a, b], ["id"], distinct=True)


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def map_project(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 25 and l_returnflag = 'R'")
def map_filter(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 25 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def flat_map_words(spark, d):
    return D.flat_map(table(spark, d, "part"), F.split("p_name", " "), "word", ["p_partkey"])


@query("select p_partkey, length(p_name) as letters, upper(string_split(p_name, ' ')[1]) as head from part")
def map_function(spark, d):
    """A mapper that is a function over rows."""
    return D.map_rows(table(spark, d, "part").select("p_partkey", "p_name"), lambda b: b.assign(letters=b.p_name.str.len(), head=b.p_name.str.split(" ").str[0].str.upper())[["p_partkey", "letters", "head"]], "p_partkey bigint, letters bigint, head string")


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth from orders")
def reduce_groups_function(spark, d):
    """A reducer that is a function from a key's rows to rows."""

    def number(g):
        g = g.sort_values(["o_orderdate", "o_orderkey"])
        return g.assign(nth=range(1, len(g) + 1))[["o_custkey", "o_orderkey", "nth"]]

    return D.reduce_groups(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], number, "o_custkey bigint, o_orderkey bigint, nth bigint")


@query("select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) as customers, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation")
def join_groups_function(spark, d):
    """A joiner that is a function from both sides' rows of a key, either of which may be none."""
    import pandas as pd

    key = lambda name, c: table(spark, d, name).select(F.col(c).cast("bigint").alias("n_nationkey"))
    count = lambda a, b: pd.DataFrame({"n_nationkey": [(a if len(a) else b).n_nationkey.iloc[0]], "customers": [len(a)], "suppliers": [len(b)]})
    pairs = D.join_groups(key("customer", "c_nationkey"), key("supplier", "s_nationkey"), ["n_nationkey"], count, "n_nationkey bigint, customers bigint, suppliers bigint")
    every = key("nation", "n_nationkey").join(pairs, "n_nationkey", "left")
    return every.select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""select e.user_id, e.event_id from events e left join (select user_id, min(row(ts, event_id)) as s from events where event_type = 'error' group by user_id) f using (user_id)
where f.s is null or row(e.ts, e.event_id) < f.s""")
def until_first_error(spark, d):
    e = table(spark, d, "events")
    return D.until(e, F.col("event_type") == "error", ["ts", "event_id"], ["user_id"]).select("user_id", "event_id")


# ---- predicates; the advertiser's name is a nullable attribute


def _named(spark, d) -> DataFrame:
    a = table(spark, d, "advertisers")
    logrows = table(spark, d, "ad_log").select("log_name", "log_pos", "advertiser", "campaign", "impressions", "log_date").distinct()
    return logrows.join(a, "advertiser", "left")


_NAMED = "(select distinct l.log_name, l.log_pos, l.advertiser, l.campaign, l.impressions, l.log_date, a.name from ad_log l left join advertisers a on a.advertiser = l.advertiser)"


def _pred(name: str, p: P.Predicate, condition: str) -> None:
    def run(spark, d):
        df = _named(spark, d)
        return df.where(p.simplify().column({c: F.col(c) for c in df.columns})).select("log_name", "log_pos", "advertiser", "name")

    run.__name__ = name
    query(f"select log_name, log_pos, advertiser, name from {_NAMED} where {condition}")(run)


_pred("pred_always_true", P.always_true(), "true")
_pred("pred_always_false", P.always_false(), "false")
_pred("pred_eq", P.eq("advertiser", 3), "advertiser = 3")
_pred("pred_eq_null", P.eq("name", None), "name is null")
_pred("pred_ne_null", P.ne("name", "Norima"), "name is distinct from 'Norima'")
_pred("pred_lt", P.lt("advertiser", 5), "advertiser < 5")
_pred("pred_le", P.le("name", "Nororo"), "name <= 'Nororo'")
_pred("pred_gt", P.gt("impressions", 100), "impressions > 100")
_pred("pred_ge", P.ge("advertiser", 40), "advertiser >= 40")
_pred("pred_in", P.in_("advertiser", 1, 5, 7), "advertiser in (1, 5, 7)")
_pred("pred_in_empty", P.in_("advertiser"), "false")
_pred("pred_between", P.between("impressions", 10, 20), "impressions between 10 and 20")
_pred("pred_between_inverted", P.between("impressions", 20, 10), "false")
_pred("pred_regexp", P.regexp("name", "No.*|null"), "regexp_full_match(coalesce(name, 'null'), 'No.*|null')")
_pred("pred_has", P.and_(P.has("name"), P.not_(P.has("nothing"))), "true")
_pred("pred_not", P.not_(P.le("name", "Nororo")), "not coalesce(name <= 'Nororo', false)")
_pred("pred_and", P.and_(P.ge("advertiser", 2), P.lt("advertiser", 9), P.ne("advertiser", 4)), "advertiser >= 2 and advertiser < 9 and advertiser <> 4")
_pred("pred_or", P.or_(P.eq("advertiser", 2), P.gt("impressions", 500)), "advertiser = 2 or impressions > 500")
_pred("pred_or_empty", P.or_(), "true")
_pred("pred_json_tuple", P.parse('["and", ["between", "advertiser", 3, 9], ["not", ["eq", "advertiser", 5]], ["or", ["gt", "impressions", 50], ["in", "campaign", 31, 32]]]'), "advertiser between 3 and 9 and advertiser <> 5 and (impressions > 50 or campaign in (31, 32))")
_pred("pred_json_object", P.parse('{"advertiser >=": 3, "advertiser <": 9, "campaign IN": [31, 32, 44], "impressions <>": 1}'), "advertiser >= 3 and advertiser < 9 and campaign in (31, 32, 44) and impressions <> 1")


# ---- joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark, d):
    return D.join(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 400000")
def join_left(spark, d):
    return D.join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000"), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_anti(spark, d):
    return D.join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def join_semi(spark, d):
    return D.join(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "semi").select("c_custkey")


@query("""select c_custkey, o_orderkey from customer join (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) on o_custkey = c_custkey and n = 1""")
def join_n_to_1(spark, d):
    return D.join(table(spark, d, "customer"), table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), [("c_custkey", "o_custkey")], unique_right=["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("""select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from lineitem join part on p_partkey = l_partkey where l_quantity > 40) group by word""")
def join_flatmap(spark, d):
    j = D.join(table(spark, d, "lineitem").where("l_quantity > 40"), table(spark, d, "part"), [("l_partkey", "p_partkey")])
    return D.reduce_by(D.flat_map(j, F.split("p_name", " "), "word", []), ["word"], n=F.count(F.lit(1)))


# ---- measures and reducers


@query("select event_type, round(sum(value), 2) as total, count(*) as n, min(value) as low, max(value) as high from events group by event_type")
def measure_basic(spark, d):
    e, v = table(spark, d, "events"), F.col("value")
    m = {"total": M.sum_(), "n": M.count(), "low": M.min_(), "high": M.max_()}
    fine = e.groupBy("event_type", "user_id").agg(*(x.partial(v).alias(k) for k, x in m.items()))
    out = fine.groupBy("event_type").agg(*(x.merge(F.col(k)).alias(k) for k, x in m.items()))
    return out.withColumn("total", F.round("total", 2))


@query("select event_type, list_sort(list(distinct user_id)) as users from events group by event_type")
def measure_union(spark, d):
    m = M.union()
    fine = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(m.partial(F.col("user_id")).alias("users"))
    return fine.groupBy("event_type").agg(m.merge(F.col("users")).alias("users"))


_HLL = """mixed as (select event_type, event_id::uhugeint as v from events),
a as (select event_type, xor(v, v >> 33) as h from mixed),
b as (select event_type, (h * 18397679294719823053::uhugeint) % 18446744073709551616::uhugeint as h from a),
c as (select event_type, xor(h, h >> 33) as h from b),
e as (select event_type, (h * 14181476777654086739::uhugeint) % 18446744073709551616::uhugeint as h from c),
f as (select event_type, xor(h, h >> 33) as h from e),
g as (select event_type, (h % 1024::uhugeint)::int as register, (h >> 32)::ubigint as rest from f),
r as (select event_type, register, max(case when rest = 0 then 65 else 1 + length(bin(rest)) - length(rtrim(bin(rest), '0')) end)::int as rank from g group by all)"""


@query(f"with {_HLL} select event_type, register, rank from r")
def measure_hll_registers(spark, d):
    return M.registers(table(spark, d, "events"), ["event_type"], "event_id")


@query(f"""with {_HLL}, s as (select event_type, 1024 - count(*) as empty, 1024 - count(*) + sum(pow(2.0, -rank)) as inv from r group by event_type),
t as (select event_type, empty, 0.7213 / (1 + 1.079 / 1024) * 1024 * 1024 / inv as raw from s)
select event_type, trunc(case when raw < 2560 and empty > 0 then 1024.0 * ln(1024.0 / empty) else raw end)::int as estimate from t""")
def measure_hll(spark, d):
    return M.estimate(M.registers(table(spark, d, "events"), ["event_type"], "event_id"), ["event_type"])


@query("""select p_brand, p_size, sum(l_quantity)::bigint as quantity from lineitem join part on p_partkey = l_partkey group by p_brand, p_size""")
def reduce_two_phase(spark, d):
    j = D.join(table(spark, d, "lineitem"), table(spark, d, "part"), [("l_partkey", "p_partkey")])
    return D.reduce_by(j, ["p_brand", "p_size"], quantity=F.sum("l_quantity").cast("bigint"))


@query("select l_returnflag, sum(l_quantity)::bigint as q, count(*) as n from lineitem group by l_returnflag")
def partial_merge_roundtrip(spark, d):
    acc = D.partial(table(spark, d, "lineitem"), ["l_returnflag"], q=F.sum("l_quantity"), n=F.count(F.lit(1)))
    return D.reduce_by(acc, ["l_returnflag"], q=F.sum("q").cast("bigint"), n=F.sum("n"))


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def reduce_distinct_first(spark, d):
    return D.first_by(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("select o_custkey, string_agg(o_orderpriority[1:1], '' order by o_orderkey) as priorities from orders group by o_custkey")
def reduce_fold_binary(spark, d):
    return D.fold_by(table(spark, d, "orders"), ["o_custkey"], F.substring("o_orderpriority", 1, 1), F.lit(""), lambda a, v: F.concat(a, v), "priorities", F.col("o_orderkey"))


@query("""select l_suppkey, round(max(l_extendedprice) - min(l_extendedprice), 2) as spread from lineitem group by l_suppkey""")
def reduce_custom_combiner(spark, d):
    m = M.custom("spread", lambda c: F.struct(F.min(c).alias("a"), F.max(c).alias("b")), lambda c: F.struct(F.min(c["a"]).alias("a"), F.max(c["b"]).alias("b")), lambda c: F.round(c["b"] - c["a"], 2))
    fine = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(m.partial(F.col("l_extendedprice")).alias("x"))
    return fine.groupBy("l_suppkey").agg(m.merge(F.col("x")).alias("x")).select("l_suppkey", m.final(F.col("x")).alias("spread"))


@query("""select key, sum(a)::bigint as a, sum(b)::bigint as b from (select o_custkey as key, 1 as a, null as b from orders union all select c_custkey, null, 1 from customer) group by key""")
def reduce_several_inputs(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).alias("a"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("b"))
    return D.merge_reduce([a, b], ["key"], a=F.sum("a"), b=F.sum("b"))


@query("select word, list_sort(list(distinct p_partkey)) as parts from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part) group by word")
def inverted_index(spark, d):
    m = M.union()
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(m.partial(F.col("p_partkey")).alias("parts"))


@query(r"""select distinct word, doc_id from (select doc_id, unnest(string_split_regex(text, '[ \t\r\n]+')) as word from documents) where word <> ''""")
def inverted_index_documents(spark, d):
    """Postings of whole texts as rows, so that no row or task holds all documents of a common word."""
    words = F.split("text", r"[ \t\r\n]+")
    return D.flat_map(table(spark, d, "documents"), words, "word", ["doc_id"]).where("word <> ''").select("word", "doc_id").distinct()


# ---- order, routing


@query("select row_number() over (order by o_totalprice desc, o_orderkey) as place, o_orderkey from orders order by o_totalprice desc, o_orderkey limit 100")
def topk(spark, d):
    t = D.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), F.asc("o_orderkey"))
    from pyspark.sql import Window

    return t.select(F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("place"), "o_orderkey")  # 100 rows


@query("select o_custkey, count(*) as n from orders group by o_custkey")
def sort_total(spark, d):
    return D.sort(D.reduce_by(table(spark, d, "orders"), ["o_custkey"], n=F.count(F.lit(1))), F.desc("n"), F.asc("o_custkey"))


@query("select o_orderstatus, min(o_orderkey) as o_orderkey from orders group by o_orderstatus")
def sort_distinct(spark, d):
    return D.sort(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderkey", distinct_by=["o_orderstatus"])


@query("select true as sorted")
def sort_local(spark, d):
    """Whether each partition is in order: the least step between neighbours."""
    s = D.repartition_sort(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", partitions=8)
    from pyspark.sql import Window

    w = Window.partitionBy("p").orderBy("i")
    at = s.select("o_custkey", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    step = F.col("o_custkey") - F.lag("o_custkey").over(w)
    return at.select(step.alias("step")).agg((F.coalesce(F.min("step"), F.lit(0)) >= 0).alias("sorted"))


@query("select o_custkey, o_orderkey from orders")
def sort_local_rows(spark, d):
    """All rows, sorted within their partitions; reading fails if one isn't in order."""
    s = D.local_sort(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return D.cast_to_sorted(s, "o_custkey", "o_orderkey")


@query("select abs(o_custkey) % 7 as shard, count(*) as n from orders group by 1")
def shard_hash_counts(spark, d):
    return D.shard(table(spark, d, "orders"), "o_custkey", 7).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, unnest([o_custkey % 5, (o_custkey + 1) % 5]) as shard from orders")
def shard_replicate(spark, d):
    k = F.col("o_custkey")
    return D.replicate(table(spark, d, "orders"), F.array(k % 5, (k + 1) % 5)).select("o_orderkey", "shard")


@query("select 15 * count(*) / 15 as keys, 2 * count(*) as placed, true as stable from (select distinct o_custkey from orders)".replace("15 * count(*) / 15", "count(*)"))
def shard_rendezvous(spark, d):
    """Two copies a key; leaving out one partition moves only its own keys."""
    keys = table(spark, d, "orders").select("o_custkey").distinct()
    a = D.rendezvous(keys, F.col("o_custkey"), ["p1", "p2", "p3", "p4"], 2)
    b = D.rendezvous(keys, F.col("o_custkey"), ["p1", "p2", "p3"], 2)
    lost = a.where("shard <> 'p4'").join(b, ["o_custkey", "shard"], "left_anti")
    return a.agg(F.countDistinct("o_custkey").alias("keys"), F.count(F.lit(1)).alias("placed")).withColumn("stable", lost.agg(F.count(F.lit(1)) == 0).scalar())


@query("select 'big' as kind, count(*) as n from orders where o_totalprice > 250000 union all select 'open', count(*) from orders where o_orderstatus = 'O'")
def map_splitter(spark, d):
    o = table(spark, d, "orders")
    outs = D.route(o, big=F.col("o_totalprice") > 250000, open=F.col("o_orderstatus") == "O")
    count = lambda k: outs[k].agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count("big").unionAll(count("open"))


@query("select o_orderkey from orders where o_orderkey % 2 = 0 union all select o_orderkey from orders where o_orderkey % 2 = 1")
def splitter_union(spark, d):
    outs = D.route(table(spark, d, "orders").select("o_orderkey"), even=F.col("o_orderkey") % 2 == 0, odd=F.col("o_orderkey") % 2 == 1)
    return outs["even"].unionAll(outs["odd"])


@query("select l_orderkey, count(*) as lines from lineitem group by l_orderkey")
def cast_sorted_reduce(spark, d):
    """Every order of the table: sorted by hand in the session's partitions, asserted, and reduced."""
    s = D.repartition_sort(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")
    return D.reduce_by(D.cast_to_sorted(s, "l_orderkey"), ["l_orderkey"], lines=F.count(F.lit(1)))


@query("select c_custkey, c_name from (select * from customer where c_nationkey < 10 order by c_acctbal desc, c_custkey limit 20 offset 10) union select c_custkey, c_name from customer where c_custkey in (1, 2)")
def grid_page(spark, d):
    return grid.page(table(spark, d, "customer"), ["c_custkey", "c_name"], "c_custkey", {"c_nationkey": F.col("c_nationkey") < 10}, {"c_acctbal": False}, 10, 20, [1, 2])


# ---- expressions


@query("""select l_orderkey, l_linenumber, (l_orderkey & 255) as a, (l_orderkey | 1) as o, xor(l_orderkey, l_partkey) as x, l_orderkey * 4 as l, l_orderkey >> 3 as r from lineitem""")
def expr_bitops(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", k.bitwiseAND(255).alias("a"), k.bitwiseOR(1).alias("o"), k.bitwiseXOR(F.col("l_partkey")).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 3).alias("r"))


@query("""select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_returnflag when 1 then l_linestatus when 2 then 'two' else 'more' end as pick,
case l_returnflag when 'A' then 1 when 'N' then 2 else 0 end as code from lineitem""")
def expr_switch(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.switch(F.col("l_linenumber") % 4, [F.col("l_returnflag"), F.col("l_linestatus"), F.lit("two")], F.lit("more")).alias("pick"), C.lookup_value(F.col("l_returnflag"), {"A": 1, "N": 2}, 0).alias("code"))


@query("""select o_orderkey, len(l)::int as n, l[1] as first, list_sum(list_transform(l, lambda x: x * x))::bigint as squares from (select l_orderkey as o_orderkey, list(l_linenumber order by l_linenumber) as l from lineitem group by l_orderkey)""")
def expr_array(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    return a.select("o_orderkey", F.size("l").alias("n"), F.element_at("l", 1).alias("first"), F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + x * x).alias("squares"))


@query("select advertiser, name is null as missing, coalesce(trim(name), '?') as shown, nullif(advertiser, 3) as but_3 from advertisers")
def expr_null(spark, d):
    return table(spark, d, "advertisers").select("advertiser", F.col("name").isNull().alias("missing"), F.coalesce(F.trim("name"), F.lit("?")).alias("shown"), F.nullif("advertiser", F.lit(3)).alias("but_3"))


# ---- cube over the advertising log

_REST = ("log_date", "advertiser", "campaign", "banner", "affiliate", "site", "impressions", "clicks", "conversions", "revenue", "user_id", "errors")
_ONCE = f"""ads as (select * from (select *, row_number() over (partition by log_name, log_pos order by loaded_at nulls first, {', '.join(c + ' nulls first' for c in _REST)}) as rn from ad_log) where rn = 1)"""


def _ads(spark, d) -> DataFrame:
    """The log with each position once."""
    return D.first_by(table(spark, d, "ad_log"), ["log_name", "log_pos"], ["loaded_at", *_REST])


_DIMS = {"date": "date", "advertiser": "int", "campaign": "int", "banner": "int", "affiliate": "int", "site": "string"}
_COLUMNS = {"date": "log_date"} | {k: k for k in _DIMS if k != "date"}
_INPUTS = {"impressions": "impressions", "clicks": "clicks", "conversions": "conversions", "revenue": "revenue", "minRevenue": "revenue", "maxRevenue": "revenue", "errors": "errors", "eventCount": None, "uniqueUserIdsCount": "user_id"}


def ads_cube(spark: SparkSession, d: str | None = None) -> Cube:
    """The reporting cube: rollups by day, by advertiser chain and by affiliate chain."""
    every = tuple(_INPUTS)
    measures = {k: M.sum_("bigint") for k in ("impressions", "clicks", "conversions", "errors")} | {"revenue": M.sum_(), "minRevenue": M.min_(), "maxRevenue": M.max_(), "eventCount": M.count(), "uniqueUserIdsCount": M.distinct()}
    return Cube(
        _DIMS, measures,
        [
            Rollup("daily", ("date",), every),
            Rollup("advertisers", ("date", "advertiser", "campaign", "banner"), every, P.and_(P.ne("advertiser", 0), P.ne("campaign", 0), P.ne("banner", 0))),
            Rollup("affiliates", ("date", "affiliate", "site"), tuple(m for m in every if m != "errors"), P.and_(P.ne("affiliate", 0), P.ne("site", "--"))),
        ],
        computed={"ctr": C.percent("clicks", "impressions"), "errorsPercent": C.percent("errors", "impressions"), "meanRevenue": C.div("revenue", "eventCount"), "uniqueUserPercent": C.percent("uniqueUserIdsCount", "eventCount")},
        relations={"campaign": "advertiser", "banner": "campaign", "site": "affiliate"},
        attributes={"advertiser.name": Attribute(lambda: table(spark, d, "advertisers"), {"advertiser": "advertiser"}, "name")} if d else {},
    )


def _inputs() -> tuple[dict[str, Column], dict[str, Column | None]]:
    return {k: F.col(c) for k, c in _COLUMNS.items()}, {k: None if c is None else F.col(c) for k, c in _INPUTS.items()}


def _cube(spark, d) -> Cube:
    cube = ads_cube(spark, d)
    for name, df in cube.consume(_ads(spark, d), *_inputs()).items():
        cube.attach(name, df)
    return cube


_CHAIN = "advertiser <> 0 and campaign <> 0 and banner <> 0"
_PAGE = "affiliate <> 0 and site <> '--'"
_NO = P.and_(P.ne("advertiser", 0), P.ne("campaign", 0), P.ne("banner", 0))
_NO2 = P.and_(P.ne("affiliate", 0), P.ne("site", "--"))


@query(f"""with {_ONCE} select log_date as date, sum(impressions)::bigint as impressions, sum(clicks)::bigint as clicks, count(*) as "eventCount",
coalesce(round(sum(revenue), 4), 0) as revenue, min(revenue) as "minRevenue", max(revenue) as "maxRevenue" from ads group by log_date""")
def cube_group_by_date(spark, d):
    r = _cube(spark, d).query(CubeQuery(("date",), ("impressions", "clicks", "eventCount", "revenue", "minRevenue", "maxRevenue")))
    return r.records.withColumn("revenue", F.round("revenue", 4))


@query(f"with {_ONCE} select campaign, sum(clicks)::bigint as clicks from ads where {_CHAIN} group by advertiser, campaign")
def cube_with_parents(spark, d):
    return _cube(spark, d).query(CubeQuery(("campaign",), ("clicks",), where=_NO)).records


@query(f"with {_ONCE} select advertiser, count(*) as \"eventCount\" from ads where {_CHAIN} group by advertiser")
def cube_rollup_from_fine(spark, d):
    return _cube(spark, d).query(CubeQuery(("advertiser",), ("eventCount",), where=_NO)).records


#: Users that differ, counted exactly, and whether the cube's sketch of them is within three of its standard errors.
_UNIQUE = f"""with {_ONCE} select advertiser, count(distinct user_id) as users, true as close, true as percent_fits from ads where {_CHAIN} group by advertiser"""


def _unique(spark, d, cube: Cube) -> DataFrame:
    """A sketch is an estimate, so it is held against a count of the log itself, not against the SQL."""
    r = cube.query(CubeQuery(("advertiser",), ("uniqueUserIdsCount", "uniqueUserPercent", "eventCount"), where=_NO)).records
    exact = _ads(spark, d).where("advertiser <> 0 and campaign <> 0 and banner <> 0").groupBy("advertiser").agg(F.countDistinct("user_id").alias("users"))
    estimate, error = F.col("uniqueUserIdsCount"), 3 * 1.04 / 4096**0.5
    percent = estimate / F.col("eventCount") * 100
    return exact.join(r, "advertiser").select("advertiser", "users", (F.abs(estimate - F.col("users")) <= F.col("users") * error + 0.5).alias("close"), (F.abs(F.col("uniqueUserPercent") - percent) < 1e-6).alias("percent_fits"))


@query(_UNIQUE)
def cube_unique_users(spark, d):
    """Unique users as a measure that is merged from the finer keys of the rollup."""
    return _unique(spark, d, _cube(spark, d))


@query(f"with {_ONCE} select date_trunc('month', log_date)::date as month, sum(impressions)::bigint as impressions, sum(errors)::bigint as errors from ads group by 1")
def cube_raw_stream(spark, d):
    g = _cube(spark, d).raw(["date"], ["impressions", "errors"], P.always_true())
    return g.groupBy(F.trunc("date", "month").alias("month")).agg(F.sum("impressions").alias("impressions"), F.sum("errors").alias("errors"))


@query(f"with {_ONCE} select log_date as date, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions from ads group by log_date")
def cube_merge_two_rollups(spark, d):
    """Two rollups with one measure each are merged by key."""
    cube = Cube({"date": "date"}, {"clicks": M.sum_("bigint"), "impressions": M.sum_("bigint")}, [Rollup("a", ("date",), ("clicks",)), Rollup("b", ("date",), ("impressions",))])
    for name, df in cube.consume(_ads(spark, d), {"date": F.col("log_date")}, {"clicks": F.col("clicks"), "impressions": F.col("impressions")}).items():
        cube.attach(name, df)
    return cube.query(CubeQuery(("date",), ("clicks", "impressions"))).records


@query(f"with {_ONCE} select affiliate, site, sum(conversions)::bigint as conversions from ads where {_PAGE} and affiliate between 2 and 9 group by all")
def cube_routing_predicate_subset(spark, d):
    return _cube(spark, d).query(CubeQuery(("affiliate", "site"), ("conversions", "errors"), where=P.and_(_NO2, P.between("affiliate", 2, 9)))).records


_BY_ADV = f"{_ONCE}, g as (select advertiser, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions from ads where {_CHAIN} group by advertiser)"
_CTR = "case when sum(impressions) <> 0 then sum(clicks)::double / sum(impressions)::double else 0.0 end * 100"


@query(f"with {_BY_ADV} select sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions, round({_CTR}, 6) as ctr from g")
def cube_totals_before_having(spark, d):
    r = _cube(spark, d).query(CubeQuery(("advertiser",), ("clicks", "impressions", "ctr"), where=_NO, having=P.gt("clicks", 100)))
    return r.totals.withColumn("ctr", F.round("ctr", 6))


@query("select 0::bigint as clicks, 0::bigint as \"eventCount\", 0.0::double as ctr")
def cube_totals_empty(spark, d):
    return _cube(spark, d).query(CubeQuery(("date",), ("clicks", "eventCount", "ctr"), where=P.always_false())).totals


@query(f"with {_BY_ADV} select advertiser, clicks, round(case when impressions <> 0 then clicks::double / impressions::double else 0.0 end * 100, 6) as ctr from g where clicks > 100 and case when impressions <> 0 then clicks::double / impressions::double else 0.0 end * 100 >= 1.0")
def cube_having_measure(spark, d):
    r = _cube(spark, d).query(CubeQuery(("advertiser",), ("clicks", "ctr"), where=_NO, having=P.and_(P.gt("clicks", 100), P.ge("ctr", 1.0))))
    return r.records.withColumn("ctr", F.round("ctr", 6))


@query(f"with {_BY_ADV} select g.advertiser, a.name as \"advertiser.name\", clicks from g left join advertisers a using (advertiser) where a.name is null")
def cube_having_attr_null(spark, d):
    return _cube(spark, d).query(CubeQuery(("advertiser", "advertiser.name"), ("clicks",), where=_NO, having=P.eq("advertiser.name", None))).records


@query(f"with {_BY_ADV} select advertiser, impressions from g order by impressions desc, advertiser limit 10 offset 5")
def cube_order_limit_offset(spark, d):
    return _cube(spark, d).query(CubeQuery(("advertiser",), ("impressions",), where=_NO, order=(("impressions", False),), limit=10, offset=5)).records


@query(f"with {_BY_ADV} select count(*) as n from g where clicks > 50")
def cube_total_count(spark, d):
    return _cube(spark, d).query(CubeQuery(("advertiser",), ("clicks",), where=_NO, having=P.gt("clicks", 50), limit=3)).total_count


@query("select name as \"advertiser.name\" from (select 3 as advertiser) left join advertisers using (advertiser)")
def cube_filter_attributes(spark, d):
    return _cube(spark, d).query(CubeQuery(("campaign",), ("clicks",), where=P.and_(_NO, P.eq("advertiser", 3)))).filter_attributes


@query(f"with {_BY_ADV} select g.advertiser, a.name as \"advertiser.name\", impressions from g left join advertisers a using (advertiser)")
def attr_lookup(spark, d):
    return _cube(spark, d).query(CubeQuery(("advertiser", "advertiser.name"), ("impressions",), where=_NO)).records


@query(f"with {_ONCE} select log_date as date, sum(clicks)::bigint as clicks from ads where log_date between date '2023-04-01' and date '2023-04-30' group by log_date order by clicks desc, date limit 5")
def cube_from_params(spark, d):
    cube = _cube(spark, d)
    q = CubeQuery.from_params({"attributes": "date", "measures": "clicks,nothing", "where": '["between", "date", "2023-04-01", "2023-04-30"]', "sort": "clicks:desc", "limit": "5"}, cube)
    return cube.query(q).records


@query("""with g as (select event_type, sum(value) as s, sum(value * value) as q, count(*) as n from events group by event_type)
select event_type, round(s / n, 6) as mean, round(q / n - (s / n) * (s / n), 4) as variance, round(sqrt(q / n - (s / n) * (s / n)), 4) as stddev, 0.0::double as by_zero, 0.0::double as root, round(s * 100.0, 2) as hundred from g""")
def computed_measures(spark, d):
    m = {"s": M.sum_(), "q": M.sum_(), "n": M.count()}
    v = F.col("value")
    computed = {"mean": C.div("s", "n"), "variance": C.variance("s", "q", "n"), "stddev": C.stddev("s", "q", "n"), "by_zero": C.div("s", C.sub("n", "n")), "root": C.sqrt(C.mul("n", -1)), "hundred": C.percent("s")}
    cube = Cube({"event_type": "string"}, m, [Rollup("all", ("event_type",), tuple(m))], computed=computed)
    cube.attach("all", cube.consume(table(spark, d, "events"), {"event_type": F.col("event_type")}, {"s": v, "q": v * v, "n": None})["all"])
    r = cube.query(CubeQuery(("event_type",), tuple(computed))).records
    return r.select("event_type", *(F.round(k, {"mean": 6, "hundred": 2}.get(k, 4)).alias(k) for k in computed))


@query("""select r_name, n_name, l_returnflag, sum(l_quantity)::bigint as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as net
from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all""")
def cube_hierarchy(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    dims = {"r_name": "string", "n_name": "string", "l_returnflag": "string"}
    cube = Cube(dims, {"quantity": M.sum_(), "net": M.sum_()}, [Rollup("all", tuple(dims), ("quantity", "net"))], relations={"n_name": "r_name"})
    cube.attach("all", cube.consume(li, {k: F.col(k) for k in dims}, {"quantity": F.col("l_quantity"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})["all"])
    r = cube.query(CubeQuery(("r_name", "n_name", "l_returnflag"), ("quantity", "net"))).records
    return r.withColumns({"quantity": F.col("quantity").cast("bigint"), "net": F.round("net", 2)})


# ---- stored rollups, logs, streams


def _store(spark, d, parts: int = 4, chunk_rows: int = 1_000_000) -> RollupStore:
    """The reporting cube ingested in several commits, by hour of arrival."""
    store = RollupStore(spark, new_dir(spark, "cube"), ads_cube(spark, d), chunk_rows)
    ads = _ads(spark, d)
    for i in range(parts):
        store.ingest(store.cube.consume(ads.where(F.pmod(F.hour("loaded_at"), F.lit(parts)) == i), *_inputs()))
    return store


_STORED = f"with {_ONCE} select advertiser, sum(clicks)::bigint as clicks, coalesce(round(sum(revenue), 4), 0) as revenue, count(*) as \"eventCount\" from ads where {_CHAIN} and log_date between date '2023-04-01' and date '2023-05-15' group by advertiser"


def _stored(store: RollupStore) -> DataFrame:
    import datetime as dt

    where = P.and_(_NO, P.between("date", dt.date(2023, 4, 1), dt.date(2023, 5, 15)))
    return store.cube.query(CubeQuery(("advertiser",), ("clicks", "revenue", "eventCount"), where=where)).records.withColumn("revenue", F.round("revenue", 4))


@query(_STORED)
def lsm_ingest_query(spark, d):
    return _stored(_store(spark, d))


@query(_STORED)
def lsm_consolidated(spark, d):
    store = _store(spark, d)
    store.upkeep()
    store.vacuum(0)
    return _stored(store)


@query(_UNIQUE)
def lsm_unique_users(spark, d):
    """The same from stored chunks, consolidated."""
    store = _store(spark, d)
    store.upkeep()
    return _unique(spark, d, store.cube)


@query(_STORED)
def lsm_backup(spark, d):
    """Read from a backup, after the original is gone on."""
    store, to = _store(spark, d, 2), new_dir(spark, "backup")
    store.backup(to)
    store.upkeep()
    store.vacuum(0)
    return _stored(RollupStore(spark, to, ads_cube(spark, d)))


@query(f"with {_ONCE} select log_date as date, sum(clicks)::bigint as clicks, coalesce(sum(case when hour(loaded_at) % 2 = 1 then impressions end), 0)::bigint as impressions from ads group by log_date")
def lsm_measure_evolution(spark, d):
    """Chunks written before a measure came count as 0 of it."""
    root, ads = new_dir(spark, "cube"), _ads(spark, d)
    sums = {"clicks": M.sum_("bigint"), "impressions": M.sum_("bigint")}
    old = RollupStore(spark, root, Cube({"date": "date"}, {"clicks": sums["clicks"]}, [Rollup("daily", ("date",), ("clicks",))]))
    old.ingest(old.cube.consume(ads.where(F.hour("loaded_at") % 2 == 0), {"date": F.col("log_date")}, {"clicks": F.col("clicks")}))
    new = RollupStore(spark, root, Cube({"date": "date"}, sums, [Rollup("daily", ("date",), ("clicks", "impressions"))]))
    new.ingest(new.cube.consume(ads.where(F.hour("loaded_at") % 2 == 1), {"date": F.col("log_date")}, {k: F.col(k) for k in sums}))
    return new.cube.query(CubeQuery(("date",), ("clicks", "impressions"))).records


def _log_result(store: RollupStore) -> DataFrame:
    return store.cube.query(CubeQuery(("date",), ("clicks", "impressions", "eventCount"))).records


_LOG = f"with {_ONCE} select log_date as date, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions, count(*) as \"eventCount\" from ads group by log_date"


@query(_LOG)
def log_incremental_ingest(spark, d):
    """Each hour of the log is written in two steps; the log is ingested after each, and once more."""
    root, ads = new_dir(spark, "log"), _ads(spark, d)
    store = RollupStore(spark, new_dir(spark, "cube"), ads_cube(spark, d))
    consumers = [(lambda rows: rows, *_inputs(), None)]
    part = F.regexp_replace("log_name", r"\..*", "")
    for i in range(2):
        logs.write_log(ads.where(F.pmod(F.xxhash64("log_pos"), F.lit(2)) == i), root, part, F.date_trunc("day", "loaded_at"))  # a file a day: the log is thin
        ingest.ingest_log(spark, root, store, consumers, "ads")
    ingest.ingest_log(spark, root, store, consumers, "ads")
    return _log_result(store)


@query(_LOG)
def log_same_hour_append(spark, d):
    """Three writes to one open hour of two partitions, an ingest after each."""
    root, ads = new_dir(spark, "log"), _ads(spark, d)
    store = RollupStore(spark, new_dir(spark, "cube"), ads_cube(spark, d))
    part = F.when(F.col("log_name").like("%a%"), "a").otherwise("b")
    hour = F.lit("2023-05-01 12:00:00").cast("timestamp")
    for i in range(3):
        logs.write_log(ads.where(F.pmod(F.xxhash64("log_pos"), F.lit(3)) == i), root, part, hour)
        ingest.ingest_log(spark, root, store, [(lambda rows: rows, *_inputs(), None)], "ads")
    return _log_result(store)


@query(_LOG)
def log_stream_ingest(spark, d):
    """A file stream into the rollups, run twice over the same checkpoint."""
    root, checkpoint = new_dir(spark, "stream-in"), new_dir(spark, "stream-checkpoint")
    ads = _ads(spark, d)
    store = RollupStore(spark, new_dir(spark, "cube"), ads_cube(spark, d))
    consumers = [(lambda rows: rows, *_inputs(), None)]
    for i in range(2):
        ads.where(F.pmod(F.xxhash64("log_pos"), F.lit(2)) == i).write.mode("append").parquet(root)
        ingest.stream_into(spark.readStream.schema(ads.schema).option("maxFilesPerTrigger", 64).parquet(root), store, consumers, "ads", checkpoint).awaitTermination()
    return _log_result(store)


@query("""with p as (select event_type, user_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k from events)
select event_type, count(*) as requests, sum(k % 3)::bigint as items from p group by event_type""")
def log_splitter_fanout(spark, d):
    """One log, two consumers: requests, and the items nested in them."""
    cube = Cube({"event_type": "string"}, {"requests": M.count(), "items": M.count()}, [Rollup("types", ("event_type",), ("requests", "items"))])
    store = RollupStore(spark, new_dir(spark, "cube"), cube)
    e = table(spark, d, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0)))
    dims = {"event_type": F.col("event_type")}
    fan = lambda rows: rows.select("event_type", F.explode(F.when(F.col("k") % 3 > 0, F.sequence(F.lit(1), F.col("k") % 3)).otherwise(F.array().cast("array<bigint>"))).alias("item"))
    store.ingest(ingest._parts(store, e, [(lambda rows: rows, dims, {"requests": None}, None), (fan, dims, {"items": None}, None)]))
    return cube.query(CubeQuery(("event_type",), ("requests", "items"))).records


# ---- replicated state


@query("select user_id as key, sum(v)::bigint as value from (select user_id, event_type, max(event_id % 100) as v from events group by all) group by user_id")
def crdt_gcounter(spark, d):
    return crdt.g_counter(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("replica"), (F.col("event_id") % 100).alias("value")))


@query("select user_id as key, sum(p - n)::bigint as value from (select user_id, event_type, max(event_id % 100) as p, max(event_id % 70) as n from events group by all) group by user_id")
def crdt_pncounter(spark, d):
    return crdt.pn_counter(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("replica"), (F.col("event_id") % 100).alias("p"), (F.col("event_id") % 70).alias("n")))


def _elements(spark, d, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), (F.col("event_id") % 10).alias("element"))


@query("select distinct user_id as key, event_id % 10 as element from events where event_type = 'click'")
def crdt_gset(spark, d):
    return crdt.g_set(_elements(spark, d, "click"))


@query("""select distinct user_id as key, event_id % 10 as element from events where event_type = 'click'
except select user_id, event_id % 10 from events where event_type = 'error'""")
def crdt_tpset(spark, d):
    return crdt.tp_set(_elements(spark, d, "click"), _elements(spark, d, "error"))


@query("""select key, element from (select user_id as key, event_id % 10 as element, max(ts) filter (where event_type <> 'error') as a, max(ts) filter (where event_type = 'error') as r from events group by all)
where a is not null and (r is null or a >= r)""")
def crdt_lwwset(spark, d):
    e = table(spark, d, "events")
    return crdt.lww_set(e.select(F.col("user_id").alias("key"), (F.col("event_id") % 10).alias("element"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("removed")))


def _kv(spark, d) -> crdt.Store:
    e = table(spark, d, "events").where("event_type <> 'error'").select(F.col("user_id").alias("key"), F.col("value").alias("best"), "ts")
    return crdt.Store({"best": F.max}, e)


_LIVE = "live as (select user_id as key, max(value) as best, max(ts) as ts from events where event_type <> 'error' group by user_id)"
_GONE = "gone as (select user_id as key, max(ts) as g from events where event_type = 'error' and event_id % 3 = 0 group by user_id)"


@query(f"with {_LIVE} select key, best from live where ts >= timestamp '2024-01-30 12:00:00'")
def crdt_download_since(spark, d):
    return _kv(spark, d).download(F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("key", "best")


def _removed(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error' and event_id % 3 = 0").select(F.col("user_id").alias("key"), "ts")


@query(f"with {_LIVE}, {_GONE} select key, best from live left join gone using (key) where g is null or g < ts")
def crdt_remove(spark, d):
    return _kv(spark, d).remove(_removed(spark, d)).read().select("key", "best")


@query(f"with {_LIVE}, {_GONE} select key, best from live left join gone using (key) where g is null or g < ts")
def crdt_cluster(spark, d):
    """Three replicas, one with the removals, read as one and consolidated."""
    e = _kv(spark, d).states
    stores = [crdt.Store({"best": F.max}, e.where(F.pmod(F.xxhash64("key", "ts"), F.lit(3)) == i)) for i in range(3)]
    stores[1] = stores[1].remove(_removed(spark, d))
    return crdt.Store.cluster(stores).consolidated().read().select("key", "best")


@query("""with recursive p(page, links) as (values (1, [1, 2, 3]), (3, [1]), (2, [1])), s(i, a, b, c) as (
select 0, 1.0::double, 1.0::double, 1.0::double union all select i + 1, a / 3 + b + c, a / 3, a / 3 from s where i < 10)
select k::bigint as page, round(v, 9) as rank from (select unnest([1, 2, 3]) as k, unnest([a, b, c]) as v from s where i = 10)""")
def page_rank_10(spark, d):
    pages = D.of(spark, [(1, [1, 2, 3]), (3, [1]), (2, [1])], "page bigint, links array<bigint>")
    return D.page_rank(pages, 10).select("page", F.round("rank", 9).alias("rank"))


_STEPS = ",\n".join(f"s{i + 1} as materialized (select l.link as page, sum(s.rank / n.n) as rank from links l join n using (page) join s{i} s using (page) group by l.link)" for i in range(10))


@query(f"""with links as materialized (select distinct revision_id as page, parent_id as link from diffs where revision_id is not null and parent_id is not null),
n as materialized (select page, count(*) as n from links group by page), s0 as materialized (select page, 1.0::double as rank from n),
{_STEPS}
select page, round(rank, 9) as rank from s10""")
def page_rank_links(spark, d):
    """Ten steps over the graph of all revisions and their parents."""
    links = table(spark, d, "diffs").where("revision_id is not null and parent_id is not null")
    pages = links.groupBy(F.col("revision_id").alias("page")).agg(F.collect_set("parent_id").alias("links"))
    return D.page_rank(pages, 10).select("page", F.round("rank", 9).alias("rank"))


# ---- flagship


@query("""select l_shipdate::date as day, l_returnflag, sum(l_quantity)::bigint as quantity, count(*) as lines, round(sum(l_extendedprice), 2) as gross,
round(sum(l_quantity)::double / count(*) * 100, 6) as per_hundred from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1998-01-01' group by all""")
def cube_flagship(spark, d):
    import datetime as dt

    m = {"quantity": M.sum_(), "lines": M.count(), "gross": M.sum_()}
    cube = Cube({"day": "date", "l_returnflag": "string"}, m, [Rollup("days", ("day", "l_returnflag"), tuple(m))], computed={"per_hundred": C.percent("quantity", "lines")})
    where = P.and_(P.ge("day", dt.date(1996, 1, 1)), P.lt("day", dt.date(1998, 1, 1)))
    # The period is also said of the time column itself: a condition on its date can't reach the scan.
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    li = table(spark, d, "lineitem").where((F.col("l_shipdate") >= at("1996-01-01")) & (F.col("l_shipdate") < at("1998-01-01")))
    cube.attach("days", cube.consume(li, {"day": F.to_date("l_shipdate"), "l_returnflag": F.col("l_returnflag")}, {"quantity": F.col("l_quantity"), "lines": None, "gross": F.col("l_extendedprice")}, where)["days"])
    r = cube.query(CubeQuery(("day", "l_returnflag"), ("quantity", "lines", "gross", "per_hundred"), where=where, order=(("day", True),))).records
    return r.withColumns({"quantity": F.col("quantity").cast("bigint"), "gross": F.round("gross", 2), "per_hundred": F.round("per_hundred", 6)})
