"""Ready queries over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korrel.functions import custom, equals, less
from korrel.operators import average, average_runs, distinct, distinct_runs, hash_join, hybrid_join, limit, merge, project, select, sort, top_k
from korrel.schema import FLOAT64, INT32, STRING, Table, column, schema
from korrel.scratch import Scratch
from korrel.sources import HeapFile, Index, csv_scan, memory_scan, parquet_scan
from korrel.streaming import spill

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return parquet_scan(spark, f"{sf_dir}/{name}.parquet", name)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts with the highest average price."""
    return flagship_topk_average(spark, sf_dir)


@query("select l_partkey, average from (select l_partkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as average from lineitem group by l_partkey) order by average desc, l_partkey limit 10")
def flagship_topk_average(spark, sf_dir):
    lines = project(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_extendedprice"])
    return top_k(average(lines, "l_extendedprice", "l_partkey", exact=True), "average", 10, ties=["l_partkey"]).df


@query("select l_partkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as average from lineitem group by l_partkey")
def average_float(spark, sf_dir):
    return average(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_partkey", exact=True).df


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as average from lineitem group by l_returnflag")
def average_large_groups(spark, sf_dir):
    return average(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", exact=True).df


@query("select l_partkey, avg(l_quantity) as average from lineitem group by l_partkey")
def average_plain(spark, sf_dir):
    return average(table(spark, sf_dir, "lineitem"), "l_quantity", "l_partkey").df


@query("select p_brand, avg(cast(p_size as double)) as average from part group by p_brand")
def average_int_coerced(spark, sf_dir):
    return average(table(spark, sf_dir, "part"), "p_size", "p_brand").df


@query("select p_brand, avg(cast(cast(p_size as varchar) as double)) as average from part group by p_brand")
def average_string_coerced(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return average(Table("part", part.df.select("p_brand", F.col("p_size").cast("string").alias("p_size"))), "p_size", "p_brand").df


@query(
    "select o_orderstatus, avg(k) as average from (select *, sum(new) over (order by o_orderkey) as run from (select o_orderkey, o_orderstatus, cast(o_custkey as double) as k, case when o_orderstatus = lag(o_orderstatus) over (order by o_orderkey) then 0 else 1 end as new from orders)) group by run, o_orderstatus"
)
def average_by_runs(spark, sf_dir):
    return average_runs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["o_orderkey"]).df


@query("select o_orderkey, o_orderstatus from (select o_orderkey, o_orderstatus, lag(o_orderstatus) over (order by o_orderkey) as before from orders) where before is null or before <> o_orderstatus")
def distinct_by_runs(spark, sf_dir):
    orders = project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])
    return distinct_runs(orders, ["o_orderkey"], ["o_orderstatus"]).df


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_rows(spark, sf_dir):
    return distinct(project(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])).df


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_projection(spark, sf_dir):
    return distinct(project(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])).df


@query("select * from customer where c_mktsegment = 'BUILDING'")
def select_equals(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return select(t, equals(t, "c_mktsegment", "BUILDING")).df


@query("select * from customer where false")
def select_equals_other_type(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return select(t, equals(t, "c_custkey", "1")).df


@query("select * from customer where c_name < 'Customer#000000500'")
def select_less_string(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return select(t, less(t, "c_name", "Customer#000000500")).df


@query("select * from part where p_size < 10")
def select_less_int(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return select(t, less(t, "p_size", 10)).df


@query("select * from customer where c_acctbal < 0.0")
def select_less_double(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    return select(t, less(t, "c_acctbal", 0.0)).df


@query("select * from part where not p_size < 10 and p_size < 20 or p_brand = 'Brand#11'")
def select_algebra(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    return select(t, ~less(t, "p_size", 10) & less(t, "p_size", 20) | equals(t, "p_brand", "Brand#11")).df


@query("select * from nation where n_nationkey % 3 = 1 and length(n_name) > 5")
def select_custom(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return select(t, custom(lambda k, name: k % 3 == 1 and len(name) > 5, "n_nationkey", "n_name")).df


@query("select p_size, p_partkey, p_name from part")
def project_reorder(spark, sf_dir):
    return project(table(spark, sf_dir, "part"), ["p_size", "p_partkey", "p_name"]).df


_JOINED = 'c_custkey as "customer.c_custkey", c_name as "customer.c_name", o_orderkey as "orders.o_orderkey", o_custkey as "orders.o_custkey", o_totalprice as "orders.o_totalprice"'


@query(f"select {_JOINED} from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
def join_broadcast_filter(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]).renamed("orders")
    building = project(select(c, equals(c, "c_mktsegment", "BUILDING")), ["c_custkey", "c_name"]).renamed("customer")
    return hash_join(building, o, "c_custkey", "o_custkey").df


_LINES = 'o_orderkey as "orders.o_orderkey", o_orderstatus as "orders.o_orderstatus", l_orderkey as "lineitem.l_orderkey", l_linenumber as "lineitem.l_linenumber", l_quantity as "lineitem.l_quantity"'


def _orders_lines(spark, sf_dir):
    o = project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"]).renamed("orders")
    return o, project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"]).renamed("lineitem")


@query(f"select {_LINES} from orders join lineitem on o_orderkey = l_orderkey")
def join_shuffle_hash(spark, sf_dir):
    o, lines = _orders_lines(spark, sf_dir)
    return hash_join(o, lines, "o_orderkey", "l_orderkey", "shuffle_hash").df


@query(f"select {_LINES} from orders join lineitem on o_orderkey = l_orderkey")
def join_merge(spark, sf_dir):
    o, lines = _orders_lines(spark, sf_dir)
    return hash_join(o, lines, "o_orderkey", "l_orderkey", "merge").df


@query(f"select {_LINES} from orders join lineitem on o_orderkey = l_orderkey")
def join_hybrid(spark, sf_dir):
    o, lines = _orders_lines(spark, sf_dir)
    return hybrid_join(o, lines, "o_orderkey", "l_orderkey", 0.1, 9).df


@query(f"select {_LINES} from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 5 = 0")
def join_hybrid_filter(spark, sf_dir):
    o, lines = _orders_lines(spark, sf_dir)
    return hybrid_join(Table("orders", o.df.filter("o_orderkey % 5 = 0")), lines, "o_orderkey", "l_orderkey", 0.1, 9, bloom=True).df


@query("select a.user_id as user_id, count(*) as n from events a join events b on a.user_id = b.user_id group by a.user_id")
def join_self_count(spark, sf_dir):
    # Pairs of equal keys are counted from the keys' counts, so none is made.
    e = table(spark, sf_dir, "events").df.groupBy("user_id").agg(F.count("*").alias("n"))
    joined = hash_join(Table("a", e), Table("b", e), "user_id", "user_id", "auto")
    return joined.df.select(column("a.user_id").alias("user_id"), (column("a.n") * column("b.n")).alias("n"))


@query("select a.o_orderkey as \"a.o_orderkey\", a.o_custkey as \"a.o_custkey\", b.o_orderkey as \"b.o_orderkey\", b.o_custkey as \"b.o_custkey\" from orders a join orders b on a.o_custkey = b.o_custkey where a.o_orderstatus = 'F' and b.o_orderstatus = 'P'")
def join_self_filtered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = ["o_orderkey", "o_custkey"]
    a = project(select(o, equals(o, "o_orderstatus", "F")), keys).renamed("a")
    b = project(select(o, equals(o, "o_orderstatus", "P")), keys).renamed("b")
    return hash_join(a, b, "o_custkey", "o_custkey", "shuffle_hash").df


@query("select c_name as \"customer.c_name\", cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as average from customer join orders on c_custkey = o_custkey where c_name = 'Customer#000000042' group by c_name")
def join_filter_average(spark, sf_dir):
    joined = hash_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    one = select(joined, equals(joined, "customer.c_name", "Customer#000000042"))
    return average(project(one, ["customer.c_name", "orders.o_totalprice"]), "orders.o_totalprice", "customer.c_name", exact=True).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topk(spark, sf_dir):
    return top_k(project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"]), "o_totalprice", 10, ties=["o_orderkey"]).df


def _position(t: Table) -> DataFrame:
    """The rows with their place in the table's own order.

    Places come from the partitions and the rows' places there, written once as they
    come, so the order is the operator's and no task sees more than its partition.
    """
    rows = Scratch(t.df.sparkSession).keep(t.df.withColumn("at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    return rows.join(F.broadcast(before), "part").withColumn("pos", place).drop("at", "part", "before")


@query("select n_nationkey, n_name, row_number() over (order by n_name desc) as pos from nation")
def sort_position(spark, sf_dir):
    return _position(sort(project(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"]), "n_name", descending=True))


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as pos from orders")
def sort_all(spark, sf_dir):
    return _position(sort(project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"]), "o_totalprice", ties=["o_orderkey"]))


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as pos from orders")
def sort_descending(spark, sf_dir):
    return _position(sort(project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"]), "o_totalprice", descending=True, ties=["o_orderkey"]))


@query("select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) as pos from orders")
def merge_sorted(spark, sf_dir):
    o = project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])
    parts = [sort(select(o, equals(o, "o_orderstatus", x)), "o_orderkey") for x in ("P", "F", "O")]
    return _position(merge(parts, "o_orderkey"))


@query("select 7 as n, 7 as n_keys, 0 as n_others from region limit 1")
def limit_some(spark, sf_dir):
    # Which rows come is open, how many and that the table has them is not.
    first = limit(table(spark, sf_dir, "nation"), 7).df
    every = table(spark, sf_dir, "nation").df.select(F.struct("*").alias("row"))
    found = first.join(every, F.struct(*first.columns) == F.col("row"), "left")
    return found.agg(F.count("*").cast("int").alias("n"), F.countDistinct("n_nationkey").cast("int").alias("n_keys"), F.count_if(F.col("row").isNull()).cast("int").alias("n_others"))


@query("select * from region limit 100")
def limit_all(spark, sf_dir):
    return limit(table(spark, sf_dir, "region"), 100).df


@query("select * from region limit 0")
def limit_zero(spark, sf_dir):
    return limit(table(spark, sf_dir, "region"), 0).df


@query("select * from (values (1, 'ann', 0.5), (2, 'bob', -1.5), (3, '', 2.0)) t(id, name, score)")
def scan_memory(spark, sf_dir):
    return memory_scan(spark, "people", schema(("id", INT32), ("name", STRING), ("score", FLOAT64)), [(1, "ann", 0.5), (2, "bob", -1.5), (3, "", 2.0)]).df


@query("select * from nation")
def csv_roundtrip(spark, sf_dir):
    path = Scratch(spark).path("nation")
    table(spark, sf_dir, "nation").df.coalesce(1).write.option("header", True).csv(path)
    return csv_scan(spark, path, "nation", schema(("n_nationkey", INT32), ("n_name", STRING), ("n_regionkey", INT32))).df


@query("select * from supplier")
def spill_roundtrip(spark, sf_dir):
    path = Scratch(spark).path("supplier")
    spill.write(table(spark, sf_dir, "supplier"), path)
    return spill.scan(spark, path, "supplier").df


@query("select cast(o_orderkey % 3 as int) as partition, count(*) as n from orders group by 1")
def partitioned_write(spark, sf_dir):
    path = Scratch(spark).path("orders")
    spill.write_partitioned(table(spark, sf_dir, "orders"), path, F.col("o_orderkey") % 3, 3)
    return spill.scan(spark, path, "orders").df.groupBy("partition").agg(F.count("*").alias("n"))


def _heap(spark: SparkSession, sf_dir: str, name: str) -> tuple[HeapFile, str]:
    path = Scratch(spark).path(name)
    return HeapFile.bulk_load(spark, f"{path}/heap", table(spark, sf_dir, name).df), path


@query("select * from orders where o_orderkey % 7 <> 0")
def delete_tombstone(spark, sf_dir):
    heap, _ = _heap(spark, sf_dir, "orders")
    heap.delete_all(heap.scan_with_ids().filter("record.o_orderkey % 7 = 0").select("id.*"))
    return heap.scan("orders").df


@query("select * from nation union all select n_nationkey + 100, n_name, n_regionkey from nation")
def heap_insert(spark, sf_dir):
    heap, _ = _heap(spark, sf_dir, "nation")
    heap.insert(table(spark, sf_dir, "nation").df.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))
    return heap.scan("nation").df


@query("select n_nationkey + 100 as n_nationkey, n_name, n_regionkey, true as found from nation")
def heap_insert_ids(spark, sf_dir):
    # Records are addressed by the ids that their insert returned.
    heap, _ = _heap(spark, sf_dir, "nation")
    ids = heap.insert(table(spark, sf_dir, "nation").df.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))
    rows = heap.scan_with_ids()
    return ids.join(rows, (F.col("id.file") == ids.file) & (F.col("id.row") == ids.row)).select("record.*", F.lit(True).alias("found"))


@query("select r_regionkey, r_name from region union all select 90, 'created'")
def heap_create(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    heap = HeapFile.create(spark, f"{Scratch(spark).path('region')}/heap", region.df.schema)
    heap.insert(region.df)
    heap.insert_one((90, "created"))
    return HeapFile(spark, heap.path).scan("region").df


@query("select r_regionkey, r_name from region where r_regionkey < 3")
def heap_get(spark, sf_dir):
    heap, _ = _heap(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "region").df.filter("r_regionkey < 3").collect()
    ids = [heap.insert_one(tuple(r)) for r in rows]
    return spark.createDataFrame([heap.get(i) for i in ids], heap.fields)


@query("select r_regionkey, r_name from region union all select 92, 'kept'")
def heap_delete_one(spark, sf_dir):
    heap, _ = _heap(spark, sf_dir, "region")
    gone, _ = heap.insert_one((91, "gone")), heap.insert_one((92, "kept"))
    heap.delete(gone)
    heap.delete(gone)
    return heap.scan("region").df


@query("select count(*) as n, count(*) as n_ids from orders")
def heap_record_ids(spark, sf_dir):
    heap, _ = _heap(spark, sf_dir, "orders")
    return heap.scan_with_ids().agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query("select * from orders where o_custkey = 42")
def index_equal(spark, sf_dir):
    heap, path = _heap(spark, sf_dir, "orders")
    return Index.build(f"{path}/index", heap, "o_custkey").scan_equal(heap, "orders", 42).df


@query("select * from orders where o_custkey >= 1400")
def index_range(spark, sf_dir):
    heap, path = _heap(spark, sf_dir, "orders")
    return Index.build(f"{path}/index", heap, "o_custkey", 0.7).scan_greater_equal(heap, "orders", 1400).df


@query("select * from orders where o_custkey = 42 and o_orderkey % 2 = 1")
def index_with_tombstones(spark, sf_dir):
    heap, path = _heap(spark, sf_dir, "orders")
    index = Index.build(f"{path}/index", heap, "o_custkey")
    heap.delete_all(heap.scan_with_ids().filter("record.o_orderkey % 2 <> 1").select("id.*"))
    return index.scan_equal(heap, "orders", 42).df


@query("select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) as average from orders where o_custkey = 42 group by o_custkey")
def index_lookup_average(spark, sf_dir):
    heap, path = _heap(spark, sf_dir, "orders")
    found = Index.build(f"{path}/index", heap, "o_custkey").scan_equal(heap, "orders", 42)
    return average(project(found, ["o_custkey", "o_totalprice"]), "o_totalprice", "o_custkey", exact=True).df


@query("select o_custkey as key, count(*) as n from orders where o_custkey in (41, 42) group by 1")
def index_add(spark, sf_dir):
    # Made empty, filled in two steps, opened again and looked up.
    heap, path = _heap(spark, sf_dir, "orders")
    entries = heap.scan_with_ids().select(F.col("record.o_custkey").alias("key"), "id.file", "id.row")
    index = Index.create(spark, f"{path}/index")
    for half in (0, 1):
        index.add(entries.filter(F.col("key") % 2 == half))
    index = Index(spark, f"{path}/index")
    return index.find_equal(41).unionByName(index.find_equal(42)).groupBy("key").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, dense_rank() over (order by o_custkey) as pos from orders where o_custkey >= 1400")
def index_range_order(spark, sf_dir):
    # The order of an index scan: keys in the order in which they first come.
    heap, path = _heap(spark, sf_dir, "orders")
    found = Index.build(f"{path}/index", heap, "o_custkey").scan_greater_equal(heap, "orders", 1400)
    rows = _position(project(found, ["o_orderkey", "o_custkey"]))
    firsts = rows.groupBy("o_custkey").agg(F.min("pos").alias("first"))
    ranks = firsts.select("o_custkey", F.row_number().over(Window.orderBy("first")).cast("long").alias("pos"))
    return rows.drop("pos").join(ranks, "o_custkey").select("o_orderkey", "o_custkey", "pos")
