import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from korrel.functions import as_double, custom, equals, less
from korrel.operators import average, average_runs, distinct, distinct_runs, hash_join, hybrid_join, limit, materialise, merge, project, select, sort, top_k
from korrel.operators.join import STRATEGIES
from korrel.schema import FLOAT64, INT32, STRING, Table, column, joined_fields, schema
from korrel.sources import memory_scan

NAMES = schema(("id", INT32), ("first", STRING), ("last", STRING))
PEOPLE = [(1, "Ann", "Lee"), (2, "Bob", "Ray"), (2, "Bob", "Ray"), (3, "Cy", "")]


@pytest.fixture(scope="module")
def people(spark):
    return memory_scan(spark, "people", NAMES, PEOPLE)


def rows(t):
    return [tuple(r) for r in materialise(t)]


def test_memory_scan_checks_and_keeps_order(spark):
    assert sorted(rows(memory_scan(spark, "people", NAMES, PEOPLE))) == sorted(PEOPLE)
    t = memory_scan(spark, "people", NAMES, PEOPLE, position="pos")
    assert [r[:3] for r in rows(sort(t, "pos"))] == PEOPLE
    for bad in ((2**31, "a", "b"), ("1", "a", "b"), (1, None, "b")):
        with pytest.raises(Exception):
            rows(memory_scan(spark, "people", NAMES, [bad]))
    with pytest.raises(TypeError):
        schema(("a", F.lit(1)))


def test_projection(people):
    t = project(people, ["last", "id", "last"])
    assert t.name == "projection(people, [last,id,last])"
    assert t.df.columns == ["last", "id", "last"]
    with pytest.raises(KeyError):
        project(people, ["nothing"])


def test_selection_and_predicates(spark, people):
    assert rows(select(people, equals(people, "last", "Lee"))) == [PEOPLE[0]]
    assert len(rows(select(people, less(people, "id", 3)))) == 3
    assert len(rows(select(people, ~less(people, "id", 2) & equals(people, "first", "Bob")))) == 2
    for other in ("1", 1.0, True):
        assert rows(select(people, equals(people, "id", other))) == []
        with pytest.raises(TypeError):
            less(people, "id", other)
    assert rows(select(people, equals(people, "last", ""))) == [PEOPLE[3]]
    assert len(rows(select(people, custom(lambda i, f: i > 1 and f < "C", "id", "first")))) == 2
    nan = memory_scan(spark, "n", schema(("x", FLOAT64)), [(math.nan,), (0.0,), (-0.0,)])
    assert len(rows(select(nan, equals(nan, "x", math.nan)))) == 1
    assert len(rows(select(nan, equals(nan, "x", math.nan, nan_equal=False)))) == 0
    assert len(rows(select(nan, equals(nan, "x", 0.0)))) == 2


def test_string_order_is_by_bytes(spark):
    t = memory_scan(spark, "t", schema(("s", STRING)), [("b",), ("B",), ("é",), ("z",), ("",)])
    assert [r[0] for r in rows(sort(t, "s"))] == ["", "B", "b", "z", "é"]
    assert len(rows(select(t, less(t, "s", "b")))) == 2


def test_distinct(people):
    assert sorted(rows(distinct(people))) == sorted(set(PEOPLE))


def test_limit(people):
    assert len(rows(limit(people, 2))) == 2 and len(rows(limit(people, 9))) == 4 and rows(limit(people, 0)) == []
    with pytest.raises(ValueError):
        limit(people, -1)


def test_average(spark):
    films = memory_scan(spark, "films", schema(("film", STRING), ("rating", FLOAT64), ("views", INT32)), [("a", 4.1, 2), ("b", 5.0, 2), ("c", 4.2, 3), ("d", 4.2, 3)])
    t = average(films, "rating", "views")
    assert t.name == "average(films.rating)" and t.df.columns == ["views", "average"] and t.kind("average") == "float"
    assert dict(rows(t)) == pytest.approx({2: 4.55, 3: 4.2})
    assert dict(rows(average(films, "rating", "views", exact=True))) == pytest.approx({2: 4.55, 3: 4.2})
    words = Table("w", films.df.select(F.col("rating").cast("string").alias("rating"), "views"))
    assert dict(rows(average(words, "rating", "views"))) == pytest.approx({2: 4.55, 3: 4.2})
    with pytest.raises(Exception):
        rows(average(films, "film", "views"))
    assert rows(Table("x", films.df.select(as_double(films, "film", lenient=True).alias("v")).limit(1))) == [(None,)]
    assert rows(average(Table("e", films.df.limit(0)), "rating", "views")) == []


@pytest.mark.parametrize("parts", [1, 4])
def test_runs(spark, parts):
    data = [(i, "aabbbacca"[i], float(i)) for i in range(9)] + [(i, "z", float(i)) for i in range(9, 60)]
    t = memory_scan(spark, "t", schema(("i", INT32), ("g", STRING), ("x", FLOAT64)), data[::-1])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = rows(average_runs(t, "x", "g", ["i"]))
        assert got == [("a", 0.5), ("b", 3.0), ("a", 5.0), ("c", 6.5), ("a", 8.0), ("z", 34.0)]
        assert [r[0] for r in rows(distinct_runs(t, ["i"], ["g"]))] == [0, 2, 5, 6, 8, 9]
        assert rows(average_runs(Table("e", t.df.limit(0)), "x", "g", ["i"])) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many") / "t")
    spark.range(2_000_000, numPartitions=16).selectExpr("id", "cast(pmod(xxhash64(id), 3) as int) as g", "cast(id % 7 as double) as x").repartition(16, "x").write.parquet(path)
    return path


@pytest.mark.parametrize("parts", [2, 8, 64])
def test_runs_over_many_files(spark, many, parts):
    import duckdb

    runs = f"(select *, sum(new) over (order by id) as run from (select *, case when g = lag(g) over (order by id) then 0 else 1 end as new from '{many}/*.parquet'))"
    con = duckdb.connect()
    n, firsts = con.execute(f"select sum(new)::bigint, sum(id * new)::bigint from {runs}").fetchone()
    by_group = con.execute(f"select g, count(*), round(sum(a), 3) from (select g, run, avg(x) as a from {runs} group by 1, 2) group by 1 order by 1").fetchall()
    t = Table("t", spark.read.parquet(many))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = distinct_runs(t, ["id"], ["g"]).df
        assert tuple(found.agg(F.count("*"), F.sum("id")).first()) == (n, firsts)
        averages = average_runs(t, "x", "g", ["id"]).df.groupBy("g").agg(F.count("*"), F.round(F.sum("average"), 3)).orderBy("g")
        assert [tuple(r) for r in averages.collect()] == by_group
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("field,kind", [("film", STRING), ("rating", FLOAT64), ("year", INT32)])
@pytest.mark.parametrize("descending", [False, True])
def test_sort_and_merge(spark, field, kind, descending):
    fields = schema(("film", STRING), ("rating", FLOAT64), ("year", INT32))
    data = [("d", 4.5, 1999), ("a", 2.5, 2003), ("c", 3.0, 1950), ("b", 3.5, 2020)]
    at = fields.names.index(field)
    want = sorted(data, key=lambda r: r[at], reverse=descending)
    t = memory_scan(spark, "films", fields, data)
    assert rows(sort(t, field, descending)) == want
    parts = [sort(memory_scan(spark, "films", fields, x), field, descending) for x in (data[:1], data[1:], [])]
    assert rows(merge(parts, field, descending)) == want
    assert rows(top_k(t, field, 2, descending)) == want[:2]
    with pytest.raises(TypeError):
        merge([t, project(t, ["film"])], "film")
    with pytest.raises(ValueError):
        merge([], "film")


def test_nan_sorts_last(spark):
    t = memory_scan(spark, "t", schema(("x", FLOAT64)), [(math.nan,), (1.0,), (math.inf,)])
    assert [repr(r[0]) for r in rows(sort(t, "x"))] == ["1.0", "inf", "nan"]


@pytest.fixture(scope="module")
def logins(spark):
    users = [(f"u{i}", i) for i in range(7)]
    return (
        memory_scan(spark, "user", schema(("username", STRING), ("id", INT32)), users),
        memory_scan(spark, "login", schema(("user_id", INT32), ("timestamp", INT32)), [(t % 7, t) for t in range(100)]),
    )


@pytest.mark.parametrize("strategy", [*STRATEGIES, "hybrid"])
def test_joins(logins, strategy):
    user, login = logins
    join = (lambda r: hybrid_join(r, login, "id", "user_id", 0.3, 5, bloom=True)) if strategy == "hybrid" else (lambda r: hash_join(r, login, "id", "user_id", strategy))
    t = join(user)
    assert t.name == "join(user.id = login.user_id)"
    assert t.df.columns == ["user.username", "user.id", "login.user_id", "login.timestamp"]
    assert len(rows(t)) == 100 and all(r[1] == r[2] for r in rows(t))
    assert len(rows(join(Table("user", user.df.unionAll(user.df))))) == 200
    assert rows(join(Table("user", user.df.limit(0)))) == []
    assert len(rows(select(t, equals(t, "user.username", "u3")))) == 14
    nested = hash_join(t, login, "user.id", "user_id")
    assert "join(user.id = login.user_id).user.id" in nested.df.columns


def test_hybrid_join_filters_by_the_first_tables_keys(spark, logins, monkeypatch):
    from korrel.operators import join

    one = Table("user", spark.range(7).selectExpr("cast(id as int) as id").filter("id % 4 = 3"))  # its size is known
    login = Table("login", logins[1].df.withColumnRenamed("timestamp", "key"))
    plan = lambda t: t.df._jdf.queryExecution().optimizedPlan().toString()
    on, off = (hybrid_join(one, login, "id", "user_id", 0.3, 5, bloom=x) for x in (True, False))
    assert sorted(rows(on)) == sorted(rows(off)) and len(rows(on)) == 14
    assert plan(on).count("Join") == 2 and plan(off).count("Join") == 1
    monkeypatch.setattr(join, "BROADCAST_BYTES", 0)
    assert 1 == plan(hybrid_join(one, login, "id", "user_id", 0.3, 5, bloom=True)).count("Join")


def test_strategies_show_in_plans(spark, logins):
    user, login = Table("user", spark.range(7).selectExpr("cast(id as int) as id")), logins[1]
    plan = lambda s: hash_join(user, login, "id", "user_id", s).df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("broadcast") and "ShuffledHashJoin" in plan("shuffle_hash") and "SortMergeJoin" in plan("merge")


def test_large_tables_are_not_broadcast(logins, monkeypatch):
    from korrel.operators import join

    monkeypatch.setattr(join, "BROADCAST_BYTES", 0)
    user, login = logins
    t = hash_join(user, login, "id", "user_id")
    assert "SortMergeJoin" in t.df._jdf.queryExecution().executedPlan().toString() and len(rows(t)) == 100


def test_join_checks(spark, logins):
    user, login = logins
    doubles = Table("d", login.df.select(F.col("user_id").cast("double").alias("x")))
    for bad in (lambda: hash_join(user, doubles, "id", "x"), lambda: hash_join(user, login, "username", "user_id")):
        with pytest.raises(TypeError):
            bad()
    for fraction, parts in ((0, 5), (1, 5), (0.5, 0), (0.5, (1 << 20) + 1)):
        with pytest.raises(ValueError):
            hybrid_join(user, login, "id", "user_id", fraction, parts)
    with pytest.raises(ValueError):
        hash_join(user, login, "id", "user_id", "nested")
    keys = memory_scan(spark, "k", schema(("x", FLOAT64)), [(math.nan,), (0.0,)])
    other = memory_scan(spark, "o", schema(("x", FLOAT64)), [(math.nan,), (-0.0,)])
    assert len(rows(hash_join(keys, other, "x", "x"))) == 2
    assert len(rows(hash_join(keys, other, "x", "x", nan_equal=False))) == 1


def test_self_join_with_one_name(people):
    low, high = (Table("people", people.df.filter(f"id {op} 2")) for op in ("<=", ">="))
    t = hash_join(low, high, "id", "id", "shuffle_hash")
    assert joined_fields(low, high)[3:] == ["people.id (2)", "people.first (2)", "people.last (2)"]
    assert len(rows(t)) == 4 and t.df.select(column("people.id")).distinct().collect()[0][0] == 2


def test_unknown_columns_raise(people):
    with pytest.raises(KeyError):
        sort(people, "people.id")
    with pytest.raises(AnalysisException):
        people.df.select("people.id").collect()
