import pytest
from pyspark.sql import functions as F

from korrel.schema import FLOAT64, INT32, STRING, Table, schema
from korrel.sources import HeapFile, Index, csv_scan, memory_scan, parquet_scan
from korrel.sources.heap import RecordID
from korrel.streaming import spill

FILMS = schema(("title", STRING), ("rating", FLOAT64), ("views", INT32))


def write(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    return str(path)


def scan(spark, tmp_path, text, **options):
    return csv_scan(spark, write(tmp_path, text), "films", FILMS, **options).df


GOOD = "title,rating,views\nIt's: \"here\",4.5,3\n\"a, \"\"b\"\"\nc\",1e3,-2\n,0.0,0\n\n spaced ,NaN,7\n"


def test_csv_rows(spark, tmp_path):
    got = [tuple(r) for r in scan(spark, tmp_path, GOOD).collect()]
    assert got[1] == ('a, "b"\nc', 1000.0, -2) and got[2] == ("", 0.0, 0) and got[3][0] == " spaced " and len(got) == 4


def test_csv_windows_line_ends(spark, tmp_path):
    assert [tuple(r) for r in scan(spark, tmp_path, "title,rating,views\r\na,1.5,2\r\n").collect()] == [("a", 1.5, 2)]


@pytest.mark.parametrize("header", ["", "title,rating", "title,rating,views,more", "rating,title,views", "Title,rating,views", "title,rating,view"])
def test_csv_headers(spark, tmp_path, header):
    with pytest.raises(ValueError):
        scan(spark, tmp_path, header + "\na,1.0,2\n" if header else "")


@pytest.mark.parametrize("line", ["a,x,1", "a,1.0,1.5", "a,1.0,3000000000", "a,1.0, 1", "a,1.0,", "a,,1", "a,1.0", "a,1.0,1,2"])
@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_bad_cells(spark, tmp_path, line, multi_line):
    df = scan(spark, tmp_path, f"title,rating,views\nok,1.0,1\n{line}\n", multi_line=multi_line)
    with pytest.raises(Exception):
        df.collect()
    if line not in ("a,1.0", "a,1.0,1,2"):
        with pytest.raises(Exception):
            df.select("title").collect()
        with pytest.raises(Exception):
            df.count()


def test_csv_line_breaks_are_looked_for(spark, tmp_path):
    long = "title,rating,views\n" + "".join(f'"t ""{i}""",{i}.5,{i}\n' for i in range(2000))
    for text, n in ((long, 2000), (long + '"a\nb",1.0,1\n', 2001)):
        got = scan(spark, tmp_path, text)
        assert got.count() == n
    assert got.filter("title = 'a\nb'").count() == 1


def test_spill_files(spark, tmp_path):
    rows = [(f"t{i}" * 200, float(i), i) for i in range(10)]
    t = memory_scan(spark, "films", FILMS, rows)
    spill.write(t, f"{tmp_path}/s")
    assert sorted(tuple(r) for r in spill.scan(spark, f"{tmp_path}/s", "films").df.collect()) == sorted(rows)
    with pytest.raises(Exception):
        spill.write(t, f"{tmp_path}/s")
    spill.write_partitioned(t, f"{tmp_path}/p", F.col("views") % 3, 3)
    for i in range(3):
        assert sorted(r.views for r in spill.scan_partition(spark, f"{tmp_path}/p", "films", i).df.collect()) == list(range(i, 10, 3))
    with pytest.raises(Exception):
        spill.write_partitioned(t, f"{tmp_path}/q", F.col("views"), 3)
    with pytest.raises(Exception):
        parquet_scan(spark, f"{tmp_path}/none", "x")


@pytest.fixture
def heap(spark, tmp_path):
    data = [(f"t{i % 4}", i / 2, i // 2) for i in range(50)] + [("last", 1.0, 7), ("", 0.0, 7)]
    return HeapFile.bulk_load(spark, f"{tmp_path}/heap", memory_scan(spark, "films", FILMS, data).df.repartition(3))


def test_heap_create_and_open(spark, tmp_path):
    heap = HeapFile.create(spark, f"{tmp_path}/h", FILMS)
    assert heap.scan("films").df.count() == 0
    with pytest.raises(Exception):
        HeapFile.create(spark, f"{tmp_path}/h", FILMS)
    with pytest.raises(Exception):
        HeapFile(spark, f"{tmp_path}/none")


def test_heap_records(spark, heap):
    found = heap.scan_with_ids().collect()
    ids = {RecordID(*r.id): tuple(r.record) for r in found}
    assert len(ids) == 52 == heap.scan("films").df.count()
    some = list(ids)[3:13]
    for i in some:
        assert tuple(heap.get(i)) == ids[i]
        heap.delete(i)
    heap.delete(some[0])
    assert heap.get(some[0]) is None
    left = {RecordID(*r.id): tuple(r.record) for r in heap.scan_with_ids().collect()}
    assert left == {i: r for i, r in ids.items() if i not in some}
    new = [RecordID(*r) for r in heap.insert(memory_scan(spark, "f", FILMS, [("new", 9.0, 99)]).df).collect()]
    assert len(new) == 1 and tuple(heap.get(new[0])) == ("new", 9.0, 99)
    assert heap.scan("films").df.filter("views = 99").count() == 1 and heap.scan("films").df.count() == 43
    for bad in (RecordID(some[0].file, 10**6), RecordID("part-none.parquet", 0)):
        with pytest.raises(Exception):
            heap.get(bad)
        with pytest.raises(Exception):
            heap.delete(bad)
    with pytest.raises(TypeError):
        heap.insert(spark.createDataFrame([(1,)], "x int"))
    assert HeapFile(spark, heap.path).scan("films").df.count() == 43


def test_heap_insert_gives_ids(spark, heap):
    data = [(f"n{i}", float(i), 1000 + i) for i in range(40)]
    ids = heap.insert(memory_scan(spark, "f", FILMS, data).df.repartition(5))
    found = [RecordID(*r) for r in ids.collect()]
    assert len(set(found)) == 40 and sorted(tuple(heap.get(i)) for i in found[:5])[0][2] >= 1000
    before = heap.scan("films").df.count()
    heap.delete_all(ids)
    assert heap.scan("films").df.count() == before - 40
    one = heap.insert_one(("one", 1.0, 5000))
    assert tuple(heap.get(one)) == ("one", 1.0, 5000)
    heap.delete(one)
    assert heap.get(one) is None and heap.scan("films").df.count() == before - 40
    assert heap.insert(spark.createDataFrame([], FILMS)).count() == 0


@pytest.mark.parametrize("factor", [1.0, 0.7, 0.3])
def test_index_entries(spark, tmp_path, factor):
    entries = spark.createDataFrame([(5 * k, f"f{j}", j) for k in range(100) for j in range(10)], "key long, file string, row long")
    index = Index.bulk_load(spark, f"{tmp_path}/i", entries, factor)
    assert index.find_equal(250).count() == 10 and index.find_equal(251).count() == 0
    keys = [r.key for r in index.find_greater_equal(250).collect()]
    assert keys == sorted(keys) and len(keys) == 500 and index.find_greater_equal(10**6).count() == 0
    index.add(spark.createDataFrame([(251, "f", 1), (250, "f", 1)], "key long, file string, row long"))
    assert index.find_equal(251).count() == 1 and Index(spark, f"{tmp_path}/i").find_equal(250).count() == 11


def test_index_checks(spark, tmp_path, heap):
    none = spark.createDataFrame([], "key long, file string, row long")
    one = spark.createDataFrame([(1, "f", 1)], "key long, file string, row long")
    for entries, factor in ((none, 1.0), (one, 0.0), (one, 1.1)):
        with pytest.raises(ValueError):
            Index.bulk_load(spark, f"{tmp_path}/x", entries, factor)
    with pytest.raises(Exception):
        Index(spark, f"{tmp_path}/none")
    with pytest.raises(TypeError):
        Index.build(f"{tmp_path}/x", heap, "rating")
    empty = Index.create(spark, f"{tmp_path}/e")
    assert empty.find_equal(1).count() == 0 and empty.scan_equal(heap, "films", 1).df.count() == 0
    with pytest.raises(Exception):
        Index.create(spark, f"{tmp_path}/e")


def test_index_scans_and_tombstones(spark, tmp_path, heap):
    index = Index.build(f"{tmp_path}/views", heap, "views")
    full = heap.scan("films").df
    for key in (0, 7, 24, 99):
        assert sorted(index.scan_equal(heap, "films", key).df.collect()) == sorted(full.filter(F.col("views") == key).collect())
    got = [r.views for r in index.scan_greater_equal(heap, "films", 10).df.collect()]
    assert got == sorted(got) and len(got) == full.filter("views >= 10").count()
    heap.delete_all(heap.scan_with_ids().filter("record.views = 7 and record.title = 'last'").select("id.*"))
    left = index.scan_equal(heap, "films", 7)
    assert isinstance(left, Table) and sorted(r.title for r in left.df.collect()) == ["", "t2", "t3"]
