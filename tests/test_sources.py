import pytest

from tesserae.plans.data import Direction, ExprData
from tesserae.sources.annotations import check_license, download_resource, network, panglaodb_network, reshape
from tesserae.sources.csv import frame_from_csv_bytes, read_csv
from tesserae.sources.h5ad import FileScope, read_h5ad, read_h5ad_memory
from tesserae.streaming.totals import running_totals
from tests.fixtures import container


def test_csv(spark, tmp_path):
    text = 'name\tn\tshare\n"a\tb"\t1\t0.5\nNA\tNA\t2\nc\t3\tNA\n'
    path = tmp_path / "t.tsv"
    path.write_text(text)
    want = [("a\tb", 1, 0.5), (None, None, 2.0), ("c", 3, None)]
    assert [tuple(r) for r in read_csv(spark, str(path), "\t").collect()] == want
    assert [tuple(r) for r in frame_from_csv_bytes(spark, text.encode(), "\t").collect()] == want
    assert frame_from_csv_bytes(spark, b"1,x\n2,y\n", has_header=False).columns == ["_c0", "_c1"]
    with pytest.raises(ValueError):
        frame_from_csv_bytes(spark, b"")


def test_download(tmp_path):
    path = tmp_path / "body"
    path.write_bytes(b"x")
    assert download_resource(path.as_uri()) == b"x"
    assert check_license("Academic") == "academic"
    with pytest.raises(ValueError):
        check_license("other")


def test_annotations(spark):
    rows = spark.createDataFrame([("G1", 1, "cell_type", "B", 0), ("G1", 1, "organ", "spleen", 0), ("G2", 2, "cell_type", "B", 0), ("G3", 3, "organ", "liver", 0)], "genesymbol string, record_id int, label string, value string, other int")
    wide = reshape(rows)
    assert wide.columns == ["genesymbol", "cell_type", "organ"]
    assert reshape(rows, "9606").count() == 3
    edges = network(wide)
    assert sorted(tuple(r) for r in edges.collect()) == [("B", "G1", 1.0), ("B", "G2", 1.0)]
    assert network(wide, tmin=3).count() == 0
    assert network(wide, features=spark.createDataFrame([("G2",)], "var_name string")).count() == 1


def test_container_round_trip(spark, tmp_path):
    data = container(spark, [[1.0, 0.0], [0.0, 2.0]])
    data.write(str(tmp_path / "m"))
    again = ExprData.read(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.x.collect())) == [(0, 0, 1.0), (1, 1, 2.0)]
    assert again.length(Direction.ROW) == 2 and again.persist().x.is_cached


def test_h5ad(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    path = str(tmp_path / "m.h5ad")
    with h5py.File(path, "w") as file:
        x = file.create_group("X")
        x["data"], x["indices"], x["indptr"] = [1.0, 2.0], [0, 1], [0, 1, 2]
        for axis in ("obs", "var"):
            group = file.create_group(axis)
            group.attrs["_index"] = "_index"
            group["_index"] = [b"a", b"b"]
    assert sorted(map(tuple, read_h5ad(spark, path, FileScope.READ).x.collect())) == [(0, 0, 1.0), (1, 1, 2.0)]
    assert read_h5ad_memory(spark, path).obs.count() == 2


def test_running_totals(spark, tmp_path):
    source = str(tmp_path / "in")
    container(spark, [[1.0, 0.0], [3.0, 2.0]]).x.write.parquet(source)
    stream = spark.readStream.schema("obs_id long, var_id long, value double").parquet(source)
    query = running_totals(stream, Direction.ROW).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("totals").collect())) == [(0, 1, 1.0), (1, 2, 5.0)]


def test_csv_bytes_are_typed_by_spark(spark):
    """Digits with an underscore are text, as are words that Python takes for numbers; large integers and quotes stay whole."""
    rows = frame_from_csv_bytes(spark, b'a,b,c,d\n1_0,nan,99999999999999999999,"x ""y"""\n2_3,inf,1,"two\nlines"\n')
    assert [tuple(r)[:2] for r in rows.collect()] == [("1_0", "nan"), ("2_3", "inf")]
    assert [str(r["c"]) for r in rows.collect()] == ["99999999999999999999", "1"] and [r["d"] for r in rows.collect()] == ['x "y"', "two\nlines"]


def test_panglaodb_in_one_call(spark, tmp_path):
    folder = tmp_path / "academic"
    folder.mkdir()
    lines = ["genesymbol\trecord_id\tlabel\tvalue", "G1\t1\tcell_type\tB", "G1\t1\tncbi_tax_id\t9606", "G2\t2\tcell_type\tB", "G2\t2\tncbi_tax_id\t10090", "G3\t3\tcell_type\tT", "G3\t3\tncbi_tax_id\t9606"]
    (folder / "panglaodb").write_text("\n".join(lines) + "\n")
    edges = panglaodb_network(spark, f"{tmp_path.as_uri()}/{{license}}/{{name}}", "Academic", "9606")
    assert sorted(tuple(r) for r in edges.collect()) == [("B", "G1", 1.0), ("T", "G3", 1.0)]


def test_csv_bytes_are_cut_at_line_ends_only(spark):
    text = 'a,b\r\nx\u2028y,1\nf\x0cg\x0bh\x85i,2\r"p\r\nq","3\n4"\r\n\n"r ""s"",\nt",5\n'
    rows = frame_from_csv_bytes(spark, text.encode()).collect()
    assert sorted(map(tuple, rows)) == sorted([("x\u2028y", "1"), ("f\x0cg\x0bh\x85i", "2"), ("p\r\nq", "3\n4"), ('r "s",\nt', "5")])
    assert [r[0] for r in frame_from_csv_bytes(spark, b"a\nx\n  \n\ny").collect()] == ["x", "  ", "y"]
    assert frame_from_csv_bytes(spark, b"a,b\n1,2\n3,4").dtypes == [("a", "int"), ("b", "int")]
