"""Archives, workbooks, gates and small orders, on files and fixtures made here."""

import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import etl, metrics
from tidemark.sources import archive, readers, workbook, writers


# --- archives ----------------------------------------------------------------------------------------------


def packed(items):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, content in items:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def items():
    rng = random.Random(1)
    names = ["tensor_index.csv", *(f"tensors/seg_{i:04}.npy" for i in range(57)), "deep/" + "x" * 130 + "/long.npy", "ünicode ñ.npy", "empty"]
    return [(n, b"" if n == "empty" else rng.randbytes(rng.choice([0, 1, 511, 512, 513, 4000]))) for n in names]


@pytest.mark.parametrize("members", [4096, 7, 1])
@pytest.mark.parametrize("from_files", [False, True])
def test_archive_equals_that_of_tarfile(spark, tmp_path, monkeypatch, members, from_files):
    monkeypatch.setattr(archive, "MEMBERS", members)
    rows, own = items(), []
    for i, (name, content) in enumerate(rows):
        (tmp_path / f"m{i}").write_bytes(content)
        own.append((i, name, len(content), f"file:{tmp_path}/m{i}" if from_files else content))
    df = spark.createDataFrame(own, f"place long, name string, length long, {'path string' if from_files else 'content binary'}").repartition(3)
    manifest = archive.write_archive(df, f"{tmp_path}/out.tar").cache()
    raw = (tmp_path / "out.tar").read_bytes()
    assert raw == packed(rows)
    assert {r.archive_sha256 for r in manifest.collect()} == {hashlib.sha256(raw).hexdigest()}
    assert {r.name: bytes(r.content) for r in archive.read_members(manifest, f"{tmp_path}/out.tar").collect()} == dict(rows)
    names = archive.archive_names(spark, f"{tmp_path}/out.tar")
    assert sorted(r.path for r in names.collect()) == sorted(n for n, _ in rows)
    index = spark.createDataFrame([(n,) for n, _ in rows[1:]], "path string")
    assert etl.archive_gate(index, names).first().ok and not etl.archive_gate(index.limit(5), names).first().ok
    assert not (tmp_path / "out.tar.parts").exists()


def test_archive_refuses_repeated_and_false_members(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1, b"x"), (1, "a", 1, b"y")], "place long, name string, length long, content binary")
    with pytest.raises(ValueError, match="repeated"):
        archive.write_archive(df, f"{tmp_path}/a.tar")
    with pytest.raises(Exception, match="has 1 bytes, not 2"):
        archive.write_archive(df.where("place = 0").withColumn("length", F.lit(2).cast("long")), f"{tmp_path}/b.tar")
    none = archive.write_archive(df.limit(0), f"{tmp_path}/c.tar")
    assert none.count() == 0 and (tmp_path / "c.tar").read_bytes() == packed([])


# --- workbooks ---------------------------------------------------------------------------------------------

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def xlsx(path, sheets):
    """Sheets of rows; a str is a shared string, a (str,) an inline one, None a gap."""
    shared, names = [], list(sheets)

    def cell(r, c, v):
        at = (chr(64 + c // 26) if c >= 26 else "") + chr(65 + c % 26) + str(r)
        if isinstance(v, tuple):
            return f'<c r="{at}" t="inlineStr"><is><t>{v[0]}</t></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, n in enumerate(names):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(sheets[n], 1) if row is not None)
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        rel = "".join(f'<Relationship Id="rId{i + 1}" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        half = lambda s: f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>hint</t></rPh></si>" if len(s) > 5 else f"<si><t>{s}</t></si>"
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(map(half, shared)) + "</sst>")


@pytest.fixture(scope="module")
def book(tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('book')}/iara.xlsx"
    wide = [None] * 27 + ["far"]
    xlsx(path, {
        "ship_recordings": [[" Ship ID ", "Qty recordings", "With CPA", "on Both"], [11, 3, 0, 1], None, [12, "n/a", 2, None], [None, None], [("13",), None, ("many",), 0], wide],
        "ship_info": [["Ship ID", "AIS TYPE SUMMARY"], [11, "Tanker"], ["13", ("Cargo",)]],
        "dataset_info": [["IARA ID", "Rain state", "Rain", "Wind", "Sea state"], [25, None, 0.4, "calm", 1], [26, " Very Heavy", None, ("storm",), 6], [27, "?", "x", None, None]],
    })
    return path


def test_a_partition_a_sheet(spark, book):
    workbook.register(spark)
    rows = spark.read.format("workbook").load(book)
    assert rows.rdd.getNumPartitions() == 3
    got = [(r.sheet, r.row, r.cells) for r in rows.where("sheet = 'ship_recordings'").orderBy("row").collect()]
    assert got[1] == ("ship_recordings", 2, ["11", "3", "0", "1"]) and got[2] == ("ship_recordings", 4, ["12", "n/a", "2"])
    assert got[-1][2][27] == "far" and got[-1][2][:27] == [None] * 27
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").option("sheet", "other").load(book).collect()


def test_workbook_reaches_vessels_and_weather(spark, book):
    sheet = workbook.read_sheet(spark, book, "ship_recordings").where("`Ship ID` IS NOT NULL")
    h = {r.vessel_id: (r.type, r.n_recordings, r.has_cpa, r.on_both_hardware) for r in etl.hulls_of_workbook(sheet, workbook.read_sheet(spark, book, "ship_info")).collect()}
    assert h == {"IARA:11": ("Tanker", 3, False, True), "IARA:12": ("Unknown", 0, True, False), "IARA:13": ("Cargo", 0, False, False)}
    recordings = spark.createDataFrame([(25,), (26,), (27,), (28,)], "recording_id long")
    w = {r.recording_id: (r.rain, r.wind, r.sea_state) for r in etl.with_weather(recordings, workbook.read_sheet(spark, book, "dataset_info")).collect()}
    assert w == {25: ("light", "calm", "1"), 26: ("very_heavy", "storm", "6"), 27: ("unknown", None, None), 28: (None, None, None)}


# --- gates -------------------------------------------------------------------------------------------------


def test_gates_stop_a_run(spark, tmp_path):
    df = spark.createDataFrame([("a", "tpsw", [1.0, 2.0]), ("b", "median", [1.0])], "k string, made_by string, v array<double>")
    ok = df.where("k = 'a'")
    assert ok.select(etl.equal_or_error(F.col("made_by"), "tpsw", "normaliser").alias("x")).first().x == "tpsw"
    for c, what in ((F.col("made_by"), "normaliser: median"), (F.when(F.col("k") == "a", "tpsw"), "normaliser: null")):
        with pytest.raises(Exception, match=what):
            df.select(etl.equal_or_error(c, "tpsw", "normaliser")).collect()
    assert etl.shape_gate(ok, "v", 2).first().n_values == 2
    with pytest.raises(Exception, match="values of an array: 1"):
        etl.shape_gate(df, "v", 2).collect()
    with pytest.raises(Exception, match="type of an array: float64"):
        etl.shape_gate(ok.withColumn("dtype", F.lit("float64")), "v", 2, "float32").collect()
    one = spark.createDataFrame([("x", 0.5)], "k string, r double")
    assert etl.stored_gate(one, one.withColumn("r", F.lit(0.5004)), "k", "r").first().computed == 0.5
    for other in (one.withColumn("r", F.lit(0.52)), one.withColumn("k", F.lit("y"))):
        with pytest.raises(Exception, match="is not the stored one"):
            etl.stored_gate(one, other, "k", "r").collect()


def test_counts_are_checked_before_a_table_is_there(spark, tmp_path):
    df = spark.range(10)
    kept = etl.write_counted(df, f"{tmp_path}/t", {"n": (F.count("*"), 10), "top": (F.max("id"), 9)})
    assert kept.count() == 10
    with pytest.raises(ValueError, match="n is 7, not 10"):
        etl.write_counted(df.limit(7), f"{tmp_path}/u", {"n": (F.count("*"), 10), "low": (F.min("id"), 0)})
    assert not (tmp_path / "u").exists() and not (tmp_path / "u.unchecked").exists()
    assert etl.write_counted(df.limit(3), f"{tmp_path}/t", {"n": (F.count("*"), 3)}).count() == 3


def test_result_sets_are_aligned_or_an_error(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 6.0)], "q long, s double")
    b = a.withColumn("s", F.col("s") * 2)
    assert sorted((r.q, r.s_a, r.s_b) for r in etl.aligned(a, b, ["q"]).collect()) == [(1, 5.0, 10.0), (2, 6.0, 12.0)]
    for other in (b.where("q = 1"), b.unionByName(b.where("q = 2")), b.withColumn("q", F.col("q") + 1)):
        with pytest.raises(Exception, match="not once on both sides"):
            etl.aligned(a, other, ["q"]).count()


def test_places_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(9), rng.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, vessel int, session int, i int")
    got = {r.i: r.place for r in etl.places(df, "source", "vessel", "session", "i").collect()}
    assert got == {r[3]: n for n, r in enumerate(sorted(rows), 1)}
    assert sorted(r.place for r in etl.display_order(df).collect()) == list(range(1, 301))
    assert etl.places(df.limit(0), "i").collect() == []


# --- running totals in groups --------------------------------------------------------------------------------


def test_totals_of_a_group_with_most_values(spark):
    rng = random.Random(3)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["x", "y", None]), rng.random() < 0.3, round(rng.random() + 0.2 * (i % 3 == 0), 3)) for i in range(4000)] + [("alone", True, 0.5)]
    df = spark.createDataFrame(rows, "g string, genuine boolean, score double")
    ranges = metrics.running(metrics.counted(df, ["g"]), ["g"])
    assert ranges.count() == len({(g, s) for g, _, s in rows})
    auc = {r.g: r.auc for r in metrics.auc(df, ["g"]).collect()}
    eer = {r.g: r.eer for r in metrics.eer_sorted(df, ["g"]).collect()}
    assert set(auc) == {"big", "x", "y", None, "alone"} and auc["alone"] is None and set(eer) == {"big", "x", "y", None}
    for g in eer:
        own = df.where(F.col("g").eqNullSafe(g))
        assert auc[g] == pytest.approx(metrics.auc(own).first().auc) and eer[g] == pytest.approx(metrics.eer_sorted(own).first().eer)
        gen, imp = ([s for h, t, s in rows if h == g and t == k] for k in (True, False))
        assert auc[g] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in gen for b in imp) / len(gen) / len(imp))
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "_k" in plan.split("Window", 2)[1].split("\n")[0]  # the running total is inside a range of a group


# --- small readers and writers -----------------------------------------------------------------------------


def test_small_files(spark, tmp_path):
    (tmp_path / "d" / "p1").mkdir(parents=True)
    for name in ("s2.npy", "s1.npy", "s1__cat.npy", "s3__listen.npy"):
        (tmp_path / "d" / "p1" / name).write_bytes(b"x" * 3)
    files = readers.find_files(spark, f"{tmp_path}/d", "*.npy")
    assert {r.stem: r.length for r in files.collect()} == {"s1": 3, "s2": 3, "s1__cat": 3, "s3__listen": 3}
    assert [[p.rsplit("/", 1)[-1] for p in r.paths] for r in readers.passage_segments(files).collect()] == [["s1.npy", "s2.npy"]]
    digests = writers.file_digests(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/d"))
    assert {r.sha256 for r in digests.collect()} == {hashlib.sha256(b"xxx").hexdigest()}
    df = spark.createDataFrame([("A", "train", 1), ("B", "val", 2)], "source string, split string, n int")
    writers.write_json(df, f"{tmp_path}/j", normaliser="tpsw")
    got = spark.read.json(f"{tmp_path}/j").orderBy("n").collect()
    assert [(r.source, r.normaliser) for r in got] == [("A", "tpsw"), ("B", "tpsw")]
    (tmp_path / "one.json").write_text('{"model": "m",\n "rows": [{"a": 1}, {"a": 2}]}')
    assert [x.a for x in readers.read_json(spark, f"{tmp_path}/one.json").first().rows] == [1, 2]
    writers.write_csv(df, f"{tmp_path}/c")
    assert readers.read_csv(spark, f"{tmp_path}/c").count() == 2
    writers.write_segments(df, f"{tmp_path}/s")
    writers.write_segments(writers.only_new(df.withColumn("n", F.col("n") + 1), spark.read.parquet(f"{tmp_path}/s"), "n"), f"{tmp_path}/s")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [1, 2, 3]
    assert writers.markdown_table(df.orderBy("n")).count("\n") == 3
    with pytest.raises(ValueError, match="more than 1 rows"):
        writers.markdown_table(df, 1)
