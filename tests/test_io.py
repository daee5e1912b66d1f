import pytest
from conftest import SF_SMALL
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from tillroll.operators import segments as SG
from tillroll.plans.stages import stage
from tillroll.session import scratch_path
from tillroll.sources import io
from tillroll.sources.fixture import raw_transactions
from tillroll.operators.cleaning import clean
from tillroll.plans.stages import identity
from tillroll.streaming.ingest import landed, start_landing


def _rows(df):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", ["data.xlsx", "data.xls", "data.json"])
def test_unsupported_extensions(spark, name):
    with pytest.raises(ValueError, match="spreadsheets|neither CSV"):
        io.read_transactions(spark, f"/nowhere/{name}")


def test_csv_round_trip(spark, tmp_path):
    raw = raw_transactions(spark, SF_SMALL, spaced_names=True)
    path = str(tmp_path / "raw.csv")
    io.write_csv(raw, path)
    back = io.read_transactions(spark, path, fmt="csv")
    assert back.count() == raw.count()
    assert back.where(F.col("Description") == "  ").count() == raw.where(F.col("Description") == "  ").count()
    assert dict(back.dtypes)["Customer ID"] == "double"


def test_tagged_parts(spark, tmp_path):
    raw = raw_transactions(spark, SF_SMALL)
    root = str(tmp_path / "sheets")
    for sheet in ("A", "B"):
        io.write_parquet(raw.where(F.col("SourceSheet") == sheet).drop("SourceSheet"), f"{root}/{sheet}")
    back = io.read_tagged_parts(spark, root).select(*raw.columns)
    assert _rows(back) == _rows(raw)


def test_stage_is_read_through(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "stage")
    assert stage(spark, path, build).count() == 5
    assert stage(spark, path, build).count() == 5
    assert len(calls) == 1


def test_model_persistence(spark, featured_small):
    _, _, model = SG.segment_customers(featured_small, 3)
    path = scratch_path(spark, "models", "kmeans-test")
    io.save_model(model, path)
    loaded = io.load_model(KMeansModel, path)
    assert [list(c) for c in loaded.clusterCenters()] == [list(c) for c in model.clusterCenters()]


def test_landing_keeps_every_line(spark, tmp_path):
    """Back-dated files lose nothing, and cleaning the landed table equals cleaning the files."""
    raw = raw_transactions(spark, SF_SMALL, spaced_names=True).drop("SourceSheet")
    src, sink = str(tmp_path / "incoming"), str(tmp_path / "sink")
    late = F.col("InvoiceDate") > F.lit("1995-01-01").cast("timestamp_ntz")
    for part in (raw.where(late), raw.where(~late | F.col("InvoiceDate").isNull())):
        io.write_csv(part, str(tmp_path / "out"))
        (tmp_path / "incoming").mkdir(exist_ok=True)
        for f in (tmp_path / "out").glob("part-*.csv"):
            (tmp_path / "incoming" / f.name).write_bytes(f.read_bytes())
        start_landing(spark, src, sink, str(tmp_path / "ckpt")).awaitTermination(300)
    back = landed(spark, sink)
    assert back.count() == raw.count()
    assert _rows(clean(back)) == _rows(clean(io.read_csv(spark, src, encoding="UTF-8")))


FIELDS = ['BOX "LARGE", RED', "two\nlines", "back\\slash", "£5 café", '"', "", "  kept  "]


def test_csv_dialect(spark, tmp_path):
    """Quotes, commas, line feeds, backslashes, accents and outer blanks survive writing and reading, in the common dialect."""
    import csv
    rows = [(str(i), f, i) for i, f in enumerate(FIELDS)]
    io.write_csv(spark.createDataFrame(rows, "Invoice string, Description string, Quantity int").coalesce(1), str(tmp_path / "w"))
    text = next((tmp_path / "w").glob("part-*.csv")).read_text(encoding="utf-8")
    assert [r[1] for r in csv.reader(text.splitlines(keepends=True))][1:] == FIELDS
    with open(tmp_path / "own.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([["Invoice", "Description", "Quantity"], *rows])
    for path in ("w", "own.csv"):
        back = io.read_csv(spark, str(tmp_path / path), encoding="UTF-8").orderBy("Invoice").collect()
        assert [(r.Invoice, r.Description or "", r.Quantity) for r in back] == [(i, f, float(q)) for i, f, q in rows]


def test_parts_by_name(spark, tmp_path):
    """Part names with blanks and dots, a root whose name occurs twice, columns in another order or missing."""
    root = tmp_path / "y" / "data" / "y"
    root.mkdir(parents=True)
    (root / "Year 2009-2010.csv").write_text('Invoice,StockCode,Quantity\n1,a,"5"\n')
    (root / "v1.2").mkdir()
    (root / "v1.2" / "p.csv").write_text("StockCode,Invoice,Country\nb,2,France\n")
    got = {tuple(r) for r in io.read_tagged_parts(spark, str(root), fmt="csv").select("Invoice", "StockCode", "Quantity", "Country", "SourceSheet").collect()}
    assert got == {("1", "a", 5.0, None, "Year 2009-2010"), ("2", "b", None, "France", "v1.2")}
    (tmp_path / "void").mkdir()
    with pytest.raises(ValueError, match="no parts"):
        io.read_tagged_parts(spark, str(tmp_path / "void"))


def test_stage_identity_follows_the_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    a = identity(spark, spark.read.parquet(path))
    assert a == identity(spark, spark.read.parquet(path))
    spark.range(6).write.mode("overwrite").parquet(path)
    b = spark.read.parquet(path)
    assert a != identity(spark, b) and identity(spark, b) != identity(spark, b.where("id > 2"))
    assert identity(spark, spark.createDataFrame([(1,)], "x int")) != identity(spark, spark.createDataFrame([(2,)], "x int"))


def test_scan_csv_parses_its_file_into_a_stage(spark):
    import os

    from tillroll.plans import q_io
    from tillroll.session import scratch_path
    folder = scratch_path(spark, "io").replace("file:", "")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert q_io.q_scan_csv(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before if not n.endswith("-precap")) == ["csv-rows", "raw-csv"]
