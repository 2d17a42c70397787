import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.parse import column_is_day_first, to_date_iso
from vigil.operators.features import add_features
from vigil.operators.grid import consolidate_sheets
from vigil.plans.panel import write_panel

NAMES = ["a", "b"]
SCHEMA = "series_id int, date date, a double, b double"


def panel_rows(n=80, seed=1):
    rng = np.random.default_rng(seed)
    return [(s, dt.date(2024, 1, 1) + dt.timedelta(days=int(i)), None if rng.random() < 0.1 else float(rng.normal()), float(i))
            for s in (1, 2, 3) for i in sorted(rng.choice(120, n, replace=False))]


def as_rows(df):
    order = sorted(df.columns)
    return sorted([tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*order).collect()], key=repr)


def batch_features(spark, rows):
    return add_features(spark.createDataFrame(rows, SCHEMA), ["series_id"], NAMES, with_categories=False)


def test_streamed_features_equal_the_batch_and_survive_a_restart(spark):
    from vigil.streaming.features import feature_stream
    rows, base = panel_rows(), tempfile.mkdtemp(prefix="vigil-stream-")
    parts = [[r for r in rows if i * 30 <= (r[1] - dt.date(2024, 1, 1)).days < (i + 1) * 30] for i in range(4)]
    schema = spark.createDataFrame(rows[:1], SCHEMA).schema

    def arrive(i):
        spark.createDataFrame(parts[i], SCHEMA).orderBy(F.rand(3)).coalesce(1).write.parquet(f"{base}/in/{i}")

    def run():
        feature_stream(spark, base + "/in", schema, ["series_id"], base + "/sink", base + "/state", NAMES).awaitTermination()

    arrive(0)
    arrive(1)
    run()
    assert spark.read.parquet(base + "/sink").count() == len(parts[0]) + len(parts[1])
    arrive(2)
    arrive(3)
    run()           # a new query on the same checkpoint: the state goes on
    got = spark.read.parquet(base + "/sink")
    want = batch_features(spark, rows)
    assert got.columns == want.columns and as_rows(got) == as_rows(want)
    # late and repeated days are left out
    spark.createDataFrame(parts[1][:5], SCHEMA).coalesce(1).write.parquet(f"{base}/in/9")
    run()
    assert spark.read.parquet(base + "/sink").count() == len(rows)


def test_a_period_arrives_in_several_files_each_series_in_one(spark, monkeypatch):
    from vigil.plans import job_queries
    from vigil.streaming.features import feature_stream
    base = tempfile.mkdtemp(prefix="vigil-arrive-")
    spark.createDataFrame(panel_rows(), SCHEMA).write.parquet(base + "/panel")
    panel = spark.read.parquet(base + "/panel")
    monkeypatch.setattr(job_queries, "STREAM_FILE_BYTES", 64)
    files = job_queries.arriving_files(spark, panel, base + "/in")
    path = F.input_file_name()
    found = (spark.read.option("recursiveFileLookup", "true").parquet(base + "/in").select("series_id", path.alias("file"), F.regexp_extract(path, "/in/([0-9]+)/", 1).alias("period"))
             .groupBy("period", "series_id").agg(F.count_distinct("file").alias("files"), F.min("file").alias("file")).collect())
    assert files > 3 and {r.files for r in found} == {1} and len({r.file for r in found}) > 3
    # two files a batch: batches and periods do not end together
    feature_stream(spark, base + "/in", panel.schema, ["series_id"], base + "/sink", base + "/state", NAMES, max_files_per_trigger=2).awaitTermination()
    assert as_rows(spark.read.parquet(base + "/sink")) == as_rows(batch_features(spark, panel_rows()))


def test_a_series_leaves_the_state_as_one_row_a_batch(spark):
    from vigil.streaming.features import with_history
    rows = spark.readStream.schema("series_id int, date date, a double").parquet(tempfile.mkdtemp(prefix="vigil-rows-"))
    out = with_history(rows, ["series_id"], ["a"], depth=3)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Generate inline" in plan and [f.simpleString() for f in out.schema] == ["series_id:int", "date:date", "a:double", "_a_history:array<double>"]


def test_features_of_a_bucketed_panel_need_no_exchange(spark):
    rows = panel_rows()
    table = write_panel(spark.createDataFrame(rows, SCHEMA), ["series_id"], "bucketed_panel_test", tempfile.mkdtemp(prefix="vigil-panel-"), 4)
    out = add_features(table, ["series_id"], NAMES, with_categories=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert as_rows(out) == as_rows(batch_features(spark, rows))
    spark.sql("DROP TABLE bucketed_panel_test")


def test_a_failed_write_leaves_the_model_before(spark):
    from vigil.operators.models import LogitModel
    from vigil.operators.prep import Prepared
    from vigil.plans import artefacts
    path = tempfile.mkdtemp(prefix="vigil-model-") + "/model"
    model = lambda b: LogitModel(Prepared(["x"], [], {"x": 0.0}, {"x": 0.0}, {"x": 1.0}), [b], 0.0)
    with pytest.raises(FileNotFoundError):
        artefacts.load_model(spark, path)
    artefacts.save_model(spark, model(1.0), path, dict(threshold=0.25))

    def half(folder):
        artefacts.write_json(spark, f"{folder}/model", {"name": "broken"})
        raise OSError("lost")

    with pytest.raises(OSError):
        artefacts.publish(spark, path, half)
    assert artefacts.load_model(spark, path).coefficients == [1.0] and artefacts.load_threshold(spark, path) == 0.25
    artefacts.save_model(spark, model(2.0), path, dict(threshold=0.5))
    assert artefacts.load_model(spark, path).coefficients == [2.0] and artefacts.load_threshold(spark, path) == 0.5
    assert artefacts.current_version(spark, path)[0] == 2


def test_sheets_are_chosen_in_the_scan(spark):
    folder = tempfile.mkdtemp(prefix="vigil-sheets-")
    sheet = "Titulo;;\n;;\nFECHA;2021-12-01;42005\nTotal demanda;5;-\nCirugías de urgencia;1,5;7\n"
    for name, text in (("ER_2021.xlsx", sheet), ("~$ER_2021.xlsx", sheet.replace("5", "9")), ("total_er.xlsx", sheet),
                       ("ER_2019.XLSX", sheet.replace("Total demanda", "nada")), ("notes.txt", sheet)):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    sink = tempfile.mkdtemp(prefix="vigil-er-") + "/er"
    got = consolidate_sheets(spark, folder, sink).collect()
    assert [(r.FECHA, r.TOTAL_DEMANDA, r.CIRUGIAS_URGENCIA, r.source_file) for r in got] == [
        (dt.date(2015, 1, 1), None, 7.0, "ER_2021.xlsx"), (dt.date(2021, 12, 1), 5.0, 1.5, "ER_2021.xlsx")]
    assert [tuple(r) for r in spark.read.parquet(sink + "_rejected").collect()] == [("ER_2019.XLSX", "no anchor row")]
    with pytest.raises(FileNotFoundError):
        consolidate_sheets(spark, tempfile.mkdtemp(prefix="vigil-none-"), sink)


def test_one_order_per_column(spark):
    df = spark.createDataFrame([("m", "01/02/2019"), ("m", "03/25/2019"), ("d", "01/02/2019"), ("d", "13/02/2019"), ("d", "02/13/2019"),
                                ("d", "14/02/2019"), ("d", "2019-02-03"), ("tie", "01/02/2019"), ("tie", None)], "g string, txt string")
    order = df.groupBy("g").agg(column_is_day_first("txt").alias("day_first"))
    got = {(r.g, r.txt): r.d for r in df.join(order, "g").select(
        "g", "txt", to_date_iso("txt", day_first=F.col("day_first")).alias("d")).collect()}
    assert got == {("m", "01/02/2019"): dt.date(2019, 1, 2), ("m", "03/25/2019"): dt.date(2019, 3, 25),
                   ("d", "01/02/2019"): dt.date(2019, 2, 1), ("d", "13/02/2019"): dt.date(2019, 2, 13), ("d", "02/13/2019"): None,
                   ("d", "14/02/2019"): dt.date(2019, 2, 14), ("d", "2019-02-03"): dt.date(2019, 2, 3),
                   ("tie", "01/02/2019"): dt.date(2019, 1, 2), ("tie", None): None}
