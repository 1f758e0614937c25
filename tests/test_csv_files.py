import glob

from workload import queries as Q


def test_csv_files_hold_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "_FILE_ROWS", 100, raising=False)
    few, many = (Q._csv(spark.range(n).toDF("id"), str(tmp_path / str(n))) for n in (30, 2000))
    assert len(glob.glob(f"{few}/*.csv")) == 3 and spark.read.option("header", True).csv(few).count() == 30
    assert len(glob.glob(f"{many}/*.csv")) == 20
    assert sorted(int(r.id) for r in spark.read.option("header", True).csv(many).collect()) == list(range(2000))
