import os

from retentio.sources import customers as C
from retentio.sources import sinks as K


def test_csv_na_tokens_and_bad_text(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("CustomerID,Tenure,Gender,Extra\nA,12,Male,x\nB,NA,,y\nC,abc,N/A,z\n")
    df = C.read_customers_csv(spark, str(p))
    rows = {r["CustomerID"]: r for r in df.collect()}
    assert rows["A"]["Tenure"] == 12.0 and rows["B"]["Tenure"] is None and rows["C"]["Tenure"] is None
    assert rows["B"]["Gender"] is None and rows["C"]["Gender"] is None
    assert "Extra" in df.columns


def test_guards():
    import pytest
    with pytest.raises(C.InputError):
        C.check_csv_path(None)
    with pytest.raises(C.InputError):
        C.check_csv_path("")
    with pytest.raises(C.InputError):
        C.check_csv_path("/tmp/data.txt")
    assert C.check_csv_path("/tmp/DATA.CSV")


def test_demo_is_seeded(spark):
    a = C.demo_customers(spark, 100, 42).collect()
    b = C.demo_customers(spark, 100, 42).collect()
    assert a == b and len(a) == 100
    assert all(1 <= r["Tenure"] < 36 and r["Complain"] in (0, 1) for r in a)


def test_report_and_exports(spark, tmp_path):
    from retentio.plans.batch import clean_customers, score_customers
    demo = C.demo_customers(spark, 60)
    cl, st = clean_customers(demo)
    s = score_customers(cl, st)
    base = K.write_full_report(s, str(tmp_path), stamp="t")
    parts = K.read_full_report(spark, base)
    cust = parts["customers"]
    assert cust.count() == 60 and cust.columns[0] == "Customer_ID" and cust.columns[-1] == "Retention_Recommendation"
    assert parts["summary"].count() == 8 and parts["metadata"].count() == 6
    exp = K.write_risk_exports(s, str(tmp_path), stamp="t")
    assert spark.read.option("header", True).csv(exp).count() == 60
    K.write_records_json(s, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 60
    K.write_text_reports(s.withColumn("CustomerID", s["Tenure"].cast("string")), str(tmp_path / "txt"), "now")


def test_report_is_read_whole_or_not_at_all(spark, tmp_path):
    import pytest
    from retentio.plans.batch import clean_customers, score_customers
    cl, st = clean_customers(C.demo_customers(spark, 40))
    s = score_customers(cl, st)
    with pytest.raises(K.IncompleteReport, match="no manifest"):
        K.read_full_report(spark, str(tmp_path / "none"))
    base = K.write_full_report(s, str(tmp_path), stamp="t")
    first = spark.read.schema(K.MANIFEST).json(os.path.join(base, "manifest")).first()["run"]
    s.limit(3).write.mode("append").option("header", True).csv(os.path.join(base, first, "customers"))
    with pytest.raises(K.IncompleteReport, match="40 rows"):
        K.read_full_report(spark, base)
    again = K.write_full_report(s.limit(10), str(tmp_path), stamp="t")      # a later run replaces it as a whole
    assert again == base and K.read_full_report(spark, base)["customers"].count() == 10


def test_lines_that_do_not_parse_are_kept_with_their_reason(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"CustomerID":"1","Tenure":3.0}\n{"CustomerID":"2","Tenure":"long"}\n{"CustomerID":"3",\n{"Tenure":1.0}\n')
    rows = {r["reason"]: r for r in C.rescued_records(spark, str(tmp_path / "j")).collect()}
    assert set(rows) == {None, "field of another type", "no record", "no id"}
    assert rows["no record"]["line"] == '{"CustomerID":"3",' and rows[None]["Tenure"] == 3.0 and rows[None]["line"] is None
    C.quarantine(C.rescued_records(spark, str(tmp_path / "j")), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    bad = spark.read.json(str(tmp_path / "bad"))
    assert bad.count() == 3 and set(bad.columns) == {"reason", "line"}
