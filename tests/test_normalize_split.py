"""Normalisation, sources and the distributed temporal split."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import normalize as nz
from ledgerlens.operators import split as sp
from ledgerlens.sources.files import read_csv_ledger
from ledgerlens.sources.jdbc import JdbcLedgerSource
from ledgerlens.sources.ledger import ledger_frame

RAW = "account_code string, description string, remarks string, reference string, " \
      "debit string, credit string, posting_date string"


def test_required_columns(spark):
    df = spark.createDataFrame([("1",)], "debit string")
    with pytest.raises(ValueError, match="a ledger needs the columns"):
        nz.prepare_ledger(df)


def test_coercion_and_target(spark):
    df = spark.createDataFrame([
        ("401ABC", "a", None, None, "12.5", "x", "2025-01-15"),
        ("627XYZ", None, "r", "REF1", "abc", " 3 ", "2025-13-99")], RAW)
    rows = nz.prepare_ledger(df, target_length=3).orderBy("target").collect()
    assert [r["target"] for r in rows] == ["401", "627"]
    assert (rows[0]["debit"], rows[0]["credit"]) == (12.5, 0.0)
    assert (rows[1]["debit"], rows[1]["credit"]) == (0.0, 3.0)
    assert rows[0]["posting_date"] == dt.datetime(2025, 1, 15) and rows[1]["posting_date"] is None
    assert rows[0]["remarks"] == "" and rows[1]["description"] == ""


def test_guards(spark):
    zero = spark.createDataFrame([("401", "a", "", "", "0", "0", "2025-01-01")], RAW)
    with pytest.raises(ValueError, match="has an amount"):
        nz.validate_ledger(nz.prepare_ledger(zero))
    rare = spark.createDataFrame([("401", "a", "", "", "1", "0", "2025-01-01")] * 3
                                 + [("402", "a", "", "", "1", "0", "2025-01-01")], RAW)
    kept = nz.prepare_ledger(rare, min_class_samples=2)
    assert {r["target"] for r in kept.collect()} == {"401"}
    with pytest.raises(ValueError, match="the ledger is empty"):
        nz.validate_ledger(nz.prepare_ledger(rare, min_class_samples=10))


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("account_code,description,remarks,reference,credit,debit,posting_date\n"
                    "401000,PRLV SEPA SAS DUPONT,,NULL,5000.00,1234.56,2025-01-15\n"
                    "411000,VIR,N/A,,0,10,2025-01-16\n")
    rows = read_csv_ledger(spark, str(path)).orderBy("target").collect()
    assert rows[0]["debit"] == 1234.56 and rows[0]["reference"] == ""
    assert rows[1]["remarks"] == ""
    with pytest.raises(FileNotFoundError):
        read_csv_ledger(spark, str(tmp_path / "missing.csv"))


def test_split_matches_reference_form(spark, sf_small):
    led = nz.prepare_ledger(ledger_frame(spark, sf_small))
    ref = {r["txn_id"]: r["part"] for r in sp.split_reference_form(led, 0.8).collect()}
    lab = sp.label_split(led, sp.find_boundary(led, 0.8))
    got = {r["txn_id"]: r["part"] for r in lab.collect()}
    assert got == ref


def test_split_hot_day_refinement(spark):
    # one day holds most rows; tiny leaf_rows forces bucket refinement on txn_id
    rows = [(i, dt.datetime(2024, 1, 1) if i % 10 else dt.datetime(2024, 1, 1 + i % 7 + 1))
            for i in range(5000)]
    df = spark.createDataFrame(rows, "txn_id long, posting_date timestamp")
    ref = {r["txn_id"]: r["part"] for r in sp.split_reference_form(df, 0.37).collect()}
    b = sp.find_boundary(df, 0.37, leaf_rows=50)
    got = {r["txn_id"]: r["part"] for r in sp.label_split(df, b).collect()}
    assert got == ref and b.n_train == int(5000 * 0.37)


def test_split_stats_sets(spark, sf_small):
    led = nz.prepare_ledger(ledger_frame(spark, sf_small))
    lab = sp.label_split(led, sp.find_boundary(led, 0.8))
    st = sp.split_stats(lab).first()
    shared = sp.classes_shared(lab).count()
    assert st["shared_classes"] == shared
    assert st["train_exclusive_classes"] == sp.classes_train_only(lab).count()
    assert st["val_exclusive_classes"] == sp.classes_val_only(lab).count()
    assert st["train_rows"] + st["val_rows"] == st["total_rows"]


def test_amount_text_must_be_a_number(spark):
    from ledgerlens.operators.normalize import coerce_amount
    given = ["1.5", " 12.5 ", "1e3", "-.5", "NaN", "Infinity", "12d", "12f", "abc", "", None, "+7.", "1,5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, a string")
    got = [r["v"] for r in df.select("i", coerce_amount(df, "a").alias("v")).orderBy("i").collect()]
    assert got == [1.5, 12.5, 1000.0, -0.5, 0, 0, 0, 0, 0, 0, 0, 7.0, 0]


def test_csv_without_key_goes_all_the_way(spark, tmp_path):
    """Seven columns, no key, equal rows: file to ranked codes."""
    from ledgerlens.operators import split as sp
    from ledgerlens.plans import learn
    from ledgerlens.sources.files import read_csv_ledger
    lines = ["account_code,description,reference,remarks,credit,debit,posting_date"]
    forms = [("401000", "PRLV SEPA DUPONT", "LIB:REGLEMENT FACTURE", "", "10.5"), ("411000", "VIR RECU", "", "20", ""),
             ("627000", "FRAIS BANCAIRE", "agios", "", "3")]
    for i in range(30):
        code, text, rem, credit, debit = forms[i % 3]
        lines.append(f"{code},{text},,{rem},{credit},{debit},{1 + i // 6:02d}/0{1 + i % 2}/2025")
    (tmp_path / "led.csv").write_text("\n".join(lines))
    led = read_csv_ledger(spark, str(tmp_path / "led.csv"))
    assert led.count() == 30 and led.select("txn_id").distinct().count() == 30
    assert led.filter("posting_date is null").count() == 0                     # day first was recognised
    assert {r.txn_id for r in led.collect()} == {r.txn_id for r in read_csv_ledger(spark, str(tmp_path / "led.csv")).collect()}
    tr, va, _ = sp.split_by_date(led, 0.8)
    m = learn.train(tr, kind="logistic", maxIter=20)
    rows = m.classify(va, k=2).collect()
    assert len(rows) == 6 and all(len(r["predictions"]) == 2 for r in rows)
    (tmp_path / "zero.csv").write_text(lines[0] + "\n401000,a,,b,0,NaN,2025-01-01")
    with pytest.raises(ValueError):
        read_csv_ledger(spark, str(tmp_path / "zero.csv"))


def test_class_filter_does_not_shuffle_the_ledger(spark):
    from ledgerlens.operators import normalize as nz
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) target")
    out = nz.filter_rare_classes(df, 143)
    assert {r.target for r in out.select("target").distinct().collect()} == set("012345")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(target" not in plan


def test_jdbc_limit_is_explicit():
    from ledgerlens.sources.jdbc import JdbcLedgerSource
    whole = JdbcLedgerSource("jdbc:x", "select * from t", partition_column="id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert whole.options()["dbtable"] == "(select * from t) ledger_src"
    cut = JdbcLedgerSource("jdbc:x", "select * from t limit %(limit)s", row_limit=5)
    assert cut.options()["query"] == "select * from t limit 5"
    for bad in ({"query": "select 1", "row_limit": 5}, {"query": "select 1 limit %(limit)s"},
                {"query": "q %(limit)s", "row_limit": 0},
                {"query": "q %(limit)s", "row_limit": 5, "partition_column": "id", "lower_bound": 0, "upper_bound": 1, "num_partitions": 1}):
        with pytest.raises(ValueError):
            JdbcLedgerSource("jdbc:x", **bad)


def test_metrics_and_comparison_sinks(spark, tmp_path):
    from ledgerlens.sources import sinks
    df = spark.createDataFrame([("a", 1.0)], "model string, accuracy double")
    sinks.write_report(df, str(tmp_path / "r"))
    assert any((tmp_path / "r").iterdir())


def test_several_date_formats_in_a_column(spark):
    """Most rows are day first: an ambiguous day is read so; what that cannot read goes to the next format."""
    import datetime as dt

    from ledgerlens.operators import normalize as nz
    given = {"03/04/2024": (2024, 4, 3), "25/12/2024": (2024, 12, 25), "14/07/2023": (2023, 7, 14), "12/31/2024": (2024, 12, 31),
             "2024-02-29": (2024, 2, 29), "20240131": (2024, 1, 31), "31.01.2024": (2024, 1, 31), " 5/5/24 ": None, "never": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in given], "posting_date string")
    order = nz.infer_date_formats(df)
    assert order[0] == "dd/MM/yyyy" and "MM/dd/yyyy" in order and None in order and "dd-MM-yyyy" not in order
    got = {r["posting_date"]: r["d"] for r in df.select("posting_date", nz.coerce_date(df, "posting_date", order).alias("d")).collect()}
    assert got == {k: None if v is None else dt.datetime(*v) for k, v in given.items()}
    assert nz.infer_date_formats(df.filter("posting_date = 'never'")) == [None]


def test_jdbc_bounds_come_from_the_database():
    src = JdbcLedgerSource("jdbc:x", "select * from t", partition_column="id", num_partitions=4, properties={"user": "u"})
    assert src.bounds_options() == {"url": "jdbc:x", "fetchsize": "10000", "user": "u",
                                    "query": "SELECT MIN(id) AS low, MAX(id) AS high FROM (select * from t) ledger_src"}
    with pytest.raises(ValueError):
        src.options()

    class Fake:
        """Stands for ``spark.read``: gives one row."""
        def __init__(self, row):
            self.read, self.row = self, row

        def format(self, _):
            return self

        def options(self, **_):
            return self

        def load(self):
            return self

        def first(self):
            return self.row
    opts = src.with_bounds(Fake((3, 90))).options()
    assert (opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("3", "91", "4")
    assert src.with_bounds(Fake((None, None))).options() == {"url": "jdbc:x", "fetchsize": "10000", "user": "u", "query": "select * from t"}
