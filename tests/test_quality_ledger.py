import tempfile

from pyspark.sql import functions as F

from ledgerlake.operators import metrics as M
from ledgerlake.operators import quality as Q
from ledgerlake.session import scratch_path
from ledgerlake.sources import ledger as L
from tests.conftest import make
from tests.test_metrics import INVOICES, PROJECTS


def test_reconcile_kpis(spark):
    rows = {r["metric"]: r for r in Q.reconcile_kpis(make(spark, "projects", PROJECTS),
                                                      make(spark, "invoices", INVOICES)).collect()}
    assert rows["contracted_total"]["ok"] and rows["paid_amount"]["ok"] and rows["total_projects"]["ok"]
    assert not rows["unpaid_amount"]["ok"] and rows["unpaid_amount"]["expected"] == 37
    assert rows["unpaid_null_status_amount"]["ok"] and rows["unpaid_null_status_amount"]["expected"] == 7
    assert not rows["by_status_contracted_total"]["ok"]
    assert rows["status_classes_sum"]["ok"]


def test_domain_violations_and_formats(spark):
    p = make(spark, "projects", PROJECTS + [dict(id=99, name="z", status="見積中")])
    i = make(spark, "invoices", INVOICES)
    c = make(spark, "customers", [dict(id=1, name="k", building_type="戸建て"), dict(id=2, name="k", building_type="城")])
    got = {(r["field"], r["value"]): r["n"] for r in Q.domain_violations(p, i, c).collect()}
    assert got == {("status", None): 1, ("status", "見積中"): 1, ("payment_status", None): 1, ("building_type", "城"): 1}
    f = {(r["column"], r["format_class"]): r["n"] for r in Q.date_formats({"invoices": i}).collect()}
    assert f[("invoices.billing_date", "slash_unpadded")] == 2 and f[("invoices.billing_date", "iso")] == 1
    assert f[("invoices.billing_date", "null")] == 1


def test_orphan_staff_and_contract(spark):
    emps = make(spark, "employees", [dict(id=1, name="山田 太郎"), dict(id=2, name="鈴木 一郎")])
    cust = make(spark, "customers", [dict(id=1, name="k", staff="佐藤")])
    got = {(r["source"], r["staff"]): r["n"] for r in Q.orphan_staff(make(spark, "projects", PROJECTS), cust, emps).collect()}
    assert got == {("projects", "田中"): 2, ("customers", "佐藤"): 1}
    kpi = M.kpi_summary(make(spark, "projects", PROJECTS), make(spark, "invoices", INVOICES))
    assert Q.check_output_contract(kpi, Q.KPI_CONTRACT) == []
    perf = M.staff_performance(make(spark, "projects", PROJECTS))
    assert Q.check_output_contract(perf.drop("revenue"), Q.PERFORMANCE_CONTRACT) == ["revenue"]


def test_ledger_round_trip_with_preamble_and_rejects(spark):
    src = make(spark, "projects", [dict(id=i, name=f"p{i}", customer_name="c", estimate_amount=i * 10,
                                        contract_date="2024/3/5" if i % 2 else None) for i in range(1, 41)])
    path = scratch_path(spark, "ledger-test")
    L.export_ledger(src, "projects", path, files=3, title="案件")
    rows, rejects = L.load_ledger(spark, path, "projects")
    got = rows.collect()
    assert len(got) == 40 and rejects.count() == 0
    assert sorted(r["name"] for r in got) == sorted(f"p{i}" for i in range(1, 41))
    assert sorted(r["id"] for r in got) == list(range(1, 41))
    # a hand-written sheet: preamble, a falsy first cell, an uncastable amount
    d = tempfile.mkdtemp(prefix="ledger-hand-")
    with open(f"{d}/sheet.csv", "w") as fh:
        fh.write("案件管理表\n,,\n出力日,,\nname,customer_name,address\n")
        fh.write("A,c,x,,,,,100,45000,,,,\n,c,x\n0,c,x\nB,c,x,,,,,12x,,,,,\nC,c,x,,,,,7,2024/5/26,,,,\n")
    rows, rejects = L.load_ledger(spark, d, "projects")
    got = {r["name"]: r for r in rows.collect()}
    assert set(got) == {"A", "C"} and got["A"]["id"] == 1 and got["C"]["id"] == 2
    assert got["A"]["first_visit"] == "2023/03/15" and got["C"]["first_visit"] == "2024/5/26"
    assert [(r["name"], r["reason"]) for r in rejects.collect()] == [("B", "estimate_amount")]


def test_ledger_edges_neither_lose_nor_invent_rows(spark):
    def load(text):
        d = tempfile.mkdtemp(prefix="ledger-edge-")
        with open(f"{d}/sheet.csv", "w") as fh:
            fh.write(text)
        rows, rejects = L.load_ledger(spark, d, "projects")
        return [r["name"] for r in rows.orderBy("id").collect()], [(r["name"], r["reason"]) for r in rejects.collect()]

    head, tail = "title\n", "," * 11 + "\n"
    assert load(f"{head}\nexported,,\nname,customer_name\nA,{tail}B,{tail}") == (["A", "B"], [])
    assert load(f"{head},,\n  \nname,customer_name\n000,{tail}0D,{tail}0,{tail}0.0,{tail}") == (["000", "0D"], [])
    dates = lambda v: "D,c,x,,,,,1,%s,,,,\n" % v
    assert load(f"{head},,\n,,\nh\n" + dates("09012345678") + dates("20240305") + dates("0.5") + dates("-5") + dates("45000")) == (
        ["D"], [("D", "first_visit")] * 4)
    assert load(f"{head},,\n,,\nh\nlong,{tail[:-1]},,,\nshort,c\nA,{tail}") == (["A"], [("long", "cell_count"), ("short", "cell_count")])
    src = make(spark, "projects", [dict(id=i, name=f"p{i}", customer_name="c", note='a "q"\nb,\nc') for i in range(1, 4)])
    path = scratch_path(spark, "ledger-lines")
    L.export_ledger(src, "projects", path, files=2, title="t")
    rows, rejects = L.load_ledger(spark, path, "projects")
    assert rejects.count() == 0 and sorted((r["name"], r["note"]) for r in rows.collect()) == [(f"p{i}", 'a "q"\nb,\nc') for i in (1, 2, 3)]


def test_all_six_ledgers_load_and_rejects_are_kept(spark):
    from ledgerlake.sources.store import TableStore
    store = TableStore(spark, scratch_path(spark, "six"))
    est = make(spark, "estimates", [dict(id=1, quote_no="Q1", qty=1.5, unit_price=2, subtotal=3, created_date="2024/3/5")])
    paths = {}
    frames = {t: make(spark, t, [dict(id=1, **{f: "v"})]) for t, f in (("employees", "name"), ("customers", "name"), ("projects", "name"),
                                                                          ("invoices", "invoice_no"), ("services", "name"))}
    for t, df in {**frames, "estimates": est}.items():
        paths[t] = scratch_path(spark, f"six-{t}")
        L.export_ledger(df, t, paths[t], files=1, title=t)
    store.publish({"services": frames["services"].limit(0)})  # an empty table does not block its import
    assert L.import_ledgers(spark, store, paths) == dict.fromkeys(paths, 1)
    assert store.read("estimates").first()["qty"] == 1.5 and store.read("services_rejects").count() == 0


def test_json_lines_round_trip(spark):
    src = make(spark, "projects", PROJECTS)
    path = scratch_path(spark, "json-lines")
    L.to_json_lines(src).write.text(path)
    back = spark.read.schema(src.schema).json(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, src.collect()))


def test_wrong_served_kpi_is_found(spark):
    p, i = make(spark, "projects", PROJECTS), make(spark, "invoices", INVOICES)
    served = M.kpi_summary(p, i)
    for column in ("contracted_total", "paid_amount", "total_projects"):
        wrong = served.withColumn(column, served[column] + 1)
        rows = {r["metric"]: r["ok"] for r in Q.reconcile_kpis(p, i, wrong).collect()}
        assert not rows[column] and rows["unpaid_null_status_amount"]


def test_source_profile(spark):
    p = make(spark, "projects", PROJECTS)
    rows = L.source_profile({"projects": (p, "id", "name")}).collect()
    assert [r["rn"] for r in sorted(rows, key=lambda r: r["rn"])] == [1, 2, 3, 4, 5, 6]
    assert {r["row_count"] for r in rows} == {8} and sorted(rows, key=lambda r: r["rn"])[0]["label"] == "p1"


def test_import_once_guard_is_per_table(spark):
    from ledgerlake.sources.store import TableStore
    emps = make(spark, "employees", [dict(id=i, name=f"e{i}") for i in range(1, 6)])
    cust = make(spark, "customers", [dict(id=i, name=f"k{i}") for i in range(1, 4)])
    pe, pc = scratch_path(spark, "imp-e"), scratch_path(spark, "imp-c")
    L.export_ledger(emps, "employees", pe, files=2, title="社員")
    L.export_ledger(cust, "customers", pc, files=1, title="顧客")
    store = TableStore(spark, scratch_path(spark, "imp-store"))
    assert L.import_ledgers(spark, store, {"employees": pe}) == {"employees": 5}
    # a second run skips employees and completes the missing table
    assert L.import_ledgers(spark, store, {"employees": pe, "customers": pc}) == {"customers": 3}
    assert store.hwm("employees") == 5 and store.read("employees").count() == 5
    assert L.import_ledgers(spark, store, {"employees": pe, "customers": pc}) == {}


def test_only_files_with_breaks_lose_their_splits(spark):
    path = scratch_path(spark, "routing")
    rows = make(spark, "projects", [dict(id=i, name=f"p{i}", customer_name="c" * 40, note="a\nb" if i % 50 == 3 else 'say "x"') for i in range(400)])
    L.export_ledger(rows, "projects", path, 5, "t", spread=F.col("id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = L.read_ledger_lines(spark, path, "projects")
        blocks = {r[0].split("_bucket=")[1][0]: r[1] for r in lines.groupBy("_file").agg(F.countDistinct("_block")).collect()}
        assert blocks.pop("3") == 1 and len(blocks) == 4 and min(blocks.values()) > 1
        loaded, rejects = L.load_ledger(spark, path, "projects")
        got = {r.name: r for r in loaded.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rejects.count() == 0 and sorted(r.id for r in got.values()) == list(range(1, 401))
    assert {n: got[f"p{n}"].note for n in (3, 4, 53)} == {3: "a\nb", 4: 'say "x"', 53: "a\nb"}
    # ids follow the files, and the lines within one
    by_file = [sorted((got[f"p{i}"].id, i) for i in range(f, 400, 5)) for f in range(5)]
    assert all([i for _, i in part] == sorted(i for _, i in part) and part[-1][0] - part[0][0] == 79 for part in by_file)


def test_file_profile(spark):
    path = scratch_path(spark, "profile")
    rows = make(spark, "customers", [dict(id=i, name=f"n{i}", age_years=i, note="x\ny" if i == 2 else None) for i in range(10)])
    L.export_ledger(rows, "customers", path, 2, "ledger", spread=F.col("id"))
    got = {(r.file.split("_bucket=")[1][0], r.rn): (r.row_count, r.cells) for r in L.file_profile(spark, path, "customers").collect()}
    assert set(got) == {(f, n) for f in "01" for n in range(1, 7)} and {c for c, _ in got.values()} == {9}
    assert got["0", 1][1] == "ledger||||||||" and got["0", 4][1].startswith("name|address|")
    assert got["1", 5][1] == "n1|||1|||||" and got["0", 6][1] == "n2|||2|||||x\ny"


def test_a_load_shuffles_no_rows(spark, tmp_path):
    """A row meets its file's start and blank lines without a join by the file's path."""
    rows = make(spark, "employees", [{"id": i, "name": f"n{i}"} for i in range(1, 40)])
    L.export_ledger(rows, "employees", str(tmp_path / "out"), 3, "employees ledger")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loaded = L.load_ledger(spark, str(tmp_path / "out"), "employees", assign_ids=False)[0]
        assert "SortMergeJoin" not in loaded._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["name"] for r in loaded.collect()) == sorted(f"n{i}" for i in range(1, 40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blank_lines_of_a_preamble_are_counted(spark, tmp_path):
    width = ",,,,,,"
    (tmp_path / "a.csv").write_text("title\n \t\nnote\nname" + width + "\nfirst" + width + "\n\nsecond" + width + "\n")
    (tmp_path / "b.csv").write_text("title\n" + width + "\nnote\nname" + width + "\nthird" + width + "\n")
    rows = L.load_ledger(spark, str(tmp_path), "employees", assign_ids=False)[0]
    assert sorted(r["name"] for r in rows.collect()) == ["first", "second", "third"]


def test_numbers_are_those_a_cast_reads(spark):
    from ledgerlake.functions import normalise as N
    texts = ["1e-5", "-5", "1.5d", "0x1p-3", "0x1e-5", "NaN", "-Infinity", "2024-1-2", "2024/1/2", "1-", "--1", " 12 ", "1E-3f", "", None, "0", "-0.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(N.number("t").alias("a"), F.col("t").try_cast("double").alias("b")).where("not (a <=> b)").collect()
    assert got == []
