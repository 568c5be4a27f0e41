"""Running yearly totals: any order of files, a restart, repeated rows and late rows."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from glassledger.streaming import yearly_totals as Y


def rows(seed=4):
    draw = random.Random(seed)
    out = []
    for n in range(300):
        day = f"{draw.randint(1, 12):02d}/{draw.randint(1, 28):02d}/{draw.choice((2022, 2023, 2024))}"
        out.append(("s", n, day, f"ACH Payment - VENDOR {'ABCDEFGH'[draw.randrange(8)] * 4} LLC", Decimal(draw.randint(100, 9000)) / 100))
    return out + [("s", 900, None, "ACH Payment - NO DAY LLC", Decimal(5000)), ("s", 901, "01/02/2024", "PAYROLL", Decimal(5000)),
                  ("s", 902, "01/02/2024", "ACH Payment - NO AMOUNT LLC", None)]


def land(spark, folder, data, files):
    for i in range(files):
        spark.createDataFrame(data[i::files], Y.ROW).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, lateness="4000 days"):
    changes = Y.yearly_changes(Y.read_rows(spark, str(tmp_path / "in"), files_per_trigger=1), lateness)
    Y.keep_changes(changes, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    return Y.read_changes(spark, str(tmp_path / "out"))


def batch_totals(spark, data):
    paid = Y.payments(spark.createDataFrame(data, Y.ROW)).withColumn("year", F.year("paid_at"))
    return {(r.canonical_name, r.year): (Decimal(r.c) / 100, r.n) for r in paid.groupBy("canonical_name", "year").agg(F.sum("cents").alias("c"), F.count("*").alias("n")).collect()}


def check(spark, changes, data):
    got = {(r.canonical_name, r.year): (r.total_amount, r.payments, r.alerts) for r in Y.latest_totals(changes).collect()}
    assert got == {k: (total, n, int(total >= 600)) for k, (total, n) in batch_totals(spark, data).items()}
    for r in Y.alerts(changes).collect():
        assert r.previous_amount < 600 <= r.total_amount


@pytest.mark.parametrize("order", [1, 2])
def test_any_order_and_a_restart(spark, tmp_path, order):
    data = rows()
    random.Random(order).shuffle(data)
    folder = str(tmp_path / "in")
    land(spark, folder, data[:150], 3)
    run(spark, tmp_path)
    # rows sent again with the later files count once
    land(spark, folder, data[150:] + data[:40], 3)
    check(spark, run(spark, tmp_path), data)


def test_a_failed_batch_is_written_again(spark, tmp_path):
    data = rows()
    land(spark, str(tmp_path / "in"), data, 2)
    left = tmp_path / "out" / "batch=0"
    left.mkdir(parents=True)
    (left / "part-00000-half-written.parquet").write_bytes(b"PAR1")
    check(spark, run(spark, tmp_path), data)


def test_late_rows_are_left_out_and_state_ends_with_its_year(spark, tmp_path):
    on = lambda n, day, cents=10_000: ("s", n, day, "ACH Payment - ACME LLC", Decimal(cents) / 100)
    land(spark, str(tmp_path / "in"), [on(1, "03/01/2022"), on(2, "05/01/2022")], 1)
    run(spark, tmp_path, "30 days")
    land(spark, str(tmp_path / "in"), [on(3, "06/01/2023"), on(4, "04/20/2022")], 1)
    run(spark, tmp_path, "30 days")
    land(spark, str(tmp_path / "in"), [on(5, "12/30/2022"), on(6, "05/20/2023", 60_000)], 1)
    got = {(r.year, r.total_amount, r.payments, r.alerts) for r in Y.latest_totals(run(spark, tmp_path, "30 days")).collect()}
    assert got == {(2022, Decimal(300), 3, 0), (2023, Decimal(700), 2, 1)}


def test_no_rows(spark, tmp_path):
    land(spark, str(tmp_path / "in"), rows()[-3:], 1)
    assert Y.latest_totals(run(spark, tmp_path)).collect() == []
