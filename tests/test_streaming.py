"""A stream of text files gives the rows a batch gives."""
from pyspark.sql import functions as F

from glassledger.streaming import statement_lines as S

FILES = {
    "a.txt": "Date Description Amount\n01/05/24 JOHN SMITH LLC 1,200.00 11,250.00\n01/06/24 PAYROLL DIRECT DEP 900.00\n",
    "b.txt": "01/07/24 CHECK #12 5.00\n\nTotal 5.00\n01/08/24 Acme 0.00\n",
}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, text in FILES.items():
        (source / name).write_text(text)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    S.write_rows(S.typed_rows(S.read_lines(spark, str(source), 1)), out, mark).awaitTermination()
    (source / "c.txt").write_text("01/09/24 Monthly Fee 3.00\n")
    S.write_rows(S.typed_rows(S.read_lines(spark, str(source), 1)), out, mark).awaitTermination()
    batch = spark.read.text(str(source)).select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("line"))
    cols = ["document", "date_raw", "description", "amount", "transaction_type", "include_for_1099"]
    got = spark.read.parquet(out).select(*cols).collect()
    assert sorted(got) == sorted(S.typed_rows(batch).select(*cols).collect()) and len(got) == 4
