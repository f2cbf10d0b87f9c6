"""Real files: headers of their own, row numbers, corrupt records, and runs that die."""
import os

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import files

A = "raw/tdx/kline/2001-12-31/run1/"


@pytest.fixture
def raw(tmp_path):
    def put(name: str, content) -> None:
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    put(A + "a.csv", '﻿code,close,note\n1,2.5,"two\nlines, quoted"\n\n2,3.5,\n')
    put(A + "b.csv", "note,code\r\nx,7\r\ny\r\nz,8,9\r\n")  # other order, too few and too many fields
    put(A + "c.csv", b"code,close\n\xff,1\n")
    put(A + "empty.csv", "")
    put(A + "head.csv", "code,close\n")
    put("raw/akshare/price/2001-12-31/run1/d.csv", "code\n9\n")
    put(A + "note.txt", "code\n1\n")
    return tmp_path


def test_layouts(spark, raw):
    found = files.scan(spark, f"{raw}/raw", "tdx/kline", "tdx/index")
    assert found.count() == 4 and files.scan(spark, f"{raw}/raw").count() == 5
    got = files.read_layout(found, ["code", "close", "note"]).withColumn("f", files.part("file_path", 4))
    rows = sorted((r.f, r.row_no, r.code, r.close, r.note, r.corrupt) for r in got.collect())
    assert rows == [
        ("a", 1, "1", "2.5", "two\nlines, quoted", None), ("a", 2, "2", "3.5", "", None),
        ("b", 1, "7", None, "x", None), ("b", 2, None, None, "y", "y"), ("b", 3, "8", None, "z", "z,8,9"),
        ("c", 1, "�", "1", None, "�,1"),
    ]
    assert files.scan(spark, f"{raw}/raw", "tdx/index").count() == 0


def test_ledger(spark, raw, tmp_path):
    ledger = files.Ledger(spark, f"{tmp_path}/ledger")
    found = lambda: files.scan(spark, f"{raw}/raw")

    def parse(x):
        rows = files.read_layout(x, ["code"])
        return rows.where("corrupt is null"), rows.where("corrupt is not null")
    seen = lambda: sorted(r.code for r in ledger.facts().collect())

    class Died(Exception):
        pass

    def dies(x):
        raise Died
    assert ledger.facts() is None and ledger.objects().count() == 0
    with pytest.raises(Died):
        ledger.ingest("r0", found(), dies)
    ledger.prepare("r1", found(), parse)  # dies before it is done
    assert ledger.objects().count() == 0 and ledger.facts() is None
    ledger.ingest("r2", found(), parse)
    assert seen() == ["1", "2", "9"]  # b and c are rejected whole
    assert {r.fetch_status: r["count"] for r in ledger.objects().groupBy("fetch_status").count().collect()} == {"ok": 3, "rejected": 2}
    ledger.ingest("r2", found(), parse)  # done already
    (tmp_path / A / "copy.csv").write_bytes((tmp_path / A / "a.csv").read_bytes())
    (tmp_path / A / "new.csv").write_text("code\n5\n")
    ledger.ingest("r3", found(), parse)
    assert seen() == ["1", "2", "5", "9"]
    assert ledger.objects().where("run_id = 'r3'").select(F.sum(F.col("fetch_status").isin("ok").cast("int"))).first()[0] == 1
