"""CSV lines that are not records of the header's fields become rejects with their raw text."""

import pytest
from conftest import rows

from plan_alloc import AllocSpec
from plan_alloc.operators import standardize as S
from plan_alloc.plans.job import run_job
from plan_alloc.sources.csv_text import MALFORMED, drop_malformed
from plan_alloc.sources.tables import read_table
from plan_alloc.spec import DataError, SchemaError

HEADER = b"period,market,channel,client,sku,baseline_qty\n"
GOOD = [b'2026-01,N,web,c1,a,5', b'2026-01,N,web,c1,"b, with ""quotes""","1,234"', b'2026-01,N,web,c1,c,"6"\r', b"2026-01,N,web,c1,d,7"]
BAD = [
    b"2026-01,N,web,c1,e,1,234",  # surplus field
    b"2026-01,N,web,c1,f",  # missing field
    b'2026-01,N,web,"c1,g,5',  # unclosed quote inside
    b'2026-01,N,web,c1,h,"5',  # unclosed quote at the end
    b'2026-01,N,web,c1,"i"x,5',  # text after the closing quote
    b'2026-01,N,web,c1,j"k,5',  # quote inside plain text
    b"2026-01,N,web,c1,\xff\xfe,5",  # not UTF-8
    b"2026-01,N,web,c1,l\x00\x01\x00m,5,6",  # holds what no line should hold
]


@pytest.fixture
def csv_folder(tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_bytes(HEADER + b"\n".join(GOOD[:2] + BAD[:4]) + b"\n\n")
    (folder / "part-1.csv").write_bytes(HEADER + b"\n".join(BAD[4:] + GOOD[2:]))
    return str(folder)


def _raw(line):
    return line.rstrip(b"\r").decode("utf-8", "replace")


def test_malformed_lines_are_kept_with_their_text(spark, csv_folder):
    df = read_table(spark, csv_folder)
    assert df.columns == [*HEADER.decode().strip().split(","), MALFORMED]
    assert sorted(r[MALFORMED] for r in df.where(f"{MALFORMED} is not null").collect()) == sorted(map(_raw, BAD))
    assert rows(drop_malformed(df), "sku", "baseline_qty") == [("a", "5"), ('b, with "quotes"', "1,234"), ("c", "6"), ("d", "7")]
    assert df.where("sku = 'a'").count() == 1 and df.count() == len(GOOD) + len(BAD)


def test_rejects_profile_and_rules(spark, csv_folder):
    std = S.standardize_granular(read_table(spark, csv_folder), AllocSpec())
    assert rows(std.table, "sku", "baseline_qty") == [("a", 5.0), ('b, with "quotes"', 1234.0), ("c", 6.0), ("d", 7.0)]
    assert sorted((r[MALFORMED], r.reason) for r in std.rejects.collect()) == sorted((_raw(x), "csv_malformed") for x in BAD)
    profile = std.profile.first()
    assert profile.row_count == len(GOOD) + len(BAD) and profile.column_count == 6 and profile.null_sku == 0
    counts = {c.name: c.violations.first()[c.count_col] for c in std.checks if c.count_col}
    assert counts == {"granular_null_keys": 0, "granular_rejected_values": len(BAD)}
    report = S.validate_schema(read_table(spark, csv_folder), AllocSpec(), "granular")
    assert report.column_count == 6 and MALFORMED not in report.actual_columns


def test_job_refuses_malformed_lines_and_names_the_rule(spark, tmp_path):
    (tmp_path / "macro.csv").write_bytes(b"period,market,channel,macro_target_qty,macro_target_value\n2026-01,N,web,10,20\n")
    (tmp_path / "granular.csv").write_bytes(b"period,market,channel,client,sku,baseline_qty,baseline_value\n2026-01,N,web,c,a,1,2\n2026-01,N,web,c,b,1,234,5\n")
    macro, granular = (read_table(spark, str(tmp_path / f"{n}.csv")) for n in ("macro", "granular"))
    with pytest.raises(DataError, match="granular_malformed_lines"):
        run_job(macro, granular)
    result = run_job(macro, granular, check=False)
    assert rows(result.final_allocations, "sku", "final_allocated_qty") == [("a", 10.0)]
    result.release()


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"sku,qty\na,1\n")
    (tmp_path / "b.csv").write_bytes(b"qty,sku\n1,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path), fmt="csv").collect()


@pytest.mark.parametrize(("header", "message"), [(b"a,,b", "without a name"), (b"a,b,a", "repeats"), (MALFORMED.encode() + b",a", "reserved")])
def test_headers_that_name_no_table(spark, tmp_path, header, message):
    (tmp_path / "x.csv").write_bytes(header + b"\n1,2,3\n")
    with pytest.raises(SchemaError, match=message):
        read_table(spark, str(tmp_path / "x.csv"))


def test_empty_files_and_odd_names(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(DataError, match="no header"):
        read_table(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "odd.csv").write_bytes("﻿a b,`c`,d.e\n1,2,3\n".encode())
    df = read_table(spark, str(tmp_path / "odd.csv"))
    assert df.columns[:3] == ["a b", "`c`", "d.e"] and tuple(df.first())[:3] == ("1", "2", "3")
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    assert read_table(spark, str(tmp_path / "head.csv")).count() == 0


def test_long_fields_and_line_breaks(spark, tmp_path):
    long = "x" * 300_000 + '""' * 50_000
    (tmp_path / "long.csv").write_text(f'a,b\n"{long}",1\n"{long},1\n')
    df = read_table(spark, str(tmp_path / "long.csv"))
    assert sorted(df.selectExpr("length(a)", f"length({MALFORMED})").collect(), key=str) == [(350_000, None), (None, 400_003)]
    (tmp_path / "breaks.csv").write_text('a,b\n"one\ntwo",1\n3,4,5\n6,7\n8,"9"x\n')
    df = read_table(spark, str(tmp_path / "breaks.csv"), multi_line=True)
    assert rows(drop_malformed(df)) == [("6", "7"), ("one\ntwo", "1")]
    assert df.where(f"{MALFORMED} is not null").count() == 2
