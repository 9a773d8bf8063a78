"""Texts of folders within a budget against a plain loop."""

import random
from pathlib import Path

from larkspur.operators import text as OT
from larkspur.plans import files as plan_files
from larkspur.sources import html


def by_loop(files, most):
    found = {}
    for folder in {f for f, _, _ in files}:
        whole, n = "", 0
        for _, name, text in sorted(x for x in files if x[0] == folder):
            chunk = f"\n\n===== FILE: {name} =====\n\n{(text or '').strip(' \t\n\x0b\x0c\r')}\n"
            if len(whole) + len(chunk) > most:
                break
            whole, n = whole + chunk, n + 1
        found[folder] = (n, whole.strip(" \t\n\x0b\x0c\r") + "\n")
    return found


def test_gathered_by_loop(spark):
    r = random.Random(3)
    files = [(f"f{i % 3}", f"n{i:04d}.txt", r.choice(["", "  a\n", "ü" * r.randrange(60), "x y\n" * r.randrange(9)])) for i in range(300)]
    files += [("long", "a.txt", "z" * 500), ("long", "b.txt", "b"), ("blank", "a.txt", "\n \n")]
    df = spark.createDataFrame(files, "folder string, name string, text string")
    for most in (0, 25, 26, 100, 400, 3000, 10**6):
        for salts in (1, 32):
            got = {x["folder"]: (x["files"], x["text"]) for x in OT.gathered(df, "folder", "name", "text", most, salts).collect()}
            assert got == by_loop(files, most), (most, salts)


def test_gathered_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(None, "a", None, 1), (None, "b", "t", 2), ("f", "a", "u", 3)], "_g string, _n string, _size string, _k int")
    got = {x["_g"]: (x["files"], x["text"]) for x in OT.gathered(df, "_g", "_n", "_size", 100).collect()}
    assert got == {None: (2, "===== FILE: a =====\n\n\n\n\n===== FILE: b =====\n\nt\n"), "f": (1, "===== FILE: a =====\n\nu\n")}
    assert OT.gathered(df.limit(0), "_g", "_n", "_size", 100).count() == 0


def test_packed_files(spark, tmp_path):
    """Files of any names and bytes come back as they are, in few files on disk, and documents are told by their first bytes."""
    files = [("a/b", "x=1.pdf", b"%PDF-1.4 /CreationDate (D:20200102)"), ("a:b", "y z", b"\xff\x00plain\n"), ("", "n", b""), ("é", "m", None)]
    files += [("many", f"{i}", b"%PDF") for i in range(500)]
    df = spark.createDataFrame(files, "folder string, name string, content binary")
    html.packed(df, f"{tmp_path}/in")
    found = html.unpacked(spark, f"{tmp_path}/in")
    key = lambda r: (r[0], r[1])
    assert sorted(((r["folder"], r["name"], r["content"] and bytes(r["content"])) for r in found.collect()), key=key) == sorted(((f, n, c and bytes(c)) for f, n, c in files), key=key)
    assert len(list((tmp_path / "in").glob("*.parquet"))) <= 8
    docs = html.only_documents(found)
    assert docs.count() == 501
    day = docs.where("folder = 'a/b'").first()["created"]
    assert (day.year, day.month, day.day) == (2020, 1, 2)


def test_flows_write_packs(spark):
    """A file for each row takes milliseconds of the driver: these flows write no more files than they have tasks."""
    rows = spark.range(300).selectExpr("'f' AS folder", "CAST(id AS STRING) AS name", "'x' AS content")
    folder = plan_files._written(rows).removeprefix("file://")
    assert 0 < sum(1 for p in Path(folder).rglob("*.parquet")) <= 8
