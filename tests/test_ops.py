"""Retrieval job outputs, output inventory, checksum manifest."""

import hashlib

from zonegrid.params import TESTDATA
from zonegrid.plans.retrieval import OUTPUTS, run_retrieval
from zonegrid.sources import files
from zonegrid.sources.sinks import read_split
from zonegrid.suite.base import trips


def test_retrieval_outputs_and_inventory(spark, tmp_path):
    out = str(tmp_path / "run")
    res = run_retrieval(spark, trips(spark, "/root/testdata/sf0.001"), TESTDATA, out)
    inv = {r.dataset: (r.present, r.size_mb) for r in files.output_inventory(spark, out, OUTPUTS).collect()}
    assert set(inv) == set(OUTPUTS) and all(p for p, _ in inv.values())
    train = read_split(spark, res["features"], "train")
    assert train.count() > 0 and {r.split for r in train.select("split").distinct().collect()} == {"train"}
    missing = files.output_inventory(spark, out, {**OUTPUTS, "other.parquet": "nothing.parquet"}).collect()
    assert {r.dataset: r.present for r in missing}["other.parquet"] is False


def test_manifest_status(spark, tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "a.parquet").write_bytes(b"alpha")
    (d / "b.parquet").write_bytes(b"beta")
    cur = files.file_checksums(spark, str(d))
    got = {r.name: r.sha256 for r in cur.collect()}
    assert got["a.parquet"] == hashlib.sha256(b"alpha").hexdigest()
    manifest = spark.createDataFrame([("a.parquet", got["a.parquet"], 5, "x"), ("b.parquet", "0" * 64, 4, "y")],
                                     files.MANIFEST_SCHEMA)
    status = {r.name: r.status for r in files.manifest_status(cur, manifest).collect()}
    assert status == {"a.parquet": "unchanged", "b.parquet": "changed"}
    assert [r.name for r in files.changed_files(cur, manifest).collect()] == ["b.parquet"]
    empty = files.read_manifest(spark, str(tmp_path / "none"))
    kept = str(tmp_path / "kept")
    files.write_manifest(cur, kept)
    files.write_manifest(cur, kept)
    assert {r.status for r in files.manifest_status(cur, files.read_manifest(spark, kept)).collect()} == {"unchanged"}
    assert {r.status for r in files.manifest_status(cur, empty).collect()} == {"new"}


def test_large_files_by_byte_ranges(spark, tmp_path):
    """Beyond the range size a checksum joins those of the ranges; below it nothing changes."""
    import hashlib
    data = {"long.parquet": bytes(range(256)) * 11 + b"end", "edge.parquet": b"x" * 2000, "short.parquet": b"ab",
            "empty.parquet": b""}
    folder = tmp_path / "with blank"
    folder.mkdir()
    for name, content in data.items():
        (folder / name).write_bytes(content)
    size = 1000
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def expected(b):
        return sha(b) if len(b) <= size else sha("".join(sha(b[i:i + size]) for i in range(0, len(b), size)).encode())
    got = {r["name"]: (r["sha256"], r["bytes"]) for r in
           files.file_checksums(spark, str(folder), range_bytes=size).collect()}
    del data["empty.parquet"]                      # files without content are not listed
    assert got == {n: (expected(b), len(b)) for n, b in data.items()}
    whole = {r["name"]: r["sha256"] for r in files.file_checksums(spark, str(folder)).collect()}
    assert whole == {n: sha(b) for n, b in data.items()}
