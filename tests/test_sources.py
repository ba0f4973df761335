"""One file for each verdict, in few folders."""

import os

import pytest

from pairlens import plans
from pairlens.plans import registry
from pairlens.sources import readers as R
from pairlens.sources import writers as W

plans.load()


def files_in(spark, name):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {x: {d: files for d, _, files in os.walk(f"{root}/{x}")} for x in os.listdir(root) if x.startswith(name)}


def test_a_file_for_each_verdict_without_a_folder_for_each(spark, sf, monkeypatch):
    monkeypatch.setattr(W, "FOLDER_FILES", 4)
    old = files_in(spark, "verdicts")
    rows = registry.QUERIES["src_verdict_files"](spark, sf).collect()
    (folders,) = [v for k, v in files_in(spark, "verdicts").items() if k not in old]
    names = [x for files in folders.values() for x in files]
    assert sorted(names) == sorted(f"{r.s_suppkey}__{r.family}" for r in rows)
    assert len(folders) <= 1 + -(-len(rows) // 4)  # the root and a folder for every four


def test_text_files(spark):
    path = W.shared_path(spark, "texts")
    W.text_files(spark.createDataFrame([("7__fam", "x"), ("7__fam", "x"), (None, "y"), ("8__fam", None)], "name string, text string"), path)
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).selectExpr("_metadata.file_name as name", "value as text").collect()
    assert sorted(map(tuple, raw)) == [("7__fam", "x\nx\n"), ("8__fam", "\n"), ("unnamed", "y\n")]
    got = R.verdict_files(spark.createDataFrame(raw), spark.createDataFrame([(7,)], "id long")).collect()
    assert sorted((r.id or "", r.text, r.matched) for r in got) == [("", "y", False), ("7", "xx", True), ("8", "", False)]
    empty = W.shared_path(spark, "texts")
    W.text_files(spark.createDataFrame([], "name string, text string"), empty)
    assert spark.read.text(empty, wholetext=True, recursiveFileLookup=True).count() == 0
    with pytest.raises(Exception, match="no name of a file"):
        W.text_files(spark.createDataFrame([("_7", "x")], "name string, text string"), W.shared_path(spark, "texts"))
