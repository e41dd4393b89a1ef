"""F1/F2 goldens, tokenizer edge cases, K1/K2/K5 sinks."""

import os

from pyspark.sql import functions as F

from file_trees import write_files
from fleetlane.operators import wordcount as wc
from fleetlane.sinks import writers
from fleetlane.sources.text import read_input_sets

SETS = {
    "input1/file1.txt": "Hello Hadoop\n", "input1/file2.txt": "Hello Docker\n",
    "input2/file1.txt": "I am Docker\n", "input2/file2.txt": "I am Hadoop\n",
    "input3/file1.txt": "unix is a system\n", "input3/file2.txt": "linux is a system\n",
    "input3/file3.txt": "macOS is a system\n",
}
GOLDEN = {
    "input1": [("Docker", 1), ("Hadoop", 1), ("Hello", 2)],
    "input2": [("Docker", 1), ("Hadoop", 1), ("I", 2), ("am", 2)],
    "input3": [("a", 3), ("is", 3), ("linux", 1), ("macOS", 1), ("system", 3), ("unix", 1)],
}


def _sets(spark, tmp_path):
    root = write_files(str(tmp_path / "in"), SETS)
    return read_input_sets(spark, [os.path.join(root, s) for s in ("input1", "input2", "input3")])


def test_golden_counts_byte_order(spark, tmp_path):
    df = _sets(spark, tmp_path).withColumnRenamed("value", "text")
    got = wc.wordcount_by_set(df).collect()
    for s, exp in GOLDEN.items():
        rows = sorted(((r.word, r.cnt) for r in got if r.input_set == s), key=lambda x: x[0].encode())
        assert rows == exp


def test_sorted_is_byte_order(spark):
    df = spark.createDataFrame([("I am Docker",), ("I am Hadoop",)], "text string")
    assert [r.word for r in wc.wordcount_sorted(df).collect()] == ["Docker", "Hadoop", "I", "am"]


def test_tokenizer_edges(spark):
    texts = ["", "   ", "\tHello\fWorld\r\n", "  lead  blanks ", "Case case CASE", "a,b a,b", "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.cnt for r in wc.wordcount(df).collect()}
    exp = {}
    for t in texts:
        for tok in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" "):
            if tok:
                exp[tok] = exp.get(tok, 0) + 1
    assert got == exp  # NBSP is not a separator
    assert sum(got.values()) == sum(exp.values())


def test_text_scan_summary(spark, tmp_path):
    df = _sets(spark, tmp_path)
    lines = df.groupBy("input_set").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.input_set: r.n for r in lines} == {"input1": 2, "input2": 2, "input3": 3}


def test_sinks_wordcount_and_single(spark, tmp_path):
    df = _sets(spark, tmp_path).withColumnRenamed("value", "text")
    out = str(tmp_path / "wc")
    writers.write_wordcount(wc.wordcount(df), out)
    writers.write_wordcount(wc.wordcount(df), out)  # overwrite, not append
    back = spark.read.option("sep", "\t").csv(out).collect()
    assert sum(int(r._c1) for r in back) == 22
    assert [r._c0 for r in back] == sorted([r._c0 for r in back], key=str.encode)
    single = str(tmp_path / "single")
    writers.write_single(wc.wordcount_by_set(df), single)
    for s, exp in GOLDEN.items():
        files = [f for f in os.listdir(os.path.join(single, f"input_set={s}")) if f.startswith("part-")]
        assert len(files) == 1
        with open(os.path.join(single, f"input_set={s}", files[0])) as fh:
            assert [tuple(line.rstrip("\n").split("\t")) for line in fh] == [(w, str(c)) for w, c in exp]


def test_task_report_file(spark, tmp_path):
    docs = spark.createDataFrame([("t1", 1, "Hello Hadoop"), ("t1", 2, "Hello Docker")],
                                 "input_set string, doc_id long, text string")
    out = str(tmp_path / "rep")
    writers.write_task_report(wc.task_report_lines(docs), out, n_parts=3)
    folder = os.path.join(out, "task=t1")
    text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder))
                   if f.startswith("part-"))
    assert text.split("\n")[:-1] == [
        "input :", "Hello Hadoop", "Hello Docker", "", "wordcount output:", "Docker\t1", "Hadoop\t1",
        "Hello\t2", "", "mkdir output.txt:", "", "save hdfs to disk"]
