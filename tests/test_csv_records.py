"""Quoted CSV in blocks equals pandas and the parser's own scan of whole files, wherever the blocks end."""

import csv
import os
import random
import subprocess
import sys
import tempfile

import pandas as pd
import pytest

from wordloom.sources import csv_records as cr
from wordloom.sources import csv_splits as cs

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def _field(rng):
    kind = rng.randrange(9)
    words = " ".join(rng.choice(["alpha", "Bé", "நன்றி", "x", "12", "it's"]) for _ in range(rng.randrange(1, 9)))
    if kind < 3:
        return words
    if kind == 3:
        return ""
    if kind == 4:
        return '"' + words.replace(" ", "\n") + '"'
    if kind == 5:
        return f'"{words}, ""quoted"" {words}\n\n""""\n"'
    if kind == 6:
        return f'"{words}\r\n,"'
    if kind == 7:
        return words + ' 5" disk'  # a quote inside an unquoted field
    return '""'


def _text(seed, n, newline="\n", broken=False):
    """Records with newlines in quoted fields; ``broken``: also quotes opened inside unquoted fields, so that quoted ones begin anywhere."""
    rng = random.Random(seed)
    rows = ["text,label,note"]
    for i in range(n):
        rows.append(f"{i} {_field(rng)}" if broken and rng.random() < 0.3 else ",".join([f"r{i}", _field(rng), _field(rng)]))
        if rng.random() < 0.05:
            rows.append("")
    return newline.join(rows) + (newline if seed % 2 else "")


def _pandas(path):
    return [tuple(r) for r in pd.read_csv(path, dtype=str, keep_default_na=False).values.tolist()]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in before.items():
        spark.conf.set(n, v)


def _write(text):
    path = os.path.join(tempfile.mkdtemp(prefix="wordloom-blocks-", dir="/tmp"), "part.csv")
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


@pytest.mark.parametrize("size", [61, 5000])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_blocks_give_the_records(spark, small_blocks, size, newline):
    path = _write(_text(len(newline), 120, newline))
    plain = [tuple(r) for r in spark.read.options(**OPTIONS).csv(path).collect()]
    small_blocks(size)
    rows = sorted(tuple(r) for r in cr.scan(spark, path, OPTIONS).collect())
    got = [tuple(v or "" for v in r[1:]) for r in rows]
    assert [r[0] for r in rows] == list(range(120)) and got == _pandas(path)
    assert [[(v or "").replace("\r", "") for v in r] for r in got] == [[(v or "").replace("\r", "") for v in r] for r in plain]
    assert cr._lines(spark, path).rdd.getNumPartitions() > 3 or size == 5000


def test_records_of_broken_quoting(spark, small_blocks):
    small_blocks(150)
    for seed in range(4):
        path = _write(_text(seed, 60, broken=True))
        rows = cr.scan(spark, path, OPTIONS).select("row_id").collect()
        with open(path, encoding="utf-8", newline="") as fh:  # pandas refuses a quote that is never closed
            n = sum(1 for r in csv.reader(fh) if r) - 1
        assert sorted(r.row_id for r in rows) == list(range(n)), seed


def test_three_files_a_split_keep_pandas_order(spark, small_blocks):
    folder = tempfile.mkdtemp(prefix="wordloom-order-", dir="/tmp")
    frames = []
    for i in range(3):
        path = os.path.join(folder, f"part-{i}.csv")
        pd.DataFrame({"text": [f"t{i} {k}\nsecond" for k in range(50)], "label": [str(k % 3) for k in range(50)]}).to_csv(path, index=False)
        frames.append(pd.read_csv(path, dtype=str))
    small_blocks(100)
    got = cs.scan_splits(spark, {"train": folder, "val": os.path.join(folder, "part-1.csv")}, row_id="place").orderBy("place").toPandas()
    want = pd.concat([*frames, frames[1]])
    assert got[["text", "label"]].values.tolist() == want.values.tolist()
    assert got["split"].tolist() == ["train"] * 150 + ["val"] * 50


def test_header_only_and_empty_files(spark):
    folder = tempfile.mkdtemp(prefix="wordloom-empty-", dir="/tmp")
    for name, text in (("a.csv", "text,label"), ("b.csv", "text,label\n\n\n"), ("c.csv", '﻿"text",label\nx,"y\nz"')):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    assert [tuple(r) for r in cr.scan(spark, folder, OPTIONS).collect()] == [(0, "x", "y\nz")]
    with pytest.raises(ValueError, match="column text"):
        cr.scan(spark, folder, OPTIONS, row_id="text")


def _automaton(line, inside):
    """The quoting rules character by character."""
    state = "quoted" if inside else "start"
    for ch in line:
        if state == "start":
            state = {'"': "quoted", ",": "start"}.get(ch, "plain")
        elif state == "plain":
            state = "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        else:  # after a quote inside a quoted field
            state = {'"': "quoted", ",": "start"}.get(ch, "plain")
    return int(state == "quoted")


def test_line_states():
    rng = random.Random(1)
    for _ in range(20_000):
        line = "".join(rng.choice('a,""') for _ in range(rng.randrange(12)))
        assert (cr.end_state(line, cr.OUTSIDE), cr.end_state(line, cr.INSIDE)) == (_automaton(line, False), _automaton(line, True)), line


def test_long_lines_with_many_quotes():
    line = '"' + '""x' * 300_000
    assert cr.end_state(line, cr.OUTSIDE) == cr.INSIDE and cr.end_state(line + '"', cr.OUTSIDE) == cr.OUTSIDE
    fields = ",".join(['"a,""b"""'] * 100_000)
    assert cr.end_state(fields, cr.OUTSIDE) == cr.OUTSIDE and cr.end_state(fields + ',"', cr.OUTSIDE) == cr.INSIDE


def test_profile_reads_once(spark):
    rows = [("train", 5, "e"), ("val", 2, None), ("train", 3, "c"), ("train", 9, "z"), ("val", 1, "a"), (None, 7, "n")]
    df = spark.createDataFrame(rows, "split string, row_id long, text string").repartition(4)
    p = cs.split_profile(df)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + p._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    got = {r.split: (r.n_rows, r.column_names, [tuple(h) for h in r["head"]]) for r in p.collect()}
    names = ["split", "row_id", "text"]
    assert got == {"train": (3, names, [(3, "c"), (5, "e")]), "val": (2, names, [(1, "a"), (2, None)]), None: (1, names, [(7, "n")])}


def test_workers_find_the_package_wherever_the_driver_runs():
    path = _write('text,label\n"a\nb",x\n')
    code = (f"import sys; sys.path.insert(0, {TOP!r})\n"
            "from wordloom.session import local_session, ensure_checkpoint_dir\n"
            "from wordloom.sources import csv_splits as cs\n"
            "spark = local_session('1', 1); ensure_checkpoint_dir(spark)\n"
            f"df = cs.scan_splits(spark, {{'train': {path!r}}}, row_id='row_id')\n"
            "print(df.collect() and cs.split_profile(df).first().n_rows)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tempfile.mkdtemp(prefix="wordloom-cwd-", dir="/tmp"), capture_output=True, text=True, check=True)
    assert out.stdout.strip().endswith("1")
