"""Files dealt out in small blocks against Python's own reader of the whole file."""

import csv
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.sources import records
from themeloom.sources.csv_tables import read_codeframe_single, read_responses, read_table


@pytest.fixture
def blocks_of(spark):
    """Blocks of so many bytes, as a file of many gigabytes has them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]

    def cut(n):
        for name in names:
            spark.conf.set(name, n)

    yield cut
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows_in(spark, path, **options):
    df = read_table(spark, str(path), **options).orderBy("_file", "_block", "_line")
    return [tuple(r)[:-3] for r in df.collect()]


def random_cell(rng):
    longest = rng.choice([3, 3, 10, 400 if rng.random() < 0.05 else 20])
    return "".join(rng.choice("ab\"',\n\r\t #é€;0") for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize("block, seed, encoding", [(40, 1, "utf-8"), (64, 2, "cp1252"), (200, 3, "utf-8"), (1 << 20, 4, "utf-8")])
def test_random_cells_over_blocks(spark, tmp_path, blocks_of, block, seed, encoding):
    blocks_of(block)
    rng = random.Random(seed)
    rows = [("id", "two\nlines", "r")] + [(str(k), random_cell(rng), random_cell(rng)) for k in range(100)]
    text = io.StringIO()
    csv.writer(text, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
    (tmp_path / "a.csv").write_bytes(text.getvalue().encode(encoding))
    if block < 100:  # A header has to end in its first block.
        rows[0] = ("id", "q", "r")
        text = io.StringIO()
        csv.writer(text).writerows(rows)
        (tmp_path / "a.csv").write_bytes(text.getvalue().encode(encoding))
    df = read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == [*rows[0], "_file", "_block", "_line"]
    assert rows_in(spark, tmp_path / "a.csv") == [(i, *(cell or None for cell in cells)) for i, *cells in rows[1:]]
    if block < 1000:
        parts = df.select("_block").distinct().count()
        assert parts > 10


def test_quotes_within_open_cells_are_letters(spark, tmp_path, blocks_of):
    """What a count of quotes would take for the start of a cell."""
    blocks_of(32)
    text = 'id,r\n1,5" pipe\n2,"a\n""b\nc",\n3,it\'s 6"" wide\n4,"x\ny" tail\n5,say "hi\n6,""\n7,"""\n"""\n'
    (tmp_path / "q.csv").write_text(text)
    got = rows_in(spark, tmp_path / "q.csv")
    want = [tuple(cell or None for cell in row[:2]) for row in list(csv.reader(io.StringIO(text)))[1:]]
    assert [r for r in got if r[0] != "4"] == [r for r in want if r[0] != "4"] and [r[0] for r in got] == [r[0] for r in want]


def test_lines_as_records_on_demand(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,r\n1,"open\n2,x\n')
    assert [r[0] for r in rows_in(spark, tmp_path / "q.csv", multi_line=False)] == ["1", "2"]


def test_a_cell_longer_than_many_blocks(spark, tmp_path, blocks_of):
    blocks_of(100)
    long = "line with \"quotes\", commas\n" * 40
    rows = [("id", "r"), ("1", "a"), ("2", long), ("3", "b\nc"), ("4", long[:-1])]
    with open(tmp_path / "l.csv", "w", newline="") as file:
        csv.writer(file).writerows(rows)
    assert rows_in(spark, tmp_path / "l.csv") == rows[1:]


def test_mixed_files_are_each_opened_once(spark, tmp_path, blocks_of):
    blocks_of(80)
    files = {
        "a.csv": ("utf-8", ["id", "r", "q"]), "b.csv": ("cp1252", ["q", "id", "r"]), "c.csv": ("utf-16", ["r", "id", "q"]),
        "d.csv": ("utf-8-sig", ["id", "q", "r"]), "e.csv": ("utf-8", ["id", "r", "q"]), "f.csv": ("utf-16", ["id", "r", "q"]),
    }
    want = []
    for k, (name, (encoding, columns)) in enumerate(files.items()):
        rows = [{"id": f"{k}-{n}", "r": f"é {n}\nnächste", "q": "x" * n} for n in range(1, 9)]
        with open(tmp_path / name, "w", newline="", encoding=encoding) as file:
            writer = csv.DictWriter(file, columns)
            writer.writeheader()
            writer.writerows(rows)
        want += [(r["id"], r["r"], r["q"]) for r in rows]
    df = read_responses(spark, str(tmp_path))
    assert df.columns == ["id", "r", "q"] and sorted(map(tuple, df.collect())) == sorted(want)
    run = df._jdf.queryExecution()
    run.toRdd().count()
    scans = [scan for scan in _scans(run.executedPlan()) if "CSV" in scan.relation().fileFormat().toString()]
    # Records of the four are written when they are cut; the wide files are left, one for each order of columns.
    assert [scan.metrics().apply("numFiles").value() for scan in scans] == [1, 1]


def _scans(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _scans(plan.plan())
    if name == "FileSourceScanExec":
        return [plan]
    children = plan.children()
    return [scan for k in range(children.size()) for scan in _scans(children.apply(k))]


def test_the_last_of_equal_keys_over_blocks(spark, tmp_path, blocks_of):
    blocks_of(50)
    rng = random.Random(9)
    rows = [(f"k{rng.randrange(30)}", f"v\n{k}") for k in range(80)]
    with open(tmp_path / "k.csv", "w", newline="") as file:
        csv.writer(file).writerows([("key", "value"), *rows])
    assert {r.response: r.category for r in read_codeframe_single(spark, str(tmp_path / "k.csv")).collect()} == dict(rows)


def test_states_of_lines():
    rng = random.Random(2)
    for _ in range(300):
        turns = np.array(rng.choices(range(4), weights=[5, 2, 1, 1], k=rng.randrange(20)), dtype=np.int8)
        for start in (False, True):
            state, want = start, []
            for turn in turns.tolist():
                state = {records.KEEP: state, records.TURN: not state, records.OUTSIDE: False, records.INSIDE: True}[turn]
                want.append(state)
            assert records.states(turns, start).tolist() == want


def test_header_names():
    assert records.header_names('id,"a ""b"", c",,x,X') == ["id", 'a "b", c', "_c2", "x3", "X4"]


def test_a_lost_block_is_an_error(spark, tmp_path, blocks_of):
    (tmp_path / "a.csv").write_text('id,r\n' + '1,"a\nb"\n' * 50)
    blocks_of(60)
    found = records.materialize(records.survey_blocks(spark, str(tmp_path)), "blocks")
    blocks_of(90)
    with pytest.raises(Exception, match="dealt out differently"):
        records.split_records(spark, str(tmp_path), found).collect()


def test_wide_files_do_not_move_the_blocks_of_the_others(spark, tmp_path):
    """Blocks are sized by the bytes of all files, where no other limit holds."""
    rows = [(str(k), f"é {k}\nnächste") for k in range(4_000)]
    for name, encoding, copies in (("a.csv", "utf-8", 1), ("b.csv", "utf-16", 4)):
        with open(tmp_path / name, "w", newline="", encoding=encoding) as file:
            writer = csv.writer(file)
            writer.writerows([("id", "r"), *rows * copies])
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, 1_000)
    try:
        got = read_responses(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == sorted(rows * 5)


def test_ends_of_a_record_are_cut_without_reading_it(spark):
    """One return behind and one mark in front go, and no expression runs over the whole record for that."""
    mark = "\ufeff"
    cut = {"a\r": "a", "a\r\r": "a\r", f"{mark}a": "a", f"{mark}{mark}a\r": f"{mark}a", f"a{mark}": f"a{mark}", "\ra": "\ra",
           f"{mark}\r": "", "\r": "", "": "", None: None, f"é\U0001f600{mark}\r": f"é\U0001f600{mark}"}
    rows = spark.createDataFrame([(text,) for text in cut], "text string").select("text", records._record(F.col("text")).alias("cut"))
    assert {r.text: r.cut for r in rows.collect()} == cut
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
