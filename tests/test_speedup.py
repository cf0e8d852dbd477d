"""Speed-up report on a timing log written in the reference's format."""

from treecut.operators.speedup import ENGINES, label_runs, speedup_report, timing_lines
from treecut.operators.stats import RunReport, run_report


def _log(tmp_dir, secs_by_engine):
    lines = [""]
    for engine, secs in secs_by_engine.items():
        lines.append(f".....{engine}.....")
        for s in secs:
            lines += ["files:  1", "read data time    : 0.1", f"time: {s:.3f} secs to tokenize 1048576b, 99kb/s (tokens:1234).",
                      "noise line"]
    path = f"{tmp_dir}/logfile.txt"
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_speedup_report(spark, tmp_dir):
    secs = {e: [10.0 * (i + 1) / (k + 1) for i in range(3)] for k, e in enumerate(ENGINES)}
    path = _log(tmp_dir, secs)
    t = timing_lines(spark, path).collect()
    assert len(t) == 15 and sorted(r.k for r in t) == list(range(15))
    assert all(r.bytes == 1048576 and r.tokens == 1234 for r in t)
    runs = {(r.engine, r.size_mb): r.secs for r in label_runs(timing_lines(spark, path)).collect()}
    assert runs[("baseline", 1)] == 10.0 and runs[("engine_1", 100)] == 15.0
    rep = {(r.engine, r.size_mb): r.speedup for r in speedup_report(spark, path).collect()}
    assert len(rep) == 12
    for k, e in enumerate(ENGINES[1:], start=1):
        for i, mb in enumerate([1, 10, 100]):
            assert abs(rep[(e, mb)] - (k + 1)) < 1e-3   # the log keeps 3 decimals


def test_malformed_timing_line_is_null(spark, tmp_dir):
    path = f"{tmp_dir}/bad.txt"
    with open(path, "w") as f:
        f.write("time: abc secs to tokenize 10b, 1kb/s (tokens:2).\ntime: 1.5 secs to tokenize 10b, 1kb/s (tokens:2).\n")
    rows = sorted((r.k, r.secs) for r in timing_lines(spark, path).collect())
    assert rows == [(0, None), (1, 1.5)]


def test_run_report_line(spark):
    df = spark.createDataFrame([(1, "They'll save and invest more."), (2, "hi, my name can't hello,")],
                               "doc_id int, text string")
    rep = run_report(df)
    assert (rep.files, rep.tokens) == (2, 15)
    assert rep.bytes == len("They'll save and invest more.") + len("hi, my name can't hello,")
    line = RunReport(seconds=2.0, bytes=2048, tokens=7, files=1).line()
    assert line == "time: 2.000 secs to tokenize 2048b, 1kb/s (tokens:7)."


def test_lines_split_at_any_white_space(spark, tmp_dir):
    with open(f"{tmp_dir}/log", "w", encoding="utf-8", newline="") as f:
        f.write("\ttime: 1.5 secs to tokenize 10b, 1kb/s (tokens:3).\ntime: 9.0 secs to\r\ntime: 2.5 secs to tokenize 20b, 1kb/s (tokens:4).\r\ntime: a b c d\nxtime: 1 2 3 4\n")
    rows = timing_lines(spark, tmp_dir).orderBy("k").collect()
    assert [(r.k, r.secs, r.bytes, r.tokens) for r in rows] == [(0, 1.5, 10, 3), (1, 2.5, 20, 4), (2, None, None, None)]
