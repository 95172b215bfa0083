import csv
import io
import random
import time
from itertools import chain

from clonoforge.operators.badrows import HEADER_BYTES, Layout, assemble, faulty_lines, header_separator, loaded_lines, parse_chain_lines, parse_strict, read_chain_text

HEADER = "CDR3b,TRBV,CDR3a,subject:condition,count"
LINES = [
    ("CASSF,TRBV1,CAF,S1:x,2", None), ('"CASSF",TRBV1,,"S1:so ""mild""",', None), ('CASSF,"TRBV1,CAF,S1:x,2', "quoting"), ('CASSF,"TRBV1"x,CAF,S1:x,2', "quoting"),
    ("CASSF,TRBV1,CAF,S1:x", "columns"), ("NA,TRBV1,CAF,S1:x,2", "beta"), ("CASXF,TRBV1,CAF,S1:x,2", "beta"), ("cassf,TRBV1,CA1,S1:x,2", "alpha"), ("CASSF,TRBV1,na,S1:x,-1", "counts"),
    ("CASSF,TRBV1,CAF,S1:x,1e999", "counts"), ("CASSF,TRBV1,CAF,S1:x,1_0", "counts"), ("CASSF,TRBV1,CAF,S1 x,2", "subject"), ("CASSF,TRBV1,CAF,: x,2", "subject"), ("CASSF,TRBV1,CAF,S:a:b,+2\r", None),
    ("﻿CASSF,TRBV1,CAF,S:a,", None), ("CASSF,TR\rBV,CAF,S:a,1", None),
]


def test_reasons():
    layout = Layout("﻿" + HEADER + "\r")
    from clonoforge.operators.badrows import strip_line

    for line, reason in LINES:
        assert layout.record(strip_line(line))[0] == reason, line


def test_frames(spark):
    rows = [(0, "f", 1, HEADER, "e")] + [(k + 1, "f", k + 2, line, "e") for k, (line, _) in enumerate(LINES)]
    rows += [(100, "f", 90, "  ", "e"), (101, "f", 91, None, "e"), (102, "g", 2, "CASSF,1", "e"), (103, None, 2, "x", "e")]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string, reason string")
    parsed = parse_chain_lines(df)
    assert {r.line_id: r.reason for r in faulty_lines(parsed).collect()} == {k + 1: reason for k, (_, reason) in enumerate(LINES) if reason} | {102: "columns", 103: "columns"}
    good = {r.line_id: r for r in loaded_lines(parsed).collect()}
    assert good[1].beta == "CASSF" and good[1].counts == 2.0 and good[2].condition == 'so "mild"' and good[2].counts == 1.0 and good[14].condition == "a:b"
    assert parse_chain_lines(df.limit(0)).count() == 0


def test_separator_and_assembly():
    assert header_separator('"a;b"|c|d') == "|"
    assert list(assemble(['a,"b', 'c",d', "e"])) == ['a,"b\nc",d', "e"]
    assert list(assemble(['a,"b', "c"])) == ['a,"b', "c"]
    assert list(assemble(['a,"broken', 'b,"ok"', 'c,"two', 'lines"', "d"])) == ['a,"broken', 'b,"ok"', 'c,"two\nlines"', "d"]
    assert list(assemble(['a,"say ""x', 'y"" now"', 'p"q,"r"'])) == ['a,"say ""x\ny"" now"', 'p"q,"r"']
    assert list(assemble(['a,"b', "c,d", 'e,f"', "g,h"], ",", 2)) == ['a,"b\nc,d\ne,f"', "g,h"]
    assert list(assemble(['a,"b', "c,d", 'e",f', "g,h"], ",", 2)) == ['a,"b', "c,d", 'e",f', "g,h"]  # three fields: the quote was broken
    assert list(assemble(['a|"b', 'c"|d'], "|", 3)) == ['a|"b\nc"|d'] and list(assemble([])) == []
    assert list(assemble(['a,"' + "x" * 50, "y" * 50, 'z"'], most=60)) == ['a,"' + "x" * 50, "y" * 50, 'z"']


def test_assembly_is_linear_and_agrees_with_the_csv_reader():
    def took(n):
        began = time.process_time()
        assert sum(1 for _ in assemble(chain(['a,"open'], ("b,c" for _ in range(n))))) == n + 1
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 12 * max(took(100_000), 0.02)
    rng = random.Random(3)
    for _ in range(300):
        rows = [[rng.choice(["a", "x,y", "two\nlines", 'q"q', "", "l\n\nm"]) for _ in range(3)] for _ in range(rng.randint(1, 6))]
        held = io.StringIO()
        csv.writer(held, lineterminator="\n").writerows(rows)
        assert [parse_strict(r, ",") for r in assemble(held.getvalue().removesuffix("\n").split("\n"), ",", 3)] == rows


def test_raw_files_and_large_headers(spark, tmp_path):
    (tmp_path / "f.csv").write_text(HEADER + '\r\nCASSF,TRBV1,CAF,"S1:so\nmild",2\r\nCASSF,"TRBV1,CAF,S1:x,2\nCASSF,TRBV1,CAF,"S2:y",3\n\n')
    (tmp_path / "empty.csv").write_text("")
    got = [(r.record_no, r.reason, r.condition) for r in read_chain_text(spark, str(tmp_path)).orderBy("record_no").collect()]
    assert got == [(1, None, "so\nmild"), (2, "quoting", None), (3, None, "y")]
    rows = [(0, "f", 1, HEADER)] + [(k + 1, "f", k + 2, line) for k, (line, _) in enumerate(LINES)] + [(50, "f", 60, 'CASSF,TRBV1,CAF,"S1:so\nmild",2')]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, line string")
    few, many = (sorted((r.line_id, r.reason or "", r.condition or "") for r in parse_chain_lines(df, header_bytes=n).collect()) for n in (HEADER_BYTES, -1))
    assert few == many and (50, "", "so\nmild") in few
