import random
import re

import pytest

from clonoforge.operators.packed import Grammar, split_packed

CASES = [
    ("CAM;NA", ["CAM", "NA"]), ('["A", "B"]', ["A", "B"]), ("{A,B}", ["A", "B"]), (";A; ;B;", ["", "A", "", "B", ""]),
    ("TRAV1-1 / TRAV6/DV4", ["TRAV1-1", "TRAV6/DV4"]), ('"TRAV6,DV4";TRAV1', ["TRAV6,DV4", "TRAV1"]), ("A  B C", ["A", "B", "C"]),
    ("A\tB\nC", ["A", "B", "C"]), (" A ", ["A"]), ("'A','B'", ["A", "B"]), ("A；B", ["A", "B"]), ('"A""B",C', ['A"B', "C"]), ("", [""]), ("A+B_C&D|E", list("ABCDE")),
]


@pytest.mark.parametrize("text,items", CASES)
def test_grammar(text, items):
    assert [x for x, _ in Grammar().parse(text)] == items


@pytest.mark.parametrize("text,items,flag", [('"A;B', ["A", "B"], "quote"), ('"A"x;B', ['A"x', "B"], "quote"), ("[A;B", ["A", "B"], "bracket"), ("A]", ["A"], "bracket")])
def test_malformed_backtracks_to_bare(text, items, flag):
    found = Grammar().parse(text)
    assert [x for x, _ in found] == items and found[0][1] == flag


def test_against_brute_force():
    rng = random.Random(5)
    grammar = Grammar()
    for _ in range(500):
        mark = rng.choice(";|,")
        items = [rng.choice(["CASSF", "CAWSF", "", "NA"]) for _ in range(rng.randint(1, 6))]
        text = mark.join(rng.choice(["{}", " {}", "{} "]).format(x) if x else x for x in items)
        assert [x for x, _ in grammar.parse(text)] == [p.strip() for p in re.split(re.escape(mark), text)], text


def test_frames(spark):
    rows = [(1, "A;B", None, 7), (1, "A;B", "", 7), (2, None, "NA", 8), (3, "C", "D", 9), (4, "E" * 200_000 + ";F", "x", 1)]
    df = spark.createDataFrame(rows, "id int, a string, field string, pos int")
    out = split_packed(df, ["a", "field"], ["id", "pos"], least=2)
    assert out.columns == ["id", "pos", "field", "_pos", "item", "error"]
    assert sorted((r.id, r.field, r["_pos"], r["item"][:3]) for r in out.collect()) == [(1, "a", 1, "A"), (1, "a", 1, "A"), (1, "a", 2, "B"), (1, "a", 2, "B"), (4, "a", 1, "EEE"), (4, "a", 2, "F")]
    assert split_packed(df, ["a", "field"], ["id"]).filter("id = 3").count() == 2
    assert split_packed(df.limit(0), ["a"], ["id"]).count() == 0
