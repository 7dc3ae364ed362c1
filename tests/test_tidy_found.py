"""Blocks are tidied whole: documents without a result are read again for dashes without blanks."""

from mixframe.operators import detect
from mixframe.plans import fixtures


def _lines(spark, docs):
    rows = [(doc, i, raw) for doc, text in docs for i, raw in enumerate(text)]
    return spark.createDataFrame(rows, "doc_id int, line_no int, raw string")


def test_tight_dashes_get_a_second_pass(spark):
    spaced = ["1. Aaa – Bbb", "2. Ccc - Ddd", "3. Eee - Fff", "4. Ggg - Hhh"]
    tight = ["Aaa-Bbb Cc", "Ddd-Eee Ff", "Ggg-Hhh Ii", "Jjj-Kkk Ll"]
    prose = ["Live at Berlin-Mitte", "Recorded in Baden-Baden", "with Jean-Luc", "and Ann-Sophie"]
    got = {}
    # a document without an id is one document, whose tight lines stay as they are beside its result
    for r in detect.tidy_found(_lines(spark, [(1, spaced), (2, tight), (3, prose), (None, [*spaced, *tight])])).collect():
        got.setdefault(r.doc_id, {})[r.line_no] = r.line
    first = ["1. Aaa - Bbb", *spaced[1:]]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {
        1: first, 2: ["Aaa - Bbb Cc", "Ddd - Eee Ff", "Ggg - Hhh Ii", "Jjj - Kkk Ll"], None: first}


def test_query_reads_what_is_left_again(spark, monkeypatch):
    """The registered query gives the lines that only the second pass finds."""
    from mixframe.plans import all_queries

    tight = [f"{a}aa-{a}bb Cc" for a in "ABCDE"]
    monkeypatch.setattr(fixtures, "v_lines", lambda spark, sf: _lines(spark, [(1, tight)]))
    monkeypatch.setattr(fixtures, "longest_mix", lambda spark, sf: 10)
    assert [r.line for r in all_queries()["tidy_blocks"](spark, "").orderBy("line_no").collect()] == [t.replace("-", " - ") for t in tight]
