"""Wiki tables row by row, with worked expectations."""

from pairlens.operators.tables import award_rows, cast_lines, ranked_entries


def test_ranked_rows(spark):
    text = (
        "{|\n|-\n!scope=row | 1995\n| [[File:a.jpg]] '''[[Ann One|Ann]]'''\n* <small>2nd: [[Bob Two]]\n* 2nd: [[Late Two]]\n* 3rd: Cid Three</small>\n* 4th: vacant\n* 500th: [[Far Off]]\n* 5th: Dee O’Five\n* 5th: [[Eve Five]]"
        "\n|-\n! 1996\n| [[Image:b.jpg|x]] [[Fay Six]] <ref>2nd: [[Not Here]]</ref>\n|-\n| no year [[Nobody]]\n|-\n! 1997\n| nobody"
    )
    got = ranked_entries(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), 100).collect()
    assert sorted((r.year, r["rank"], r.name, r.linked) for r in got) == [(1995, 1, "Ann One", True), (1995, 2, "Bob Two", True), (1995, 3, "Cid Three", False), (1995, 5, "Eve Five", True), (1996, 1, "Fay Six", True)]
    assert {(r.year, r.rejected, r.beyond) for r in got} == {(1995, 1, 1), (1996, 0, 0)}


def test_award_rows(spark):
    text = (
        '{|\n|-\n| rowspan="2" | {{dts|1993|10|19}}\n| [[Ann One]]\n| 44\n|-\n| [[Bob Two|Bob]]\n| 27\n|-\n| [[No Date]]\n| 30\n|-\n| November 3, 2024\n| Cid Three (2)\n|-\n| 1999\n| see note'
        "\n|-\n| {{dts|2001|2}}\n| {{x}} [[Dee Four]]\n|-\n| Notember 3, 2024\n| [[Eve Five]]\n|-\n| one cell"
    )
    got = award_rows(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).collect()
    assert [(r.value, r.precision, r.year, r.winner, r.status) for r in sorted(got, key=lambda r: r["at"])] == [
        ("1993-10-19", "day", 1993, "Ann One", "linked"), ("1993-10-19", "day", 1993, "Bob Two", "linked"), (None, None, None, None, "no date"),
        ("2024-11-03", "day", 2024, "Cid Three", "unlinked"), ("1999", "year", 1999, None, "no link"), ("2001-02", "month", 2001, "Dee Four", "linked"), (None, None, None, None, "no date"),
    ]


def test_cast_lines(spark):
    text = "== Cast ==\n* [[Ann One]] as '''Mat''' / Dare\n** [[Bob Two|Bob]] as [[Joe (x)|Joe]] (voice)\n* [[File:a.jpg]] as No\n* [[Cid Three]] plays Zed\n* [[Ann One]] as Kit – the second\n* [[Dee Four]] as ,"
    got = cast_lines(spark.createDataFrame([(1, text), (2, None)], "id long, text string")).collect()
    assert sorted((r.actor, r.character) for r in got) == [("Ann One", "Kit"), ("Bob Two", "Joe")]
