"""Line dedup: short units, scripts without spaces, lines shared with several documents."""

from reachlight.llm import line_dedup


def deduped(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_short_units(spark):
    short = " ".join(f"Wo{i} rd{i}." for i in range(40))
    kana = "".join(f"これは第{i}番目の文章であり、重複を調べる。" for i in range(12))
    mixed = "\n".join(f"A line of five words {i}.\nOh.\nNo{i}.\nWell." for i in range(8))
    got = deduped(spark, [(1, short), (2, short), (3, kana), (4, kana), (5, mixed), (6, f"Mine {mixed}\nown end")])
    assert set(got) == {1, 3, 5, 6}
    assert "A line of five words 7" not in got[6] and "Well" not in got[6] and "own end" in got[6] and "Mine A line" in got[6]


def test_lines_first_seen_elsewhere(spark):
    lines = [f"line {k} has exactly six words." for k in range(10)]
    rows = [(k, f"Start {k} is here.\n{x}\nOther end {k}.") for k, x in enumerate(lines[::2])]
    got = deduped(spark, rows + [(20, "\n".join(lines)), (21, "Head of it.\n" + "\n".join(lines) + "\nTail of it."), (22, "\n".join(lines[:4]))])
    assert got[20] == "\n".join(lines) and got[22] == "\n".join(lines[:4])
    assert "exactly six" not in got[21] and "Head of it." in got[21] and "Tail of it." in got[21]


def test_one_changed_line_between(spark):
    lines = [f"line {k} has exactly six words." for k in range(8)]
    got = deduped(spark, [(1, "\n".join(lines)), (2, "\n".join([*lines[:4], "changed.", *lines[5:]]))])
    assert got[2].split() == ["changed."]


def test_repeated_line_in_passage(spark):
    lines = [x for k in range(6) for x in (f"line {k} has exactly six words.", "The same line each time.")]
    assert set(deduped(spark, [(1, "\n".join(lines)), (2, "\n".join(lines))])) == {1}
