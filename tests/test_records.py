import csv
import io
import random

import pytest

from tallyspark.plans.sources import q_csv_quoted_breaks
from tallyspark.sources import tables
from tallyspark.sources.records import csv_lines, csv_records, state_behind


def drawn(seed, rows, sep=",", end="\n"):
    """CSV text with quoted breaks, quotes inside bare cells, doubled quotes and blank lines."""
    draw, out = random.Random(seed), io.StringIO()
    out.write(sep.join(["id", "note", '"more\nwords"', "last"]) + end)
    for i in range(rows):
        cells = [str(i)]
        for _ in range(3):
            kind = draw.randrange(8)
            word = "".join(draw.choice("abc xyz") for _ in range(draw.randint(1, 30))).strip() or "w"
            cells.append([word, f'5{word}" pipe', f'"{word}"', f'"{word}{end}{word}"', f'"say ""{word}"" {sep} so"',
                          f'"{end}{end}""{end}{word}"', f'"{word}{end},""x"', f"{word}{draw.randint(0, 9)}"][kind])
        out.write(sep.join(cells) + end)
        if draw.random() < 0.05:
            out.write(end)
    return out.getvalue()


def by_reader(text, sep=","):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return sorted(tuple(r) for r in rows[1:])


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n")])
def test_many_ranges_equal_the_reader(spark, tmp_path, sep, end):
    text = drawn(1, 600, sep, end)
    for name, part in (("a.csv", text), ("b.csv", drawn(2, 50, sep, end))):
        (tmp_path / name).write_bytes(part.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = tables.read_csv_text(spark, str(tmp_path), sep=sep)
        lines = csv_lines(spark, str(tmp_path), sep, '"')
        assert lines.select("file", "start").distinct().count() > 20
        assert got.columns == ["id", "note", "more\nwords", "last"]
        want = sorted(by_reader(text, sep) + by_reader(drawn(2, 50, sep, end), sep))
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_behind_a_line():
    for line, inside, want in [("a,b", False, False), ('a,"b', False, True), ('a"b', False, False), ('a,b"c', False, False), ('"a""', False, True),
                               ('"a"",', False, True), ('"a",b', False, False), ("a", True, True), ('a"', True, False), ('a",b,"c', True, True),
                               ('""', True, True), ('"a"x"y,"z', False, True), ("", False, False), ("", True, True), ('","', False, False)]:
        assert state_behind(line, inside, ",", '"') is want, (line, inside)


def test_an_open_quote_and_another_header_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,note\n1,"never closed\n' + "2,x\n" * 100)
    lines = csv_lines(spark, str(tmp_path / "open.csv"), ",", '"')
    with pytest.raises(ValueError, match="never closed"):
        csv_records(lines, longest=200)
    assert csv_records(lines).count() == 2
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text('id,note\n1,"x\ny"\n')
    (tmp_path / "two" / "b.csv").write_text('id,other\n1,"x\ny"\n')
    with pytest.raises(Exception, match="header"):
        tables.read_csv_text(spark, str(tmp_path / "two")).collect()


def test_long_rows_and_code_pages(spark, tmp_path):
    (tmp_path / "long.csv").write_text('id,note\n1,"a\nb",c\n2,d\n3\n')
    kept = tables.read_csv_text(spark, str(tmp_path / "long.csv"), keep_extra=True)
    assert [r["_extra"] for r in tables.rejected_rows(kept).collect()] == ['1,"a\nb",c']
    assert {r["id"]: r["note"] for r in kept.collect()}["3"] is None
    (tmp_path / "old.csv").write_bytes('id,note\n1,"André\n€"\n'.encode("cp1252"))
    assert tables.read_csv_text(spark, str(tmp_path / "old.csv"), encoding="cp1252").first()["note"] == "André\n€"
    (tmp_path / "marked.csv").write_bytes('id,note\n1,"x\ny"\n'.encode("utf-8-sig"))
    assert tables.read_csv_text(spark, str(tmp_path / "marked.csv"), encoding="utf-8-sig").first()["note"] == "x\ny"


@pytest.mark.parametrize("breaks", [True, False])
def test_texts_come_back_as_they_were(spark, tmp_path, breaks):
    """Null is not empty, a mark behind a line break and zero bytes beside quotes stay; with and without line breaks."""
    texts = [None, "", " ", "null", '"', '""', "\\", ",", '","', "a\rb", "\r", "\ufeffx", "\x00", 'a"\x00', '\x00"', '\x00\x00""\x00"', " a "]
    texts += ["\n", "\r\n", "x\n\ufeffy", '"\n', '\n"', '",\n"', 'a"\x00\n', "\n\n\ufeff\n"] if breaks else []
    texts = texts if breaks else [t for t in texts if "\r" not in (t or "")]
    rows = [(i, t, [None, "", "en"][i % 3], ["", None][i % 2], len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in q_csv_quoted_breaks(spark, str(tmp_path)).collect()}
    assert got == {(str(i), t, lang, source, n if n is None else str(n)) for i, t, lang, source, n in rows}
