from email.message import Message

import pytest
from pyspark.sql import functions as F

from textlode.sources import jsonl as J
from textlode.sources import strict_rows as R
from textlode.sources.strict_rows import FieldRule, check_answers, check_lines, split_rows

COLS = ["id", "text", "label", "start_pos", "end_pos", "confidence", "recorded_at"]
OK = 'a1,"x, ""y""",l,1,2,0.5,2024-02-29T00:00:00Z'


def checked(spark, lines, delimiter=",", cols=COLS):
    df = spark.createDataFrame([(k, "f", x, "kept") for k, x in enumerate(lines)], "row_id int, file_name string, line string, errors_ string")
    src = spark.createDataFrame([("f", delimiter, cols)], "file_name string, delimiter string, header_cols array<string>")
    return check_lines(df, src)


LINES = (
    [
        (OK, []),
        (OK + "\r", []),
        (OK + "\r\r", ["bad_value:recorded_at"]),
        (None, None),
        ("", None),
        ("  \t\r", None),
        ('a1,"x,l,1,2,0.5,2024-02-29T00:00:00Z', ["broken_quoting"]),
        ('a1,x"y,l,1,2,0.5,2024-02-29T00:00:00Z', ["broken_quoting"]),
        ('a1,"x" y,l,1,2,0.5,2024-02-29T00:00:00Z', ["broken_quoting"]),
        ("a1,x,l,1,2,0.5", ["column_count"]),
        (OK + ",", ["column_count"]),
        ('"  ",x,l,1,2,,2024-02-29T00:00:00Z', ["bad_value:id"]),
        ("a1,x,l,,+2,1.01,2023-02-29T00:00:00Z", ["bad_value:start_pos", "bad_value:end_pos", "bad_value:confidence", "bad_value:recorded_at"]),
        ('a1,,,1,"2",1.00,2024-12-31T23:59:59Z', []),
        ("a1,x,l,1,2,1.,2024-12-31T23:59:60Z", ["bad_value:confidence", "bad_value:recorded_at"]),
        ("a1,x,l,1,2,00.0,2024-12-31T24:00:00Z", ["bad_value:recorded_at"]),
        ("a1,x,l,١,2,0,2024-12-31T00:00:00Z", ["bad_value:start_pos"]),
    ]
)


def test_lines(spark):
    got = {r.row_id: r.errors for r in checked(spark, [line for line, _ in LINES]).collect()}
    assert [(line, got[k]) for k, (line, _) in enumerate(LINES)] == LINES


@pytest.mark.parametrize("delimiter", [",", "^", ".", "\\", "]", "-"])
def test_any_delimiter(spark, delimiter):
    values = ["i", f'"t{delimiter}""q"""', "l", "1", "2", "", '"2024-01-01T00:00:00Z"']
    if delimiter in "-.":
        values[6] = '"2024-01-01T00:00:00Z"'
    row = checked(spark, [delimiter.join(values)], delimiter).collect()[0]
    assert (row.errors, row.v_text, row.v_start_pos, row.v_confidence) == ([], f't{delimiter}"q"', 1, None)


def test_typed_rows_and_split(spark):
    good, bad = split_rows(checked(spark, [OK, OK, "x", "", None], None))
    rows = good.collect()
    assert [(r.v_id, r.v_text, r.v_start_pos, r.v_confidence, r.errors_) for r in rows] == [("a1", 'x, "y"', 1, 0.5, "kept")] * 2
    assert [r.errors for r in bad.collect()] == [["column_count"]]
    assert split_rows(checked(spark, []))[1].count() == 0


def test_odd_sources(spark):
    df = spark.createDataFrame([(1, "other", "x"), (2, None, "x")], "row_id int, file_name string, line string")
    src = spark.createDataFrame([("f", ",", COLS)], "file_name string, delimiter string, header_cols array<string>")
    assert {r.row_id: r.errors for r in check_lines(df, src).collect()} == {1: ["unknown_file"], 2: ["unknown_file"]}
    assert checked(spark, [OK], "::").collect()[0].errors in (["column_count"], ["broken_quoting"])


def test_rules_of_other_files(spark, monkeypatch):
    fields = (FieldRule("n", lambda c: c.rlike(r"\A-?[0-9]+\z"), lambda c: c.try_cast("int")), FieldRule("absent", lambda c: c.isNotNull()))
    df = spark.createDataFrame([(1, "f", "7;a;\"b;c\";z"), (2, "f", "x;a;b;z"), (3, "f", "1;;;")], "row_id int, file_name string, line string")
    src = spark.createDataFrame([("f", ";", ["n", "extra", "more", "extra"])], "file_name string, delimiter string, header_cols array<string>")
    for bound in (32, 0):  # patterns compiled once, and built row by row
        monkeypatch.setattr(R, "MAX_DELIMITERS", bound)
        rows = {r.row_id: r for r in check_lines(df, src, fields).collect()}
        assert (rows[1].errors, rows[1].v_n, rows[1].v_absent, rows[1].v_other) == ([], 7, None, {"extra": "z", "more": "b;c"})
        assert rows[2].errors == ["bad_value:n"] and rows[2].v_other is None and rows[3].v_other == {"extra": "", "more": ""}


def test_a_very_long_quoted_field(spark):
    line = 'a1,"' + 'x""' * 300_000 + '",l,1,2,,2024-01-01T00:00:00Z'
    row = checked(spark, [line]).select("errors", F.length("v_text").alias("n")).collect()[0]
    assert (row.errors, row.n) == ([], 600_000)


def test_answers_with_errors(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "oops"), (3, None), (4, "")], "k int, model_output string")
    got = {r.k: r.errors if r.errors is None else len(r.errors) for r in check_answers(df).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: 1}


@pytest.mark.parametrize(
    ("line", "fields"),
    [('1,"hello, world"', ["1", "hello, world"]), ('2,"say ""hi"""', ["2", 'say "hi"']), ("a,,b", ["a", "", "b"]), ('x"y,z"w,1', ["xy,zw", "1"]), ("", [""]), ('"open', ["open"])],
)
def test_csv_fields(line, fields):
    assert J.csv_fields(line, ",") == fields
    assert J.csv_fields(line, "::") == [line.replace('""', "\0").replace('"', "").replace("\0", '"')]


def test_csv_file(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,text\r\n1,"hello, world"\n\n2\n3,\n4,"say ""hi"""  \n')
    assert [tuple(r) for r in J.load_dataset(spark, str(p)).orderBy("id").collect()] == [("1", "hello, world"), ("3", ""), ("4", 'say "hi"')]
    with pytest.raises(ValueError, match="missing"):
        J.load_csv(spark, str(p), "id", "body")
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError, match="Empty"):
        J.load_csv(spark, str(tmp_path / "e.csv"), "id", "text")


def test_jsonl_dataset_keeps_strings_only(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "text": "a"}\n\n{"id": 2, "text": "b"}\n{"id": "3"}\n')
    assert [tuple(r) for r in J.load_dataset(spark, str(p)).collect()] == [("1", "a")]
    p.write_text("broken\n")
    with pytest.raises(Exception, match="not JSON"):
        J.load_dataset(spark, str(p)).collect()
    assert J.dataset_format("x.CSV") == "csv" and J.dataset_format("x") == "jsonl" and J.dataset_format("x.csv", "jsonl") == "jsonl"


def test_annotated_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "text"), ("d2", "none"), ("", "x"), (None, "y")], "document_id string, text string")
    rows = [("d1", "a", "l", 0, 1, 0.5, "match_exact", 1.0, 1, '{"text": "a", "label": "l", "k": [1], "attributes": {"x": "y"}}'), ("d1", "b", "l", -1, -1, None, "odd", None, None, None)]
    ex = spark.createDataFrame(rows, "document_id string, text string, label string, start_pos int, end_pos int, confidence double, alignment_status string, alignment_score double, pass int, raw string")
    path = str(tmp_path / "out")
    J.save_annotated(J.annotated_records(docs, ex), path)
    got = {(r.document_id, r.text): (r.start, r.alignment_status, r.alignment_score, r["pass"], r.attributes) for r in J.load_annotated(spark, path).collect()}
    assert got == {("d1", "a"): (0, "exact", 1.0, 1, '{"attributes": {"x": "y"}, "k": [1]}'), ("d1", "b"): (-1, "fuzzy", 0.0, 0, None), ("d2", None): (None, None, None, None, None)}
    with pytest.raises(ValueError):
        J.save_annotated(J.annotated_records(docs.filter("document_id = ''"), ex), path)


URLS = [("http://a.b", True), (" https://x.y/z?q ", True), ("http://localhost:80/", True), ("http://[::1]/", True), ("http://10.0.0.1", True), ("https://u@h.org:8/p", True), ("ftp://a.b", False), ("http://nodot", False), ("http://a b.c", False), ("http://999.10.10.10", False), ("", False), (None, False), ("text", False), ("http://", False)]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    assert [r[0] for r in df.select(J.is_url("u")).collect()] == [x for _, x in URLS]
    assert [J.is_url_text(u or "") for u, _ in URLS] == [x for _, x in URLS]


def test_urls_are_fetched(spark):
    df = spark.createDataFrame([(1, "http://a.b"), (2, "plain"), (3, None)], "k int, text string")
    got = {r.k: r.text for r in J.resolve_input_text(df, fetcher=lambda u: "body of " + u).collect()}
    assert got == {1: "body of http://a.b", 2: "plain", 3: None}
    assert J.resolve_input_text(df, fetch_urls=False) is df


def test_several_csv_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,one\n2,two\n")
    (tmp_path / "b.csv").write_text("\ntext,id\nthree,3\n")
    got = {(r.id, r.text) for r in J.load_csv(spark, str(tmp_path / "*.csv"), "id", "text").collect()}
    assert got == {("1", "one"), ("2", "two"), ("3", "three")}


def test_fetched_text_has_its_status(monkeypatch):
    class Reply:
        status, headers = 200, Message()

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return "gr\xfcn".encode("latin-1")

    Reply.headers["content-type"] = "text/plain; charset=latin-1"
    seen = {}
    monkeypatch.setattr(J, "urlopen", lambda url, timeout: seen.update(url=url, timeout=timeout) or Reply())
    got = J.fetch_text("http://x.example/a", 3)
    assert got == J.Fetched("http://x.example/a", 200, "text/plain; charset=latin-1", "gr\xfcn") and seen["timeout"] == 3
    Reply.status = 404
    with pytest.raises(OSError, match="HTTP 404"):
        J.fetch_text("http://x.example/a")
