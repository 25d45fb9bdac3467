import re
import unicodedata
from collections import Counter, defaultdict

import __spark_entry__
from textlode.core.session import table
from textlode.sources.jsonl import is_url_text

SMALL = "/root/testdata/sf0.001"


def run(spark, name, folder=SMALL):
    return __spark_entry__.queries()[name](spark, str(folder))


def csv_row(line, delimiter, header, id_key, text_key):
    """(id, text) of a line, read character by character; none where a column is missing."""
    line, fields, quoted, k = line.rstrip(), [""], False, 0
    while k < len(line):
        if line[k] == '"' and quoted and line[k + 1 : k + 2] == '"':
            fields[-1] += '"'
            k += 1
        elif line[k] == '"':
            quoted = not quoted
        elif line[k] == delimiter and not quoted:
            fields.append("")
        else:
            fields[-1] += line[k]
        k += 1
    i, t = header.index(id_key), header.index(text_key)
    return (fields[i], fields[t]) if line and max(i, t) < len(fields) else None


def test_all_lines_of_datasets(spark, tmp_path):
    lines = ["a,x", 'b,"x, ""y"""', '"c,1",z\r', "d,blank\xa0", "e", " ", 'f,"open, to the end', 'g,"",h']
    rows = [(k, "f", line) for k, line in enumerate(lines)]
    spark.createDataFrame([*rows, rows[1]], "row_id bigint, file_name string, line string").write.parquet(f"{tmp_path}/csv_rows.parquet")
    spark.createDataFrame([("f", None, "id", "text", ["id", "text"])], "file_name string, delimiter string, id_key string, text_key string, header_cols array<string>").write.parquet(f"{tmp_path}/csv_sources.parquet")
    got = {r.row_id: (r.id, r.text) for r in run(spark, "q_csv_dataset", tmp_path).collect()}
    assert got == {0: ("a", "x"), 1: ("b", 'x, "y"'), 2: ("c,1", "z"), 3: ("d", "blank"), 6: ("f", "open, to the end"), 7: ("g", "")}


def test_all_lines_of_the_test_data(spark):
    sources = {r.file_name: (r.delimiter or ",", r.header_cols, r.id_key, r.text_key) for r in table(spark, SMALL, "csv_sources").collect()}
    slow = {r.row_id: csv_row(r.line, *sources[r.file_name]) for r in table(spark, SMALL, "csv_rows").collect()}
    got = sorted((r.row_id, (r.id, r.text)) for r in run(spark, "q_csv_dataset").collect())
    assert got == sorted((k, v) for k, v in slow.items() if v)


def kind(c):
    k = unicodedata.category(c)[0]
    return "blank" if c in "\ufeff" or c.isspace() and c not in "\x1c\x1d\x1e\x1f\x85" else {"L": "word", "M": "word", "N": "number"}.get(k, c)


def slow_tokens(text):
    """(type, start, end, after_newline), read character by character."""
    out, blank = [], ""
    for k, c in enumerate(text):
        if kind(c) == "blank":
            blank += c
        elif out and not blank and kind(c) == kind(text[k - 1]):
            out[-1][2] += 1
        else:
            out.append([{"word": 0, "number": 1}.get(kind(c), 2), k, k + 1, bool(out) and ("\n" in blank or "\r" in blank)])
        blank = blank if kind(c) == "blank" else ""
    return [tuple(x) for x in out]


def grouped(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r.document_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_tokens_of_all_documents(spark):
    texts = {r.id: r.text for r in table(spark, SMALL, "input_docs").collect()}
    got = grouped(run(spark, "q_tokens").collect(), "idx", "token_type", "start_pos", "end_pos", "after_newline")
    assert got == {k: [(n, *x) for n, x in enumerate(slow_tokens(t))] for k, t in texts.items() if t and t.strip("\ufeff \n\t\r\xa0\u3000")}
    given = {r.document_id: [tuple(x) for x in r.tokens] for r in table(spark, SMALL, "tokenized_texts").filter("size(tokens) > 0").collect()}
    assert given and {k: got[k] for k in given} == given and len(got) > 2 * len(given)


def test_sentences_of_all_documents(spark):
    tokens = grouped(run(spark, "q_tokens").collect(), "idx", "start_pos", "end_pos")
    got = grouped(run(spark, "q_sentences").collect(), "sentence_no", "start_tok", "end_tok", "start_pos", "end_pos")
    assert got.keys() == tokens.keys()
    for k, rows in got.items():
        own = tokens[k]
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [r[1] for r in rows] == [0, *(r[2] for r in rows[:-1])] and rows[-1][2] == len(own)
        assert all((a, b) == (own[i][1], own[j - 1][2]) for _, i, j, a, b in rows)


def fold(w):
    w = w.lower()
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def slow_issue(source, text):
    """How an example fails the alignment, every run of words tried; none where it stands in its source, case aside."""
    x = text.strip()
    if not x:
        return "failed"
    if x.lower() in source.lower():
        return None
    bare = re.sub("[^A-Za-z0-9]", "", x).lower()
    if bare and bare in re.sub("[^A-Za-z0-9]", "", source).lower():
        return "non_exact"
    words, want = [fold(w) for w in re.findall("[A-Za-z0-9]+", source)], Counter(fold(w) for w in re.findall("[A-Za-z0-9]+", x))
    n = want.total()
    sizes = range(max(1, n - 2), n + 3) if n else []
    hit = any((want & Counter(words[k : k + m])).total() / max(n, m) >= 0.75 for m in sizes for k in range(len(words) - m + 1))
    return "non_exact" if hit else "failed"


def test_all_examples_are_aligned(spark, tmp_path):
    source = "Open AI builds large models in Paris."
    texts = ["Paris", "openai", "builds big large models in", "Rome", "--", " ", "large models"]
    rows = [(k, 1, x, " Org " if k % 2 else "verb") for k, x in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], "extraction_id bigint, resolve_id bigint, text string, label string").write.parquet(f"{tmp_path}/extractions.parquet")
    spark.createDataFrame([(1, source)], "resolve_id bigint, source_text string").write.parquet(f"{tmp_path}/resolve_inputs.parquet")
    got = {r.label: (r.n, r.n_failed, r.n_non_exact) for r in run(spark, "q_example_alignment", tmp_path).collect()}
    assert got == {"verb": (4, 1, 1), "org": (3, 2, 1)}


def test_all_examples_of_the_test_data(spark):
    sources = {r.resolve_id: r.source_text for r in table(spark, SMALL, "resolve_inputs").collect()}
    slow = defaultdict(Counter)
    for r in table(spark, SMALL, "extractions").select("extraction_id", "resolve_id", "text", "label").distinct().collect():
        if r.resolve_id in sources:
            slow[r.label.strip(" ").lower()].update(["n", slow_issue(sources[r.resolve_id], r.text)])
    got = {r.label: (r.n, r.n_failed, r.n_non_exact) for r in run(spark, "q_example_alignment").collect()}
    assert got == {k: (c["n"], c["failed"], c["non_exact"]) for k, c in slow.items()}
    assert sum(x[2] for x in got.values()) > 0


def test_all_words_are_judged(spark, tmp_path):
    text = "See HTTP://A.B/c and ftp://a.b or https://bücher.de/x, a/b, 12:30, http://nodot/x and http://localhost:80/ twice 12:30"
    spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.word, r.is_url) for r in run(spark, "q_is_url", tmp_path).collect())
    assert got == sorted([("HTTP://A.B/c", True), ("ftp://a.b", False), ("https://bücher.de/x,", True), ("a/b,", False), ("12:30,", False), ("12:30", False), ("http://nodot/x", False), ("http://localhost:80/", True)])


def test_all_words_of_the_test_data(spark):
    texts = [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    words = {w for t in texts if t for w in re.findall(r"[^ \t\n\x0b\f\r]*[:/][^ \t\n\x0b\f\r]*", t)}
    got = [(r.word, r.is_url) for r in run(spark, "q_is_url").collect()]
    assert sorted(got) == sorted((w, is_url_text(w)) for w in words)
    assert any(not w.startswith("http") for w, _ in got)


def test_dates_are_records_of_the_pipeline(spark, tmp_path):
    far = "On 2024-01-02 it began. " + "Nothing else was written down. " * 60 + "On 2024-01-02 it ended."
    rows = [("far", far), ("near", "From 2024-01-02 to 2024-01-02."), ("two", "2024-01-02, 2024-03-04"), ("none", None)]
    df = spark.createDataFrame([(k, t, {}) for k, t in rows], "id string, text string, metadata map<string,string>")
    df.write.parquet(f"{tmp_path}/input_docs.parquet")
    got = sorted(tuple(r) for r in run(spark, "q_extract_dates", tmp_path).collect())
    assert got == [("far", "2024-01-02"), ("far", "2024-01-02"), ("near", "2024-01-02"), ("two", "2024-01-02"), ("two", "2024-03-04")]


def test_dates_of_the_test_data(spark):
    texts = {r.id: r.text for r in table(spark, SMALL, "input_docs").select("id", "text").collect()}
    want = sorted((k, x) for k, t in texts.items() if t for x in re.findall(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", t, re.ASCII))
    assert sorted(tuple(r) for r in run(spark, "q_extract_dates").collect()) == want
