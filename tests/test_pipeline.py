import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textlode.core.errors import InferenceConfigError, InvalidDocumentError, PromptAlignmentError, PromptTemplateError, error_code
from textlode.core.session import small
from textlode.functions.register import register
from textlode.operators import merge as M
from textlode.operators import model as models
from textlode.operators import prompts as P
from textlode.operators import viz as V
from textlode.operators.candidates import Resolver
from textlode.operators.tokens import chunk_views, chunks_of, document_id, random_document_id
from textlode.plans import pipeline as pl
from textlode.plans.progress import Watch, wants_line
from textlode.sources import jsonl
from textlode.streaming.extract import extract_stream, stream_documents

FIELDS = "document_id string, label string, text string, start_pos int, end_pos int, confidence double, alignment_status string, pass int, seq int"


def find(*pairs):
    """A model that reports the (text, label) pairs that its prompt's input holds."""

    def generate(prompt, settings):
        text = prompt.split("\nInput text:\n")[1].split("\n\nReturn")[0]
        return json.dumps({"extractions": [{"text": t, "label": x} for t, x in pairs if t in text]})

    return models.Chain([models.Model("mock", "m", generate)])


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id string, text string")


def test_offsets_are_those_of_the_document(spark):
    d = docs(spark, ("a", "Alice in Paris. Bob in Berlin."), ("b", None), ("c", ""))
    got = {(r.text, r.start_pos, r.end_pos) for r in pl.extract(d, find(("Paris", "p"), ("Berlin", "p")), pl.PipelineOptions(max_char_buffer=16)).collect()}
    assert got == {("Paris", 9, 14), ("Berlin", 23, 29)}


def test_earlier_pass_wins(spark):
    rows = [
        ("d", "person", "Alice", 0, 5, 0.5, "exact", 0, 1), ("d", "name", "Alice", 0, 5, 0.9, "exact", 1, 2), ("d", "x", "next", 5, 9, None, "exact", 1, 3),
        ("d", "person", "Ghost", -1, -1, None, "fuzzy", 0, 4), ("d", "person", "Ghost", -1, -1, 0.1, "fuzzy", 1, 5), ("e", "name", "Alice", 0, 5, 0.9, "exact", 1, 6),
        ("d", "y", "t", 20, 25, None, "exact", 1, 7), ("d", "z", "t", 22, 24, None, "exact", 1, 8), ("d", "w", "t", 24, 26, None, "exact", 2, 9),
    ]
    kept = M.merge_passes(spark.createDataFrame(rows, FIELDS), "seq")
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 5, 6, 7, 8]


def test_preference_within_a_key(spark):
    same = lambda conf, status, p, seq: ("d", "l", "t", 0, 1, conf, status, p, seq)
    cases = [([same(0.15, "exact", 0, 1), same(0.9, "exact", 0, 2)], 2), ([same(0.9, "fuzzy", 0, 1), same(None, "exact", 0, 2)], 2), ([same(None, "exact", 0, 1), same(0.0, "exact", 0, 2)], 1), ([same(float("nan"), "lesser", 0, 2), same(None, "lesser", 0, 1)], 1)]
    for rows, best in cases:
        assert [r.seq for r in M.dedup(spark.createDataFrame(rows, FIELDS), "seq").collect()] == [best]


def test_merge_of_odd_rows(spark):
    rows = [("d", None, None, None, None, None, None, None, 1), ("d", None, None, None, None, None, None, None, 1), (None, "l", "t", 0, 1, None, "exact", 0, 2), ("d", "l", "t", 3, 3, None, "exact", 0, 3)]
    assert M.merge_passes(spark.createDataFrame(rows, FIELDS), "seq").count() == 3
    assert M.merge_passes(spark.createDataFrame([], FIELDS), "seq").count() == 0


def test_overlaps_against_brute_force(spark):
    import random

    r = random.Random(5)
    span = lambda: (lambda a: (a, a + r.randint(1, 700)))(r.randint(0, 3000))
    rows = []
    for k in range(300):
        a, b = span()
        rows.append((r.choice("ab"), r.choice("xy"), "t", a, b, None, "exact", r.randint(0, 3), k))
    kept = []
    for p in range(4):
        seen = {}
        for x in (x for x in rows if x[7] == p):
            if not any(k[0] == x[0] and k[3] < x[4] and x[3] < k[4] for k in kept):
                seen.setdefault((x[0], x[1], x[3], x[4]), x)
        kept += list(seen.values())
    assert sorted(x.seq for x in M.merge_passes(spark.createDataFrame(rows, FIELDS), "seq").collect()) == sorted(x[8] for x in kept)


def test_two_passes_of_the_pipeline(spark):
    calls = pl.extract(docs(spark, ("a", "Bob and Bob.")), find(("Bob", "person")), pl.PipelineOptions(passes=2)).collect()
    assert [(r.text, r["pass"]) for r in calls] == [("Bob", 0)]


def test_broken_answers(spark):
    bad = models.Chain([models.Model("mock", "m", lambda p, s: "broken")])
    with pytest.raises(Exception, match="Failed to parse JSON"):
        pl.extract(docs(spark, ("a", "x")), bad).collect()
    assert pl.extract(docs(spark, ("a", "x")), bad, pl.PipelineOptions(resolver=Resolver(suppress_parse_errors=True))).count() == 0


def test_unique_ids(spark):
    with pytest.raises(InvalidDocumentError) as e:
        pl.check_unique(docs(spark, ("a", "1"), ("a", "2")), "document_id")
    assert error_code(e.value) == "invalid_document_error" and error_code(ValueError()) == "unknown_error"


def fails(message, status=None):
    def generate(prompt, settings):
        raise models.ModelError(message, status)

    return generate


def test_fallbacks_and_redaction():
    ok = models.Model("b", "2", lambda p, s: "fine")
    out, events, error = models.call(models.Chain([models.Model("a", "1", fails("gone", 404)), ok], debug=True), "p")
    assert (out, error, [(e["attempt"], e["success"], e["fallback_used"]) for e in events]) == ("fine", None, [(1, False, False), (2, True, True)])
    out, events, error = models.call(models.Chain([models.Model("a", "1", fails("api_key=secret123 bad", 400)), ok]), "p")
    assert out is None and len(events) == 1 and "[REDACTED]" in error and "secret" not in error
    assert models.is_retriable(models.ModelError("Rate limit hit")) and not models.is_retriable(models.ModelError("no"))
    with pytest.raises(TypeError):
        models.Chain([ok], {"heat": 1})


def test_call_rows(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "k int, prompt string")
    out = models.generate(df, models.Chain([models.Model("a", "1", fails("down", 503))]), fail_fast=False)
    assert {r.k: (r.output, len(r.calls), r.call_error is None) for r in out.collect()} == {1: (None, 1, False), 2: (None, 0, True)}
    with pytest.raises(Exception, match="Model call failed"):
        models.generate(df, models.Chain([models.Model("a", "1", fails("down", 503))])).collect()


def test_prompts(spark):
    df = spark.createDataFrame([(" t ", " c "), ("{{context}}", None)], "t string, c string")
    first, second = (r[0] for r in df.select(P.prompt(F.col("t"), F.col("c"))).collect())
    assert "\nContext:\nc\n" in first and "\nInput text:\nt\n" in first and '"extractions"' in first
    assert "Input text:\n{{context}}" in second and "No additional context" in second  # what was put in isn't read again
    qa = df.limit(1).select(P.prompt(F.col("t"), F.col("c"), P.PromptOptions(questions=[" Why? "], output="none"))).collect()[0][0]
    assert "Question:\nWhy?\n" in qa and "c\n\nt" in qa and qa.endswith("plain-text answer.")
    with pytest.raises(PromptTemplateError, match='"b"'):
        P.render("{{ b }}", {"a": "x"})


def test_lint(spark):
    df = spark.createDataFrame([("",), ("x" * 30 + " json",), ("{{ a }} JSON",), ("text",), (None,)], "p string")
    got = [r[0] for r in df.select(P.lint(F.col("p"), 20)).collect()]
    assert got == [["empty-prompt", "missing-json-instruction"], ["too-long"], ["unresolved-template-variable"], ["missing-json-instruction"], []]
    with pytest.raises(Exception, match="missing-json"):
        P.enforce_lint(df.limit(1), "p").collect()


def test_example_alignment():
    from textlode.operators.align import AlignOptions

    issues = P.example_issues([("Open AI builds models.", [("org", "openai"), ("verb", "builds")])], AlignOptions(fuzzy=False, lesser=False))
    assert [(i.kind, i.status) for i in issues] == [("failed", None)]
    inexact = P.example_issues([("Open AI builds models.", [("org", "openai")])])
    assert [(i.kind, i.status, i.span) for i in inexact] == [("non_exact", "lesser", (0, 7))]
    said = []
    P.handle_example_issues(issues, "warn", warn=lambda m, i: said.append(m))
    assert said and "failed to align" in said[0]
    with pytest.raises(PromptAlignmentError):
        P.handle_example_issues(issues, "error")
    P.handle_example_issues(inexact, "error")
    with pytest.raises(PromptAlignmentError):
        P.handle_example_issues(inexact, "error", strict=True)


def test_pages(spark):
    h = [V.Highlight(0, 5, "OUTER"), V.Highlight(1, 3, "INNER"), V.Highlight(-1, -1, "x"), V.Highlight(4, 99, "<b>")]
    out = V.page("abcde", h, V.PageOptions(container=False, legend=False))
    assert "a<span" in out and ">bc</span>de" not in out and out.count("<span") == out.count("</span>") == 3
    assert V.page("x", []).endswith("No valid extractions to animate.</p></div>")
    assert "lx-legend" in V.page("abc", [V.Highlight(0, 1)]) and "unknown" in V.page("abc", [V.Highlight(0, 1)])
    d = spark.createDataFrame([("a", "<x>", [(0, 2, "l")]), ("b", None, None), ("c", "y", None)], "document_id string, text string, extractions array<struct<start_pos:int,end_pos:int,label:string>>")
    got = {r.document_id: r.html for r in V.pages(d).collect()}
    assert set(got) == {"a", "c"} and "&lt;x" in got["a"]
    assert "No valid" in V.visualize(d, "c")
    with pytest.raises(ValueError):
        V.visualize(d, "zzz")


def test_nesting_of_highlights():
    out = V.page("abcde", [V.Highlight(0, 5, "OUTER"), V.Highlight(1, 3, "INNER")], V.PageOptions(container=False, legend=False))
    import re

    assert re.sub("<[^/][^>]*>", "<>", out) == "<><><>a<>bc</span>de</span></div></div>"


def test_progress_texts():
    assert V.extraction_stats(1500, 5000) == "current=1,500 chars, processed=5,000 chars"
    assert V.progress_line("m-1", 1, 2).endswith("model=m-1, current=1 chars, processed=2 chars") and "Processing" in V.progress_line()
    assert V.short_url("https://example.com/" + "a" * 60 + "/f.txt") == "example.com/.../f.txt" and len(V.short_url("x" * 99)) == 50
    assert V.download_progress(10.7, "u").total == 10 and V.load_progress("/a/b.jsonl").unit == "docs" and V.save_progress("c:\\d\\e").description.endswith("e")
    assert V.model_name({"modelUrl": "u"}) == "u" and V.model_name({}) is None


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "One. Two.")], "k int, t string").createOrReplaceTempView("docs_t")
    assert [r.chunk_text for r in spark.sql("SELECT c.chunk_text FROM docs_t, LATERAL chunk_text(t, 4) c ORDER BY c.chunk_no").collect()] == ["One.", "Two."]
    assert spark.sql("SELECT count(*) FROM docs_t, LATERAL tokenize_text(t)").collect()[0][0] == 4
    assert spark.sql("SELECT align_text(t, 'two').start FROM docs_t").collect()[0][0] == 5


def test_stream(spark, tmp_path):
    docs(spark, ("a", "Bob."), ("a", "Bob."), ("b", "none")).write.parquet(str(tmp_path / "in"))
    s = stream_documents(spark, str(tmp_path / "in"), "document_id string, text string")
    extract_stream(s, str(tmp_path / "out"), str(tmp_path / "cp"), find(("Bob", "person"))).awaitTermination()
    assert {(r.document_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "Bob")}


def test_extract_call(spark):
    from textlode.control.options import extract

    said = []
    example = [("Bob ran.", [("person", "Bob", None)])]
    got = extract(spark, "Bob here", examples=example, model=find(("Bob", "person")).models[0].generate, onWarning=said.append, maxWorkers=20).collect()
    assert [r.text for r in got] == ["Bob"]
    assert {w.code for w in said} == {"batch_length_below_max_workers", "schema_constraints_ignored_with_explicit_model"}
    with pytest.raises(InferenceConfigError):
        extract(spark, "x", model=find().models[0].generate)


def test_a_run_gives_events_and_errors(spark):
    def generate(prompt, settings):
        if "Bad" in prompt:
            raise models.ModelError("down", 400)
        return models.Answer("no json" if "Odd" in prompt else '{"extractions": [{"text": "Bob", "label": "p"}]}', {"total": 7})

    chain = models.Chain([models.Model("mock", "m", generate)], debug=True)
    d = docs(spark, ("a", "Bob  came. Then Bob\nleft."), ("b", "Bad day."), ("c", "Odd day."), ("n", None))
    run = pl.run(d, chain, pl.PipelineOptions(max_char_buffer=20, passes=2, fail_fast=False))
    events = {(r.document_id, r.pass_index, r.chunk_index): r for r in run.events.collect()}
    assert set(events) == {("a", p, c) for p in (0, 1) for c in (0, 1)} | {(x, p, 0) for x in "bc" for p in (0, 1)}
    one = events["a", 0, 0]
    assert one.success and json.loads(one.usage_json) == {"total": 7} and one.prompt_chars > 0 and len(one.prompt_preview) <= 160 and "\n" not in one.prompt_preview and one.output_preview.startswith('{"extractions"')
    assert not events["b", 0, 0].success and events["b", 0, 0].error_message == "down" and events["b", 0, 0].output_preview is None
    assert {(r.document_id, r["pass"]) for r in run.errors.collect()} == {(x, p) for x in "bc" for p in (0, 1)}
    assert {(r.document_id, r.start_pos) for r in run.records.collect()} == {("a", 0), ("a", 16)}
    quiet = pl.run(docs(spark, ("a", "Bob.")), models.Chain([models.Model("mock", "m", generate)])).events.first()
    assert quiet.prompt_preview is None and quiet.prompt_chars is None and quiet.usage_json is not None


def test_duplicate_ids_are_refused_before_any_call(spark):
    def never(prompt, settings):
        raise AssertionError("called")

    with pytest.raises(InvalidDocumentError):
        pl.extract(docs(spark, ("a", "x"), ("a", "y")), models.Chain([models.Model("m", "m", never)]))


def test_progress(spark):
    seen, out = [], io.StringIO()
    d = docs(spark, *((f"d{k}", "Bob came. Bob left.") for k in range(40)))
    pl.extract(d.repartition(4), find(("Bob", "p")), pl.PipelineOptions(max_char_buffer=9, passes=2, on_progress=seen.append)).count()
    last = seen[-1]
    assert (last.completed_chunks, last.total_chunks) == (160, 160) and last.processed_chars == last.total_chars == 40 * 2 * 18
    assert all(a.completed_chunks <= b.completed_chunks for a, b in zip(seen, seen[1:], strict=False))
    with Watch(spark, 2, 10, model="m", stream=out, every=9) as w:
        w.reporter()(2, 10)
    assert out.getvalue() == "\r" + V.progress_line("m", 10, 10) + "\n"
    assert not wants_line(out)


def test_context_comes_with_the_chunk(spark):
    d = spark.createDataFrame([("a", "First part here. Second part. Third.", {"additionalContext": "own"}), ("b", "One.", None)], "document_id string, text string, metadata map<string,string>")
    chunks = pl.plan_chunks(d, pl.PipelineOptions(max_char_buffer=17, context_window_chars=6))
    got = {(r.document_id, r.chunk_no): r.chunk_context for r in chunks.collect()}
    assert got == {("a", 0): "own", ("a", 1): "own\n\nPrevious chunk context:\nhere.", ("a", 2): "own\n\nPrevious chunk context:\npart.", ("b", 0): None}
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_overlaps_across_buckets_against_brute_force(spark):
    r = random.Random(8)
    span = lambda: (a := r.randint(0, 700), a + r.choice([0, 1, 3, 63, 64, 65, 200]))
    kept = [("d" if k % 3 else "e", *span()) for k in range(25)]
    new = [("d" if k % 2 else "e", *span()) for k in range(200)] + [("d", -1, -1), (None, 1, 5), ("d", None, None)]
    schema = "document_id string, start_pos int, end_pos int"
    got = sorted(map(tuple, M.without_overlaps(spark.createDataFrame(new, schema), spark.createDataFrame(kept, schema)).collect()), key=str)
    free = lambda x: x[1] is None or x[1] < 0 or x[2] <= x[1] or not any(k[0] == x[0] and k[2] > k[1] and k[1] < x[2] and x[1] < k[2] for k in kept)
    assert got == sorted((x for x in new if free(x)), key=str)


def test_a_document_delivered_again_in_a_later_batch_is_taken_once(spark, tmp_path):
    for k in range(2):
        docs(spark, ("a", "Bob."), (f"x{k}", "Bob.")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = stream_documents(spark, str(tmp_path / "in"), "document_id string, text string", files_per_batch=1)
    extract_stream(s, str(tmp_path / "out"), str(tmp_path / "cp"), find(("Bob", "p"))).awaitTermination()
    assert sorted(r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "x0", "x1"]


def test_ids_and_pages(spark, tmp_path):
    ids = spark.createDataFrame([("x",), ("x",), ("",), (None,)], "t string").select(document_id("t").alias("i")).collect()
    assert all(re.fullmatch("doc_[0-9a-f]{8}", r.i) for r in ids) and ids[0] == ids[1] != ids[2]
    assert re.fullmatch("doc_[0-9a-f]{8}", random_document_id()) and random_document_id() != random_document_id()
    d = docs(spark, ("a", "Bob <came>."))
    jsonl.save_annotated(jsonl.annotated_records(d, pl.extract(d, find(("Bob", "person")))), str(tmp_path / "out"))
    html = V.visualize(str(tmp_path / "out"), "a", spark=spark)
    assert ">Bob</span> &lt;came&gt;." in html and "person" in html
    labels = spark.createDataFrame([(f"l{k:03}",) for k in range(35)] * 2 + [(None,)], "label string")
    colors = {r.label: r.color for r in V.label_colors(labels).collect()}
    assert len(colors) == 36 and colors["l000"] == V.PALETTE[0] and colors["l034"] == V.PALETTE[4] and colors["unknown"] == V.PALETTE[5]


def test_documents_made_on_the_driver(spark):
    made = pl.documents(spark, ["one", pl.Document("two", "b", "note", {"k": "v"}), None]).collect()
    assert [r.text for r in made] == ["one", "two", None] and re.fullmatch("doc_[0-9a-f]{8}", made[0].document_id)
    assert (made[1].document_id, made[1].metadata) == ("b", {"k": "v", "additionalContext": "note"})


def test_views_of_chunks(spark):
    d = docs(spark, ("a", "One  two.\n\nThree\tfour."), ("b", " "))
    got = {(r.document_id, r.chunk_no): (r.sanitized_text, r.start_pos, r.end_pos) for r in chunk_views(chunks_of(d, "document_id", 10)).collect()}
    assert got == {("a", 0): ("One two.", 0, 9), ("a", 1): ("Three four", 11, 21), ("a", 2): (".", 21, 22), ("b", 0): (None, 0, 1)}


def test_small_tables_are_broadcast_and_large_ones_not(spark):
    a, b = spark.range(5), spark.range(20)
    plan = lambda most: a.join(small(b, most), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(21) and "broadcast" not in plan(20)
