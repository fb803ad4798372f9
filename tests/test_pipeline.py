import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import condense, structure
from quire.plans import config, pipeline
from quire.sinks import files
from quire.sources import epub, parsed, plain, typed
from quire.streaming import streams

SENT = "The harbour was built before the war and nobody expected the council to keep it open for so long. "


@pytest.fixture
def library(tmp_path):
    src = tmp_path / "books"
    src.mkdir()
    (src / "three-parts.txt").write_text("".join(f"Chapter {i}: Part {n}\n\n" + "\n\n".join(SENT * 3 for _ in range(3)) + "\n\n" for i, n in enumerate(("Foundations", "Strategy", "Logistics"), 1)))
    (src / "no_headings.txt").write_bytes(SENT.encode() * 4 + b"\xff\xfe tail of the file")
    chapters = [(f"Chapter {i}", f"<p>{SENT * 4}</p><p>short</p><p>{SENT}") for i in range(1, 4)]
    (src / "sample.epub").write_bytes(files.epub_bytes("Sample EPUB", "Jane Doe", chapters, "sample"))
    (src / "broken.epub").write_bytes(b"no zip")
    return src, tmp_path


def test_plain_split(spark):
    rows = [(1, "Chapter 1: One\nfirst\n\nsecond\n\nPart two. Rest\nthird"), (2, "no heading\n\n  kept blanks "), (3, None), (4, ""), (5, "lost\r\nChapter 9\r\nbody\r\n\r\nmore")]
    got = plain.split_by_headings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.section_pos, r.para_pos)):
        by.setdefault((r.doc_id, r.title), []).append(r.paragraph)
    assert by[1, "Chapter 1: One"] == ["first", "second"] and by[1, "Part two. Rest"] == ["third"]
    assert by[2, "Body"] == ["no heading", "  kept blanks "] and not any(k[0] in (3, 4) for k in by)
    assert by[5, "Chapter 9\nbody"] == ["more"] and sum(k[0] == 5 for k in by) == 1


def test_epub(spark, library):
    src, _ = library
    meta, sections = epub.read_epub(spark, str(src))
    assert [(r.title, r.author) for r in meta.collect()] == [("Sample EPUB", "Jane Doe")]
    rows = sections.orderBy("pos").collect()
    assert [r.title for r in rows] == ["Chapter 1", "Chapter 2", "Chapter 3"] and all(len(r.paragraphs) == 2 for r in rows)


def test_html_cases(spark):
    pages = [("b", 0, "x/the_page.html", f"<html><head><title>T</title></head><body><script>var x</script><p>{SENT * 2}<p>{SENT}</body></html>"), ("b", 1, "y.html", f"<h2>{'long ' * 40}</h2><h3>Fits</h3><div>{SENT}<br/>{SENT}</div>"), ("b", 2, "z.html", "<p>too short</p>"), ("b", 3, "n.html", None)]
    got = epub.html_sections(spark.createDataFrame(pages, "path string, pos int, name string, html string")).orderBy("pos").collect()
    assert [(r.title, len(r.paragraphs)) for r in got] == [("The Page", 2), ("Fits", 2)]
    assert got[0].paragraphs[1] == SENT.strip()


def test_run_resume_and_export(spark, library):
    src, tmp = library
    folder = str(tmp / "run")
    run = pipeline.run_pipeline(spark, str(src), folder, config.load())
    assert [h for _, h in run.done] == ["run"] * 5
    books = {r.book_slug: r for r in run.table("books").collect()}
    assert set(books) == {"three-parts", "no-headings", "sample"} and books["sample"].book_title == "Sample EPUB" and books["three-parts"].book_title == "Three Parts"
    sections = {(r.book_slug, r.title) for r in run.table("sections").collect()}
    assert ("three-parts", "Chapter 2: Part Strategy") in sections and ("no-headings", "Body") in sections and ("sample", "Chapter 3") in sections
    m = {r.book_slug: r for r in run.table("manifest").collect()}
    assert m["three-parts"].chapters == 3 and 0 < m["three-parts"].compression_ratio < 1
    again = pipeline.run_pipeline(spark, str(src), folder, config.load())
    assert [h for _, h in again.done] == ["kept"] * 5
    pipeline.export(run, str(tmp / "out"))
    text = (next((tmp / "out" / "source_md").glob("file=three-parts*/*.txt"))).read_text()
    assert text.startswith("# Three Parts\n\n## Chapter 1: Part Foundations\n") and "\n^" in text
    with zipfile.ZipFile(tmp / "out" / "epub" / "three-parts.epub") as z:
        page = z.read("OEBPS/chapter1.xhtml").decode()
    assert 'class="spine-callout"' in page and "[p:" not in page


def test_epubs_of_every_shape_are_kept(spark, tmp_path):
    src = tmp_path / "books"
    src.mkdir()
    short = [(f"Chapter {i}", "<h2>Chapter %d: Start</h2><p>Only a few words.</p>" % i) for i in range(1, 4)]
    (src / "short.epub").write_bytes(files.epub_bytes("Short", None, short, "short"))
    two = [("index split 000", "<p>Front</p>" + "".join(f"<p>Chapter {i} Of Two</p>" + f"<p>{SENT * 8}</p>" for i in (1, 2)))]
    (src / "two.epub").write_bytes(files.epub_bytes("Two", "A B", two, "two"))
    (src / "long.txt").write_text("Introduction\n" + SENT + "\n\nChapter 1: A\n" + "\n\n".join(SENT * 50 for _ in range(10)) + "\n\nConclusion\n" + SENT)
    run = pipeline.run_pipeline(spark, str(src), str(tmp_path / "run"), config.load(), until="classify")
    assert {r.book_slug for r in run.table("books").collect()} == {"short", "two", "long"}
    got = {}
    for r in run.table("sections").orderBy("section_pos").collect():
        got.setdefault(r.book_slug, []).append(r.title)
    assert got["two"] == ["Chapter 1 Of Two", "Chapter 2 Of Two"]
    assert got["long"] == ["Introduction", "Chapter 1: A (Part 1)", "Chapter 1: A (Part 2)", "Conclusion"]
    assert any("Only a few words." in r.text for r in run.table("paragraphs").filter("book_slug = 'short'").collect())
    words = {r.book_slug: r.n for r in run.table("paragraphs").groupBy("book_slug").agg(F.sum("n_words").alias("n")).collect()}
    assert words["long"] == len((SENT * 502).split())


def test_member_paths(spark):
    rows = [("OEBPS/content.opf", "text/a.html", "OEBPS/text/a.html"), ("OEBPS/x/content.opf", "../text/a.html", "OEBPS/text/a.html"), ("content.opf", "./a.html", "a.html"), ("a/b/c.opf", "../../d/../e.html", "e.html")]
    df = spark.createDataFrame(rows, "opf string, href string, want string")
    assert df.filter(epub.member_path(F.col("opf"), F.col("href")) != F.col("want")).count() == 0


def test_degenerate_books_take_the_uniform_ratio(spark):
    rows = [("a", 0, 1000, 0.6, 600, 60), ("a", 1, 100, 0.3, 30, 30), ("b", 0, 1000, 0.3, 300, 30)]
    df = spark.createDataFrame(rows, "book_slug string, section_pos int, words bigint, ratio double, target_words bigint, pct bigint")
    from quire.operators import budget

    got = {(r.book_slug, r.section_pos): (r.ratio, r.target_words) for r in budget.evened(df, 0.25).collect()}
    assert got[("a", 0)] == (0.25, 250) and got[("b", 0)] == (0.3, 300)


def test_entry_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert entry.queries() and not any(k.startswith("p1_") for k in entry.queries()) and entry.oracle_sql()


def test_stage_order():
    order = sorted([pipeline.stage("10", "c", None), pipeline.stage("2b", "b", None), pipeline.stage("2", "a", None)])
    assert [s.name for s in order] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        pipeline.stage("x", "n", None)


def test_config(tmp_path):
    base, own = tmp_path / "base.json", tmp_path / "own.json"
    base.write_text('{"distill": {"compression_ratio": 0.2, "max_rounds": 3}}')
    own.write_text('{"extends": "base.json", "distill": {"max_rounds": 4}}')
    c = config.load(own, {"coherence": {"max_fix_rounds": 9}}, env={"QUIRE_COMPRESSION": "0.4"})
    assert (c["distill"]["compression_ratio"], c["distill"]["max_rounds"], c["coherence"]["max_fix_rounds"]) == (0.4, 4, 9)
    base.write_text('{"extends": "own.json"}')
    with pytest.raises(config.ConfigError):
        config.load(own)
    with pytest.raises(config.ConfigError):
        config.load(None, {"nonsense": 1})
    with pytest.raises(config.ConfigError):
        config.load(None, {"distill": {"compression_ratio": 2.0}})


def test_parser_items(spark, tmp_path):
    items = [("b", 0, "title", 1, "The Book", 1, None), ("b", 1, "text", None, "Before.", 1, None), ("b", 2, "section_header", 1, "Chapter 1", 1, None), ("b", 3, "section_header", 2, "1.1 Scope", 2, None), ("b", 4, "table", None, "", 2, [["a", "b"]]), ("b", 5, "footnote", None, "Note.", 3, None), ("b", 6, "section_header", 1, "Chapter 2", None, None), ("b", 7, "text", None, "  ", 4, None)]
    sections, paras = parsed.to_tables(spark.createDataFrame(items, parsed.ITEM.replace("path string", "book_slug string")))
    s = {r.title: r for r in sections.collect()}
    assert s["1.1 Scope"].path == ["The Book", "Chapter 1", "1.1 Scope"] or s["1.1 Scope"].parent_pos == 2
    assert s["1.1 Scope"].level == 2 and s["Chapter 2"].level == 1
    p = {r.para_pos: r for r in paras.collect()}
    assert set(p) == {1, 4, 5} and p[4].text == "a | b" and p[5].is_footnote and p[4].section_pos == 3
    (tmp_path / "x.pdf").write_bytes(b"%PDF")

    def parse(path, content):
        raise RuntimeError("no parser")

    assert [r.label for r in parsed.parse_files(spark, str(tmp_path), parse).collect()] == ["failed"]


def test_greedy_parts_close_at_the_target(spark):
    rows = [("b", 0, i, n) for i, n in enumerate([2000, 3000, 2999, 1, 1])] + [("b", 1, i, 4000) for i in range(2)]
    df = spark.createDataFrame(rows, "book_slug string, section_pos int, para_pos int, n_words int")
    got = {(r.section_pos, r.para_pos): r.part for r in structure.greedy_parts(df).collect()}
    assert [got[0, i] for i in range(5)] == [1, 1, 2, 2, 2] and [got[1, i] for i in range(2)] == [1, 1]


def test_continuation_rounds(spark):
    long = " ".join(f"w{i}" for i in range(60))
    drafts = spark.createDataFrame([("a", "begins", 200, "STOP", ["x"]), ("b", "done.", 5, "STOP", ["x"])], "k string, body_md string, target_words int, finish_reason string, items array<string>")
    ask = lambda todo: todo.select("k", F.lit(long).alias("more"), F.lit("STOP").alias("finish_reason"))
    got = {r.k: r for r in condense.continue_until_done(drafts, ask, ["k"], rounds=5).collect()}
    assert got["a"].rounds == 3 and got["b"].rounds == 1 and got["b"].body_md == "done."


def test_providers(spark):
    df = spark.createDataFrame([(1, "one two three", 2)], "k int, prompt string, max_words int")
    r = condense.route("spine", {"spine": "extractive"}).ask(df, ["k"]).first().response
    assert r.text == "one two" and r.finish_reason == "STOP" and r.tokens_in == 3
    with pytest.raises(KeyError):
        condense.route("spine", {"spine": "nobody"})


def test_typed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"word": "x", "count": 1, "more": 2}')
    (tmp_path / "b.jsonl").write_text('{"word": "x", "count": 1}\n\n{"word": "y", "count": 2}\n')
    assert [tuple(r) for r in typed.read_json(spark, str(tmp_path / "a.json"), "word string, count int").collect()] == [("x", 1)]
    assert typed.read_json(spark, str(tmp_path / "b.jsonl"), "word string, count int", lines=True).count() == 2
    files.write_json(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")) == '{"a":"x","b":1}\n'
    assert typed.domain_errors(spark.createDataFrame([("pdf",), ("doc",), (None,)], "f string"), "f", ["pdf"]).count() == 2


def test_streams(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    parts = tmp_path / "events"
    spark.read.parquet(f"{d}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(parts))
    stream = streams.event_windows(streams.file_stream(spark, str(parts), schema), late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{d}/events.parquet").count()


def test_no_text_no_trouble(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.txt").write_text("")
    run = pipeline.run_pipeline(spark, str(tmp_path / "in"), str(tmp_path / "run"), config.load(), until="classify")
    assert run.table("paragraphs").count() == 0
    with zipfile.ZipFile(tmp_path / "x.zip", "w"):
        pass


def test_the_best_sentences_of_the_whole_chapter(spark):
    texts = ["The chapter begins with this.", *["Nothing of note is said in here."] * 6, "The Harbour was what mattered.", "Nothing more is said.", "A library came after it."]
    paras = spark.createDataFrame([("b", 0, i, t) for i, t in enumerate(texts)], "book_slug string, section_pos int, para_pos int, text string")
    targets = spark.createDataFrame([("b", 0, 15)], "book_slug string, section_pos int, target_words int")
    items = spark.createDataFrame([("b", 0, "harbour"), ("b", 0, "Library"), ("b", 0, "")], "book_slug string, section_pos int, name string")
    sents = condense.sentences(paras)
    got = condense.best_sentences(sents, targets, items).first()
    assert got.body_md == " ".join(texts[i] for i in (0, 7, 9)) and got.word_count == 15
    assert condense.best_sentences(sents, targets, items.limit(0)).first().body_md == condense.condensed(sents, targets).first().body_md
