"""Files from tables."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in order of name, so that equal rows are equal bytes."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, name: str, text: str, suffix: str = ".md", order: tuple[str, ...] = ()) -> None:
    """One folder a name, with its texts as the lines of one file, in ``order``.

    Names are written side by side; the rows of one are sorted, which may
    spill, and stream through one task, so none is held as a whole.
    """
    rows = df.select(F.col(text).alias("value"), F.concat(F.col(name), F.lit(suffix)).alias("file"), *order)
    rows = rows.repartition("file").sortWithinPartitions("file", *order).select("value", "file")
    rows.write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a table of parquet files; readers see all of a write or nothing."""
    df.write.mode("append").parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was written to its end."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


#: The stylesheet of an EPUB, and the boilerplate of its parts below (fixed values of the format).
STYLE = "body { line-height: 1.5 } .chapter-subtitle { font-style: italic } .spine-callout { border-left: 3px solid #999; padding-left: 1em } .spine-label { font-weight: bold }"


def epub_bytes(title: str, author: str | None, chapters: list[tuple[str, str]], slug: str) -> bytes:
    """An EPUB of chapters (title, HTML): title page, chapters, reading order and both kinds of contents."""
    esc = html.escape
    page = lambda t, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(t)}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>{body}</body></html>'
    files = [("title.xhtml", page(title, f"<h1>{esc(title)}</h1><p>{esc(author or '')}</p>"), title)]
    files += [(f"chapter{i}.xhtml", page(t, f"<h2>{esc(t)}</h2>{body}"), t) for i, (t, body) in enumerate(chapters, 1)]
    manifest = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, (n, _, _) in enumerate(files))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(slug)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author or "")}</dc:creator><dc:language>en</dc:language></metadata><manifest>{manifest}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/></manifest><spine toc="ncx">{"".join(f"<itemref idref=\"i{i}\"/>" for i in range(len(files)))}</spine></package>'
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{esc(title)}</text></docTitle><navMap>{"".join(f"<navPoint id=\"n{i}\" playOrder=\"{i + 1}\"><navLabel><text>{esc(t)}</text></navLabel><content src=\"{n}\"/></navPoint>" for i, (n, _, t) in enumerate(files))}</navMap></ncx>'
    nav = page("Contents", '<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{esc(t)}</a></li>' for n, _, t in files) + "</ol></nav>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?>\n<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for n, text in [("content.opf", opf), ("toc.ncx", ncx), ("nav.xhtml", nav), ("style.css", STYLE), *[(n, t) for n, t, _ in files]]:
            z.writestr(f"OEBPS/{n}", text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epubs(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_slug, content binary) of (book_slug, book_title, book_author) and (book_slug, section_pos, title, html)."""
    by = chapters.groupBy("book_slug").agg(F.array_sort(F.collect_list(F.struct("section_pos", "title", "html"))).alias("c"))
    rows = books.select("book_slug", "book_title", "book_author").join(by, "book_slug")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pylist()
            made = [epub_bytes(x["book_title"] or "", x["book_author"], [(c["title"] or "", c["html"] or "") for c in x["c"]], x["book_slug"]) for x in r]
            yield pa.RecordBatch.from_arrays([pa.array([x["book_slug"] for x in r]), pa.array(made, pa.binary())], names=["book_slug", "content"])

    return rows.mapInArrow(run, "book_slug string, content binary")


def write_epubs(books: DataFrame, folder: str) -> int:
    """Write (book_slug, content) as files ``<book_slug>.epub`` by the executors, under a folder they share; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        there.create_dir(base, recursive=True)
        for b in batches:
            for slug, content in zip(b.column(0).to_pylist(), b.column(1)):
                with there.open_output_stream(f"{base}/{slug}.epub") as out:
                    out.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return books.select("book_slug", "content").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
