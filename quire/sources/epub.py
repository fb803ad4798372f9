"""EPUB books: members by a Python reader of the zip, all else by columns."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.text import squeeze, title_case, word_count

_MEMBER = ("xml", "opf", "xhtml", "html", "htm")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the text members of every EPUB; files that are no zip have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for n in z.namelist():
                            if n.rsplit(".", 1)[-1].lower() in _MEMBER:
                                rows.append((path, n, z.read(n).decode("utf-8", "ignore")))
                except (zipfile.BadZipFile, KeyError, RuntimeError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "name", "content"])

    return files.mapInArrow(run, "path string, name string, content string")


def _plain(xml: Column) -> Column:
    """XML without its declaration and namespaces, which XPath here does not know."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(xml, r"<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", ""), r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")


def packages(m: DataFrame) -> DataFrame:
    """(path, opf, xml): each book's package, by its container."""
    container = m.filter("name = 'META-INF/container.xml'").select("path", F.xpath_string(_plain(F.col("content")), F.lit("//rootfile/@full-path")).alias("opf"))
    return container.join(m.select("path", F.col("name").alias("opf"), F.col("content").alias("xml")), ["path", "opf"]).withColumn("xml", _plain(F.col("xml")))


def metadata(pk: DataFrame) -> DataFrame:
    """(path, title, author); null where the package does not say."""
    t = lambda x: F.nullif(F.trim(F.xpath_string("xml", F.lit(x))), F.lit(""))
    return pk.select("path", t("//metadata/title").alias("title"), t("//metadata/creator").alias("author"))


def member_path(opf: Column, href: Column) -> Column:
    """The member a package's reference names: relative to the package, steps up to eight levels resolved."""
    p = F.concat(F.regexp_extract(opf, "^(.*/)?[^/]*$", 1), F.regexp_replace(href, r"^(?:\./)+", ""))
    p = F.regexp_replace(p, r"(?<=/)(?:\./)+", "")
    for _ in range(8):
        p = F.regexp_replace(p, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    return p


def spine(pk: DataFrame, m: DataFrame) -> DataFrame:
    """(path, pos, name): HTML members in reading order; books without a package by name, but for META-INF."""
    arr = lambda x: F.xpath("xml", F.lit(x))
    item = F.explode(F.arrays_zip(arr("//manifest/item/@id").alias("id"), arr("//manifest/item/@href").alias("href"), arr("//manifest/item/@media-type").alias("kind")))
    items = pk.select("path", "opf", item.alias("i")).select("path", "opf", "i.*").filter(F.contains("kind", F.lit("html")))
    refs = pk.select("path", F.posexplode(arr("//spine/itemref/@idref")).alias("pos", "id"))
    known = refs.join(items, ["path", "id"]).select("path", "pos", member_path(F.col("opf"), F.col("href")).alias("name"))
    html = m.filter(F.lower("name").rlike(r"\.(xhtml|html|htm)$") & ~F.col("name").startswith("META-INF/"))
    rest = html.join(known.select("path").distinct(), "path", "left_anti").select("path", "name")
    from pyspark.sql import Window

    by_name = rest.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("name")) - 1).alias("pos"), "name")
    return known.unionByName(by_name)


def text_of(html: Column) -> Column:
    """HTML without tags, the common entities as characters."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


def html_sections(pages: DataFrame, least_chars: int = 10, least_words: int = 30, title_chars: int = 120) -> DataFrame:
    """(path, pos, title, paragraphs array<string>, n_words) of (path, pos, name, html).

    The first heading of three levels that is short enough is the title, else
    the file's name in words. Paragraphs are the p elements of more than
    ``least_chars`` characters, an open one ends at the next block tag; pages
    without any are cut at line ends. Pages under ``least_words`` words are
    left out, null pages too.
    """
    html = F.regexp_replace("html", r"(?is)<(script|style|svg)\b.*?</\1\s*>|<!--.*?-->", "")
    heads = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>"), F.lit(1))
    short = F.filter(F.transform(heads, text_of), lambda t: (t != "") & (F.length(t) < title_chars))
    body = F.regexp_replace(html, r"(?is)<head\b.*?</head\s*>", "")
    ps = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p\s*>|<(?:p|div|h[1-6]|ul|ol|table|section|blockquote)\b|</(?:body|div|section)\b|$)"), F.lit(1)), text_of)
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(body, r"(?is)<h[1-3]\b[^>]*>.*?</h[1-3]\s*>", ""), r"(?i)<br\s*/?>|</(?:div|li|tr|h[1-6])\s*>", "\n"), "\n"), text_of)
    keep = lambda a: F.filter(a, lambda t: F.length(t) > least_chars)
    stem = title_case(F.translate(F.regexp_extract("name", r"([^/]+?)(?:\.[^./]*)?$", 1), "-_", "  "))
    x = pages.filter("html is not null").select("path", "pos", F.coalesce(F.get(short, 0), stem).alias("title"), keep(ps).alias("ps"), keep(lines).alias("ls"))
    y = x.select("path", "pos", "title", F.when(F.size("ps") > 0, F.col("ps")).otherwise(F.col("ls")).alias("paragraphs"))
    return y.withColumn("n_words", word_count(F.array_join("paragraphs", " "))).filter(F.col("n_words") >= least_words)


def read_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, pages) of all EPUBs under a path; pages are (path, pos, name, html) in reading order."""
    m = members(spark, path)
    pk = packages(m)
    return metadata(pk), spine(pk, m).join(m.select("path", "name", F.col("content").alias("html")), ["path", "name"])


def read_epub(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, sections) of all EPUBs under a path."""
    meta, pages = read_pages(spark, path)
    return meta, html_sections(pages)


def plain_text(pages: DataFrame) -> DataFrame:
    """(path, text): all lines of a book's pages in order, headings and short pages included; pages are apart by blank lines."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|svg)\b.*?</\1\s*>|<!--.*?-->|<\?.*?\?>|<![^>]*>", "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(bare, r"<[^>]*>", "\n"), "\n"), text_of), lambda t: t != "")
    by = pages.filter("html is not null").select("path", "pos", F.array_join(lines, "\n").alias("t")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a"))
    return by.select("path", F.array_join(F.filter(F.transform("a", lambda x: x["t"]), lambda t: t != ""), "\n\n").alias("text"))


def resplit(sections: DataFrame) -> DataFrame:
    """Sections as ``html_sections`` gives them, cut anew at the headings among their paragraphs; only books that have two or more such."""
    from quire.operators.structure import assign_sections, is_chapter_heading, is_matter_heading

    lines = sections.select("path", F.col("pos").alias("page"), F.posexplode("paragraphs").alias("k", "line")).withColumn("n_words", word_count(F.col("line")))
    lines = lines.withColumn("pos", F.struct("page", "k"))
    x = assign_sections(lines, is_chapter_heading(F.col("line")) | is_matter_heading(F.col("line")), "path").filter(F.col("is_body") & F.col("section_start").isNotNull())
    many = x.groupBy("path").agg(F.count_distinct("section_start").alias("n")).filter("n > 1").select("path")
    by = x.join(many, "path").groupBy("path", "section_start", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "n_words"))).alias("a"))
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("path").orderBy("section_start")) - 1
    words = F.aggregate("a", F.lit(0).cast("bigint"), lambda n, y: n + y["n_words"])
    return by.select("path", pos.alias("pos"), "title", F.transform("a", lambda y: y["line"]).alias("paragraphs"), words.alias("n_words"))


def strategy(sections: DataFrame) -> DataFrame:
    """(path, sections, strategy): by pages where three or more have real titles, else by headings in the merged text."""
    from quire.operators.structure import is_real_title

    by = sections.groupBy("path").agg(F.count("*").alias("sections"), F.bool_or(is_real_title(F.col("title"))).alias("real"))
    return by.select("path", "sections", F.when((F.col("sections") >= 3) & F.col("real"), "pages").when(F.col("sections") >= 1, "headings").otherwise("plain").alias("strategy"))
