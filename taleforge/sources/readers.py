"""Sources: books, pages, annotations, metadata, directories, overrides; and the JSON documents of each stage."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleforge.operators.segments import toc_text

#: Block tags of a page, and tags that never have an end.
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "hr", "blockquote")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
COVER_KINDS = ("image/jpeg", "image/png", "image/gif", "image/webp")


class _Blocks(HTMLParser):
    """Collects the block elements of a page in document order, nested ones too."""

    def __init__(self, nested: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nested, self.open, self.found, self.hidden = nested, [], [], 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        hides = tag in ("nav", "script", "style", "head") or attrs.get("epub:type") == "toc" or attrs.get("role") == "doc-toc"
        classes = (attrs.get("class") or "").split()
        if tag in VOID:
            if tag == "hr" and not self.hidden:
                self.found.append(["hr", [], classes, True])
            return
        if tag == "p":  # an open paragraph ends where the next one begins
            self._close_to("p")
        block = None
        if not (self.hidden or hides) and tag in BLOCKS:
            block = [tag, [], classes, True]
            for entry in self.open:
                if entry[1] is not None:
                    entry[1][3] = False
            self.found.append(block)
        self.open.append([tag, block, hides])
        self.hidden += hides

    def _close_to(self, tag):
        if any(e[0] == tag for e in self.open) and tag == "p":
            self.handle_endtag(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(e[0] == tag for e in self.open):
            return
        while True:
            name, _, hides = self.open.pop()
            self.hidden -= hides
            if name == tag:
                return

    def handle_data(self, data):
        if not self.hidden and (text := data.strip()):
            for _, block, _ in self.open:
                if block is not None:
                    block[1].append(text)

    def rows(self):
        for tag, text, classes, leaf in self.found:
            if tag == "hr" or (text and (leaf or self.nested == "all")):
                yield {"tag": tag, "text": " ".join(text), "classes": classes}


def html_blocks(html: str | None, nested: str = "all") -> list[dict]:
    """(tag, text, classes) of a page's blocks, without navigation. nested 'all' gives outer blocks too, 'leaf' only innermost ones."""
    parser = _Blocks(nested)
    parser.feed(html or "")
    parser.close()
    return list(parser.rows())


def page_blocks(pages: DataFrame, *, key: str, html: str = "html", nested: str = "all") -> DataFrame:
    """S3, P5: one row a block (key, pos, tag, text, classes); blocks of a table of contents are left out."""

    @F.pandas_udf("array<struct<tag:string,text:string,classes:array<string>>>")
    def parse(pages: pd.Series) -> pd.Series:
        return pd.Series([html_blocks(p, nested) for p in pages])

    rows = pages.select(key, F.posexplode(parse(html)).alias("pos", "b")).select(key, "pos", "b.*")
    return rows.where((F.col("tag") == "hr") | ~toc_text(F.col("text")))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def epub_rows(data: bytes) -> list[dict]:
    """A book's linear spine documents in order, with its title, author, guide and cover; nothing if it is broken."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        box = ElementTree.fromstring(book.read("META-INF/container.xml"))
        path = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
        root = ElementTree.fromstring(book.read(path))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        return []
    base = posixpath.dirname(path)
    manifest, spine, guide, text, covers = {}, [], [], {}, []
    for e in root.iter():
        name = _local(e.tag)
        if name == "item":
            manifest[e.get("id")] = (posixpath.normpath(posixpath.join(base, e.get("href", ""))), e.get("media-type", ""))
        elif name == "itemref":
            spine.append((e.get("idref"), e.get("linear", "yes")))
        elif name == "reference" and e.get("type", "").lower() in ("text", "bodymatter"):
            guide.append(e.get("href", "").split("#")[0])
        elif name in ("title", "creator") and e.text:
            text.setdefault(name, e.text)
        elif name == "meta" and e.get("name") == "cover":
            covers.append(e.get("content"))
    images = [manifest[c] for c in covers if c in manifest] + [v for v in manifest.values() if v[1].startswith("image/") and "cover" in v[0].lower()]
    cover = next((v for v in images if v[1] in COVER_KINDS), (None, None))
    out = []
    for item, linear in spine:
        href, kind = manifest.get(item, (None, ""))
        if href is None or linear == "no" or kind not in ("application/xhtml+xml", "text/html"):
            continue
        try:
            html = book.read(href).decode("utf-8", "replace")
        except KeyError:
            continue
        marked = any(g and (href.endswith(g) or g.endswith(href)) for g in guide)
        out.append({"spine_pos": len(out), "href": href, "html": html, "title": text.get("title", "Unknown Title"), "author": text.get("creator", "Unknown Author"), "guide": marked, "cover": cover[0], "cover_mime": cover[1]})
    return out


EPUB = "book_id string, spine_pos int, href string, html string, title string, author string, guide boolean, cover string, cover_mime string"


def epub_documents(files: DataFrame) -> DataFrame:
    """One row a linear spine document of every book in files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.strip().split(" ")[0] for f in EPUB.split(",")]
        for frame in frames:
            rows = [{"book_id": posixpath.splitext(posixpath.basename(p))[0]} | r for p, c in zip(frame["path"], frame["content"], strict=True) for r in epub_rows(c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, EPUB)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all books below a path."""
    return epub_documents(spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path))


def read_annotations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(speaker, annotator, traits) of annotators' files 'speaker|trait,trait'; rows of other than two fields are skipped. A missing file raises."""
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.option("sep", "|").option("escape", '"').option("mode", "PERMISSIVE").schema("speaker string, traits string, more string").csv(path)
        lines = spark.read.text(path).limit(1).count()  # raises for a missing file even before the first action
        rows = rows.where(F.col("traits").isNotNull() & F.col("more").isNull()) if lines else rows.limit(0)
        rows = rows.select(F.trim("speaker").alias("speaker"), F.lit(k).alias("annotator"), F.filter(F.transform(F.split("traits", ","), lambda t: F.trim(t)), lambda t: t != "").alias("traits"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no annotators' files")
    return out


def piped_metadata(lines: DataFrame, *, text: str = "value", order: str = "pos") -> DataFrame:
    """S8: 'key | x | value' lines to (key, value); comments begin with ';', the last line of a key counts."""
    parts = F.transform(F.split(F.trim(text), r"\|"), lambda p: F.trim(p))
    rows = lines.where((F.trim(text) != "") & ~F.trim(text).startswith(";")).withColumn("_p", parts).where(F.size("_p") >= 3)
    return rows.groupBy(F.col("_p")[0].alias("key")).agg(F.max_by(F.col("_p")[2], order).alias("value"))


def env_values(lines: DataFrame, known: DataFrame, *, text: str = "value", order: str = "pos") -> DataFrame:
    """S10: 'key=value' lines to (key, value); comments and known keys are skipped, the first line of a key counts."""
    at = F.instr("_l", "=")
    rows = lines.withColumn("_l", F.trim(text)).where(~F.col("_l").startswith("#") & (at > 0))
    rows = rows.select(F.trim(F.substring("_l", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("_l", at + 1, F.length("_l"))).alias("value"), order).where("key <> ''")
    return rows.join(known.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min_by("value", order).alias("value"))


def scanned_rows(rows: DataFrame, wanted: DataFrame, *, key: str, order: str, more: int = 100) -> DataFrame:
    """The wanted rows with content that a scan in order sees, which ends after the last wanted key was first found and more rows were read.

    rows has a boolean has_content; wanted rows without content are passed over uncounted. Without some wanted key
    the scan reads everything. Only the end's neighbourhood is ordered: more + 1 rows.
    """
    keys = wanted.select(key).distinct().withColumn("_wanted", F.lit(True))
    seen = rows.join(keys, key, "left")
    good = seen.where("_wanted and has_content")
    found = keys.join(good.groupBy(key).agg(F.min(order).alias("_first")), key, "left")
    complete = found.agg(F.when(F.count("*") == F.count("_first"), F.max("_first")).alias("_complete"))
    rest = seen.where(F.col("_wanted").isNull() | F.col("has_content")).join(F.broadcast(complete), F.col(order) >= F.col("_complete")).select(order).orderBy(order).limit(more + 1)
    end = rest.agg(F.when(F.count("*") > more, F.max(order)).alias("_end"))
    return good.join(F.broadcast(end), F.lit(True)).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_wanted", "_end")


def read_directory(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length) of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def with_transcripts(files: DataFrame, texts: DataFrame, ending: str = ".normalized.txt") -> DataFrame:
    """Clips beside the transcript file of the same stem."""
    stem = lambda c, e: F.regexp_replace(c, e.replace(".", r"\.") + "$", "")
    notes = texts.select(stem(F.col("path"), ending).alias("_stem"), F.trim("transcript").alias("transcript"))
    return files.withColumn("_stem", stem(F.col("path"), ".wav")).join(notes, "_stem", "left").drop("_stem")


def parse_overrides(source: str | None) -> list[dict]:
    """The 'characters' of a YAML file of overrides: two levels of plain 'key: value' lines, comments and blanks skipped."""
    out, path = [], []
    for line in (source or "").splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth, (key, _, value) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        key, value = key.strip("\"' "), value.strip().strip("\"'")
        path = [p for p in path if p[0] < depth]
        names = [p[1] for p in path]
        if names == ["characters"] and not value:
            out.append({"name": key, "speaker_id": None, "voice_profile": {}})
        elif len(names) == 2 and names[0] == "characters" and key == "speaker_id":
            out[-1]["speaker_id"] = value
        elif len(names) == 3 and names[2] == "voice_profile" and value:
            out[-1]["voice_profile"][key] = value
        path.append((depth, key))
    return out


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides as (name, speaker_id, voice_profile); none if the file is absent or empty."""
    source = None
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        source = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(o["name"], o["speaker_id"], o["voice_profile"]) for o in parse_overrides(source)], "name string, speaker_id string, voice_profile map<string,string>")


def read_documents(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """A stage's JSON document (an array of rows, or with lines the rows that write_documents wrote) with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def write_documents(rows: DataFrame, path: str, *, by: list[str] | None = None) -> None:
    """Rows as JSON, committed as a whole."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


