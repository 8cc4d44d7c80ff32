"""Sources: folders of documents, session logs, relation payloads, web pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.keys import confidence, node_key, relation_key
from factweave.functions.text import html_title, strip_html

#: Suffixes that a folder scan takes, folders that it skips, and the largest file.
SUFFIXES = tuple("md markdown txt rst org html htm json jsonl csv py js ts tsx jsx go rs java rb c h cpp cs swift kt sql yaml yml toml tex pdf".split())
SKIPPED = tuple(".git node_modules .venv venv __pycache__ dist build .tox .mypy_cache .pytest_cache .ruff_cache .next target .obsidian".split())
MAX_BYTES = 2_000_000
#: Roles whose turns count as spoken, and kinds of blocks that hold what was said.
SPOKEN = ("user", "assistant", "system", "human", "ai", "")
BLOCKS = ("text", "output_text", "input_text")


class MissingPrerequisite(ValueError):
    code = "missing_prerequisite"


class NetworkOff(ValueError):
    code = "invalid_input"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(uri, name, suffix, content) of a folder's files in all its folders, but for hidden and skipped names below it, other suffixes and oversized files. A path to one file takes it whatever its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= MAX_BYTES)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    root = F.rtrim(plain(F.lit(path)), F.lit("/"))
    below = F.when(plain(F.col("path")) == root, F.array()).otherwise(F.split(F.substring(plain(F.col("path")), F.length(root) + 2, F.length("path")), "/"))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.rlike(r".\.[^.]+$"), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    fine = F.forall(below, lambda x: ~x.startswith(".") & ~x.isin(*SKIPPED)) & ((F.size(below) == 0) | suffix.isin(*SUFFIXES))
    return files.filter(fine).select(F.col("path").alias("uri"), name.alias("name"), suffix.alias("suffix"), "content")


def decoded(files: DataFrame) -> DataFrame:
    """(uri, title, text) of files(uri, name, suffix, content) by their kind: pages, session logs, PDFs, and all else as UTF-8 with bad bytes replaced. Blank texts go. A PDF needs the pypdf
    package: where a file asks for it and it isn't there, that is an error."""
    pdf = files.filter("suffix = 'pdf'")
    raw = files.filter("suffix <> 'pdf'").select("uri", "name", "suffix", utf8(F.col("content")).alias("raw"))
    page = raw.filter("suffix in ('html', 'htm')").select("uri", "name", strip_html(F.col("raw")).alias("text"))
    log = transcripts(raw.filter("suffix = 'jsonl'").select("uri", "name", "raw"))
    rest = raw.filter("suffix not in ('html', 'htm', 'jsonl')").select("uri", "name", F.col("raw").alias("text"))
    every = page.unionByName(log).unionByName(rest)
    if not pdf.isEmpty():
        try:
            import pypdf  # noqa: F401
        except ImportError:
            raise MissingPrerequisite(f"{pdf.first().uri} is a PDF and pypdf is not installed: install it, or turn the PDF into text first") from None
        every = every.unionByName(pdf.select("uri", "name", pdf_text()(F.col("content")).alias("text")))
    return every.filter(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != "").select("uri", F.col("name").alias("title"), "text")


def utf8(content: Column) -> Column:
    def decode(raw: pa.Array) -> pa.Array:  # nested, so that it is shipped by value
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(content)


def pdf_text():
    def read(raw: pa.Array) -> pa.Array:
        from io import BytesIO

        from pypdf import PdfReader

        return pa.array(["\n\n".join(p.extract_text() or "" for p in PdfReader(BytesIO(x)).pages) for x in raw.to_pylist()], pa.string())

    return F.arrow_udf(read, "string")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(uri, title, text) of a folder's documents; titles are file names."""
    return decoded(scan(spark, path))


def inline(spark: SparkSession, text: str, uri: str = "", title: str = "") -> DataFrame:
    """One document that is given as text."""
    row = spark.createDataFrame([(uri, title or "pasted text", text)], "uri string, title string, text string")
    return row.withColumn("uri", F.coalesce(F.nullif("uri", F.lit("")), F.concat(F.lit("text:"), F.substring(F.sha2("text", 256), 1, 12))))


def lines_in(spark: SparkSession, stream, title: str = "standard input") -> DataFrame:
    """One document from an open text stream, such as sys.stdin."""
    return inline(spark, stream.read(), "stdin:", title)


def fetched(pages: DataFrame, allow_network: bool = False) -> DataFrame:
    """(uri, title, text) of web pages(url, html). Pages without html would have to be fetched; that is refused unless `allow_network`, and then done in the tasks. A page without a title is named by
    its address."""
    if not allow_network and not (missing := pages.filter("html is null")).isEmpty():
        raise NetworkOff(f"{missing.first().url} is a web address and fetching is off")
    html = F.col("html") if not allow_network else F.coalesce("html", fetch()(F.col("url")))
    return pages.select(F.col("url").alias("uri"), F.coalesce(html_title(html), "url").alias("title"), strip_html(html).alias("text"))


def fetch():
    def read(urls: pa.Array) -> pa.Array:
        from urllib.request import urlopen

        out = []
        for url in urls.to_pylist():
            with urlopen(url, timeout=30) as reply:
                out.append(reply.read(MAX_BYTES).decode(reply.headers.get_content_charset() or "utf-8", "replace"))
        return pa.array(out, pa.string())

    return F.arrow_udf(read, "string")


def transcripts(raw: DataFrame) -> DataFrame:
    """raw(uri, raw, ...) with text in place of raw: of session logs the spoken turns as `role: text`, blank lines between. Lines that aren't JSON objects are skipped, so are other roles (as they are
    spelled) and blocks that aren't text; the raw text if no turn is left."""
    trim = lambda c: F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
    lines = raw.select("uri", F.posexplode(F.split("raw", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("line", "l")).withColumn("l", trim(F.col("l"))).filter(F.col("l").startswith("{")).withColumn("j", F.try_parse_json("l"))
    get = lambda v, path: F.try_variant_get(v, path, "string")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("j", path, "variant")), F.lit(""))
    inside = kind("$.message").startswith("OBJECT")
    either = lambda path: F.when(inside, F.try_variant_get("j", f"$.message.{path}", "variant")).otherwise(F.try_variant_get("j", f"$.{path}", "variant"))
    filled = lambda c: F.nullif(c, F.lit(""))
    role = F.coalesce(filled(get(either("role"), "$")), filled(get("j", "$.type")), F.lit(""))
    # an object's own text stands in only where it has no content at all
    content = F.when(F.schema_of_variant(either("content")).isNull(), either("text")).otherwise(either("content"))
    is_text = lambda b: F.schema_of_variant(b) == "STRING"
    block_kind = lambda b: F.try_variant_get(b, "$.type", "string")
    block = lambda b: F.when(is_text(b), get(b, "$")).when(block_kind(b).isNull() | block_kind(b).isin(*BLOCKS), get(b, "$.text"))
    listed = F.filter(F.transform(F.try_variant_get("c", "$", "array<variant>"), block), lambda x: F.coalesce(x, F.lit("")) != "")
    said = F.when(F.schema_of_variant("c") == "STRING", trim(get("c", "$"))).when(F.schema_of_variant("c").startswith("ARRAY"), trim(F.array_join(listed, "\n")))
    turns = lines.select("uri", "line", role.alias("role"), content.alias("c")).select("uri", "line", "role", said.alias("said")).filter(F.col("role").isin(*SPOKEN) & (F.coalesce("said", F.lit("")) != ""))
    return raw.join(spoken(turns, "uri", "line"), "uri", "left").withColumn("text", F.coalesce("text", "raw")).drop("raw")


def spoken(turns: DataFrame, key: str, place: str) -> DataFrame:
    """(key, text): a conversation's turns(key, place, role, said) in order."""
    line = F.when(F.col("role") == "", F.col("said")).otherwise(F.concat_ws(": ", "role", "said"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), line.alias("line")))).alias("t")).select(key, F.array_join(F.transform("t", lambda x: x["line"]), "\n\n").alias("text"))


#: Names that relation items use for their parts, the first that is filled counts.
FROM, TO = ("node_1", "from", "subject", "source"), ("node_2", "to", "object", "target")
RELATION = "seq int, source_label string, target_label string, source string, relation string, target string, description string, confidence double, source_type string, target_type string, evidence string, valid_from string, valid_to string, chunk string, method string, skipped string"


def relation_items(items: DataFrame) -> DataFrame:
    """RELATION rows of items(seq, e), e a variant: what counts as the two concepts, the relation and its particulars. Bad items keep their reason in `skipped`."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.btrim(F.try_variant_get("e", f"$.{n}", "string")), F.lit("")) for n in names])
    kind = lambda *names: F.nullif(F.substring(F.regexp_replace(F.lower(pick(*names)), r"(?U)\s+", "_"), 1, 40), F.lit(""))
    rows = items.select("seq", pick(*FROM).alias("source_label"), pick(*TO).alias("target_label"), pick("relation", "predicate", "type").alias("r"), F.coalesce(pick("edge", "description"), F.lit("")).alias("description"), confidence(pick("confidence")).alias("confidence"), kind("node_1_type", "from_type").alias("source_type"), kind("node_2_type", "to_type").alias("target_type"), F.coalesce(pick("evidence"), F.lit("")).alias("evidence"), pick("valid_from").alias("valid_from"), pick("valid_to").alias("valid_to"), pick("chunk", "chunk_id").alias("chunk"), pick("method").alias("method"))
    keyed = rows.withColumns({"source": node_key(F.col("source_label")), "relation": F.coalesce(relation_key(F.col("r")), F.lit("related_to")), "target": node_key(F.col("target_label"))})
    missing = F.coalesce("source", F.lit("")).isin("") | F.coalesce("target", F.lit("")).isin("") | (F.col("source") == F.col("target"))
    named = keyed.withColumn("skipped", F.when(missing, "a relation needs two different concepts (from, to)"))
    return named.select(*[x.split()[0] for x in RELATION.split(", ")])


def relations(spark: SparkSession, path: str) -> DataFrame:
    """RELATION rows of a JSON payload: an object with edges and triples, or a list of items."""
    return relation_items(payload(spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))))


def payload(raw: DataFrame) -> DataFrame:
    """(seq, e) of raw(j): its items, edges before triples."""
    of = lambda p: F.coalesce(F.try_variant_get("j", p, "array<variant>"), F.array().cast("array<variant>"))
    return raw.select(F.posexplode(F.concat(of("$"), of("$.edges"), of("$.triples"))).alias("seq", "e"))


def checked_triples(raw: DataFrame) -> DataFrame:
    """RELATION rows of a model's reply raw(j): a list, or an object that holds one as triples, relations, edges or items. No list at all, or a list without a good item though it isn't empty, is an error."""
    of = lambda p: F.try_variant_get("j", p, "array<variant>")
    listed = raw.select(F.coalesce(of("$"), of("$.triples"), of("$.relations"), of("$.edges"), of("$.items")).alias("l"))
    if not listed.filter("l is null").isEmpty():
        raise ValueError("expected a JSON list of relations")
    rows = relation_items(listed.select(F.posexplode("l").alias("seq", "e")))
    good = rows.filter("skipped is null")
    if good.isEmpty() and not rows.isEmpty():
        raise ValueError("no relation in the list has two different concepts")
    return good


def pages(table: DataFrame) -> DataFrame:
    """(uri, title, text) of fetched pages(url, html)."""
    return fetched(table.filter("html is not null"))


def latest(sources: DataFrame) -> DataFrame:
    """The last version of each uri."""
    return sources.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy(F.col("at").desc()))).filter("r = 1").drop("r")
