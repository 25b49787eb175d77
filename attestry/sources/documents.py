"""Document sources: reading, media-type routing, decoding and content updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import text as T

WS = T.WS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out before heavy text work, over as many tasks as the session asks for.

    Only where ``spark.attestry.textPartitions`` is set, for tables of one or two large row groups;
    otherwise the scan's own splits are used.
    """
    parts = df.sparkSession.conf.get("spark.attestry.textPartitions", None)
    return df.repartition(int(parts)) if parts else df


def with_checksum(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("checksum", F.sha2(F.col(content), 256))


def with_defaults(df: DataFrame, title: str = "untitled", source: str = "api") -> DataFrame:
    """Fill a missing title or source as the upload form does."""
    for name, value in (("title", title), ("source", source)):
        have = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.when(T.is_blank(have), F.lit(value)).otherwise(have))
    return df


def read_documents(
    spark: SparkSession, path: str, fmt: str = "parquet", mime: str | None = None
) -> DataFrame:
    """Rows with ``content``, ``mime_type``, ``title``, ``source`` and ``checksum``.

    ``fmt="binaryFile"`` reads one file per row; other formats need a ``text`` or ``content``
    column.
    """
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
        guess = F.create_map(
            *[
                F.lit(x)
                for pair in (
                    ("md", "text/markdown"), ("txt", "text/plain"), ("html", "text/html"),
                    ("htm", "text/html"), ("pdf", "application/pdf"), ("csv", "text/csv"),
                )
                for x in pair
            ]
        )
        df = files.select(
            F.col("path"),
            "content",
            F.regexp_extract("path", r"([^/]+)$", 1).alias("title"),
            F.coalesce(
                F.lit(mime).cast("string"), F.try_element_at(guess, extension), F.lit("")
            ).alias("mime_type"),
        )
    else:
        df = spark.read.format(fmt).load(path)
        if "content" not in df.columns:
            df = df.withColumn("content", F.encode("text", "UTF-8"))
        if "mime_type" not in df.columns:
            df = df.withColumn("mime_type", F.lit(mime or "text/plain"))
    return with_checksum(with_defaults(df))


def media_type(mime: Column) -> Column:
    return T.js_trim(F.split(mime, ";")[0])


#: Parsers by media type that were registered besides the built-in ones.
ROUTES: dict[str, str] = {}


def route_by_mime(df: DataFrame, mime: str = "mime_type", office: bool = False) -> DataFrame:
    """``parser`` per row, or ``parse_error`` instead of a failed job.

    Office files need an external converter; pass ``office=True`` when its output is at hand.
    """
    base = media_type(F.col(mime))
    is_office = base.isin(fixed.OFFICE_MIME)
    parser = (
        F.when(is_office & F.lit(office), "office")
        .when(base.isin(fixed.TEXT_MIME), "plaintext")
        .when(base.isin(fixed.HTML_MIME), "html")
    )
    for media, name in ROUTES.items():
        parser = F.when(base == media, name).otherwise(parser)
    error = F.when(parser.isNotNull(), None).when(is_office, "PARSER_UNAVAILABLE").otherwise(
        "UNSUPPORTED_MIME"
    )
    return df.withColumn("parser", parser).withColumn("parse_error", error)


def decode_text(df: DataFrame, content: str = "content", mime: str = "mime_type") -> DataFrame:
    """S3: lossy UTF-8 decode with LF line ends; ``is_markdown``; blank text is an error."""
    decoded = F.make_valid_utf8(F.col(content).cast("string"))
    text = T.replace(T.replace(decoded, r"\A\uFEFF"), r"\r\n", "\n")
    blank = T.is_blank(F.col("text"))
    df = df.withColumn("text", text).withColumn(
        "is_markdown", F.contains(media_type(F.col(mime)), F.lit("markdown"))
    )
    error = F.when(blank, "EMPTY_OUTPUT")
    if "parse_error" in df.columns:
        error = F.coalesce(F.col("parse_error"), error)
    return df.withColumn("parse_error", error)


_HTML_STEPS = [
    (r"<!--[\s\S]*?-->", ""),
    (r"(?i)<(script|style|head)[\s\S]*?</\1>", ""),
    (r"(?i)</(?:p|div|section|article|li|h[1-6]|tr|br)>", "\n"),
    (rf"(?i)<br[{WS}]*/?>", "\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def html_to_text(html: Column | str) -> Column:
    """Readable text of a page as a column expression."""
    text = T.col(html)
    for pattern, to in _HTML_STEPS:
        text = T.replace(text, pattern, to)
    return T.js_trim(text)


PARSERS = {"plaintext": lambda c: c, "html": html_to_text}


def parse_documents(df: DataFrame) -> DataFrame:
    """S1-S4 together: route, decode, parse. ``text`` is null where ``parse_error`` is set.

    The parser that a row was routed to is looked up among the registered ones.
    """
    routed = decode_text(route_by_mime(df))
    text = F.col("text")
    for name, expression in PARSERS.items():
        if name != "plaintext":
            text = F.when(F.col("parser") == name, expression(F.col("text"))).otherwise(text)
    return routed.withColumn("text", F.when(F.col("parse_error").isNull(), text))


def register_parser(name: str, expression, *media_types: str) -> None:
    """Plug point: a parser is a column expression from decoded text to text, used for its media types."""
    PARSERS[name] = expression
    ROUTES.update({media: name for media in media_types})


_DERIVED = [
    "cleaned_text", "parsed_markdown", "normalized_hash", "content_tokens", "quality_score",
    "quality_report", "parser_used", "duplicate_of", "rejected_reason",
]


def update_document_content(
    documents: DataFrame, updates: DataFrame, id_col: str = "doc_id"
) -> DataFrame:
    """Same checksum leaves a row alone; new bytes raise the version and reset derived columns.

    Both sides need ``id_col`` and ``checksum``; ``updates`` may carry ``text`` and ``title``.
    """
    carried = [c for c in updates.columns if c in documents.columns and c != id_col]
    new = updates.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in carried])
    joined = documents.join(new, id_col, "left")
    changed = F.col("_new_checksum").isNotNull() & (F.col("_new_checksum") != F.col("checksum"))
    joined = joined.withColumn("_changed", changed)
    out = []
    for name in documents.columns:
        kept = F.col(name)
        if name in carried:
            kept = F.when(F.col("_changed"), F.coalesce(f"_new_{name}", name)).otherwise(kept)
        elif name == "version":
            kept = F.when(F.col("_changed"), kept + 1).otherwise(kept)
        elif name == "status":
            kept = F.when(F.col("_changed"), F.lit("QUEUED")).otherwise(kept)
        elif name == "transformations":
            kept = F.when(F.col("_changed"), F.array().cast("array<string>")).otherwise(kept)
        elif name in _DERIVED:
            kept = F.when(~F.col("_changed"), kept)
        out.append(kept.alias(name))
    return joined.select(
        *out, (F.col("_new_checksum").isNotNull() & ~F.col("_changed")).alias("unchanged")
    )
