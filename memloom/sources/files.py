"""File and text sources: repositories, pages, JSON events, and vectors made from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_repository(spark: SparkSession, root: str, space_id: str, include: list[str] | None = None, exclude: list[str] | None = None, since: str | None = None, largest: int | None = None) -> DataFrame:
    """(space_id, file_path, content, modified): the text files below ``root``.

    ``include`` and ``exclude`` are file endings (``.py``) and folder names;
    ``since`` keeps files modified at or after that time; files above ``largest``
    bytes, if that is given, or with a zero byte are left out.  Size, time and name are decided
    before a file is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = files.withColumn("file_path", F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace("\\", "/").split("/")[-1] + "/", ""))
    if largest is not None:
        base = base.where(F.col("length") <= largest)
    if since is not None:
        base = base.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    if include:
        base = base.where(F.exists(F.array(*[F.lit(e) for e in include]), lambda e: F.col("file_path").endswith(e)))
    for name in exclude or []:
        base = base.where(~F.col("file_path").endswith(name) & ~F.concat(F.lit("/"), F.col("file_path")).contains(f"/{name}/"))
    text = base.withColumn("content", F.decode("content", "utf-8")).where(~F.col("content").contains("\x00"))
    return text.select(F.lit(space_id).alias("space_id"), "file_path", "content", F.col("modificationTime").alias("modified"))


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and tags off, headings as Markdown, entities of the five signs resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<(br|/p|/div|/li)[^>]*>", "\n"), r"<[^>]+>", "")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"), F.lit(" \n"))


def read_json_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of JSON lines; a row that does not fit the schema keeps its text in ``_corrupt`` instead of stopping the read."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector of hashed word counts with signs: the offline stand-in for an embedding; no words give zeros."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    zero = F.array_repeat(F.lit(0.0), dim)

    def add(acc, w):
        at = F.pmod(F.xxhash64(w), F.lit(dim))
        sign = F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        return F.transform(acc, lambda x, i: F.when(i == at, x + sign).otherwise(x))

    counts = F.aggregate(F.coalesce(words, F.array().cast("array<string>")), zero, add)
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))
