"""Sources: page lists, layout JSON, OCR tables, review JSON, figure images."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings, and what starts a title or a panel caption.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
TITLE, CAPTION = r"(?i)\b(?:Supplementary\s+)?Figure\s+\d+\.?", r"\b[A-Z](?:-[A-Z])?\."
LAYOUT = "page_count INT, pages ARRAY<STRUCT<page INT, width DOUBLE, height DOUBLE, text STRING, matches ARRAY<STRUCT<kind STRING, text STRING, index INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE>>>>"


def input_kind(paths: list[str]) -> str:
    """pdf for exactly one PDF, image for images only; anything else is an error."""
    endings = [p.rpartition(".")[2].lower() for p in paths]
    if endings == ["pdf"]:
        return "pdf"
    if endings and all(e in IMAGES for e in endings):
        return "image"
    raise ValueError("give one PDF, or images only")


def expand_pages(df: DataFrame, key: str, spec: str, n_pages: str) -> DataFrame:
    """key, page for lists like "1,3-5": blank means all, what can't be read is skipped, pages are clamped and distinct."""
    tokens = df.select(key, F.col(n_pages).alias("n"), F.explode(F.split(F.when(F.trim(spec) == "", F.concat(F.lit("1-"), n_pages)).otherwise(F.col(spec)), ",")).alias("t"))
    ends = tokens.withColumn("m", F.regexp_extract_all(F.trim("t"), F.lit(r"^(\d+)(?:\s*-\s*\d+)?$"), F.lit(1))).withColumn("a", F.get("m", F.lit(0)).try_cast("int"))
    ends = ends.withColumn("b", F.coalesce(F.nullif(F.regexp_extract(F.trim("t"), r"-\s*(\d+)$", 1), F.lit("")).try_cast("int"), F.col("a"))).where("a IS NOT NULL")
    low, high = F.greatest(F.lit(1), F.col("a")), F.least(F.col("n"), F.col("b"))
    return ends.withColumn("low", low).withColumn("high", high).where("low <= high").select(key, F.explode(F.sequence("low", "high")).alias("page")).distinct()


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """A row for each match of a layout file."""
    pages = spark.read.schema(LAYOUT).json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.page", "p.width", "p.height", "p.text", "p.matches")
    return pages.select("page", "width", "height", F.explode("matches").alias("m")).select("page", "width", "height", "m.*")


def layout_matches(text: Column) -> Column:
    """array<struct<kind, text>> of titles and panel captions in a line."""
    find = lambda kind, p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    return F.concat(find("figure_title", TITLE), find("panel_caption", CAPTION))


def read_ocr(spark: SparkSession, path: str, scale: float = 2.0) -> DataFrame:
    """text, conf, wbox of an OCR table; rows with blank texts, bad numbers or negative confidence are dropped."""
    from .adapters import parsed_words

    raw = spark.read.csv(path, sep="\t", header=True, quote="").withColumn("w", F.monotonically_increasing_id())
    return parsed_words(raw, [], scale).drop("w")


def tolerant_object(text: Column) -> Column:
    """The JSON object a text is or holds between its first { and last }, as VARIANT; else null."""
    whole, inner = F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review items of files that are a list, {"reviews": [...]}, {"results": [...]} or one object each; seq is their order, by file name, then place."""
    item = "ARRAY<STRUCT<aggregate_id STRING, status STRING, confidence STRING, rationale STRING, checked_image STRING, model STRING, agent STRING>>"
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    listed = F.coalesce(F.from_json("value", item), F.lit(None).cast(item))
    held = F.from_json("value", f"reviews {item}, results {item}")
    single = F.array(F.from_json("value", item[len("ARRAY<") : -1].replace("STRUCT<", "STRUCT<")))
    trimmed = F.ltrim(F.col("value"))
    items = F.when(trimmed.startswith("["), listed).otherwise(F.coalesce(held["reviews"], held["results"], single))
    return text.select("file", F.posexplode(items).alias("place", "x")).where("x IS NOT NULL").select(F.struct("file", "place").alias("seq"), "x.*")


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """figure (from 1, in the given order), name and the decoded image of each path; WebP has no reader in Spark."""
    plain = lambda p: re.sub("^file:/*", "/", p if ":" in p else "/" + p.lstrip("/"))
    order = spark.createDataFrame([(k, plain(p), p.rpartition("/")[2]) for k, p in enumerate(paths, 1)], "figure int, path string, name string")
    images = spark.read.format("image").option("dropInvalid", True).load(paths).withColumn("path", F.regexp_replace(F.url_decode("image.origin"), "^file:/*", "/"))
    return images.join(F.broadcast(order), "path").select("figure", "name", "image")  # as many rows as paths are given
