"""Search results, page sources, request bodies and images as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_page_text, html_to_text, truncate, word_count
from ..functions.urls import canonical_url, domain_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; where none has been written, an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def normalise_results(raw: DataFrame, limit: int) -> DataFrame:
    """http(s) results, first of each address, clamped; ranks keep the gaps of dropped rows. At most ``limit`` for each query."""
    address = F.regexp_replace(F.lower(F.regexp_replace("url", r"[?#].*$", "")), "/+$", "")
    kept = raw.where(F.col("url").rlike(r"^(?i:https?)://")).withColumn("_address", address)
    first = Window.partitionBy("question_id", "query", "_address").orderBy("ordinal")
    count = Window.partitionBy("question_id", "query").orderBy("ordinal")
    once = kept.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").withColumn("_nth", F.row_number().over(count)).where(F.col("_nth") <= limit)
    return once.select(
        "question_id", "query", "provider", "url", F.substring("title", 1, 300).alias("title"), F.substring("snippet", 1, 1500).alias("snippet"),
        F.substring("raw_content", 1, 80_000).alias("raw_content"), "score", (F.col("ordinal") + 1).alias("rank"),
    )


def page_text(raw: Column, limit: int = 14_000) -> Column:
    """Text of a page or of plain content, cleaned and cut. Python sees all rows, so it is given the pages only."""
    html = raw.rlike(r"(?i)<(?:html|body|p|div|article)\b")
    return truncate(clean_page_text(F.when(html, html_to_text(F.when(html, raw))).otherwise(raw)), limit)


def fetch_priority(domain: Column, url: Column, score: Column, snippet: Column) -> Column:
    """How early a page is worth reading, from its address, score and snippet."""
    flag = lambda c, v: F.when(c, F.lit(float(v))).otherwise(F.lit(0.0))
    return (
        F.coalesce(score, F.lit(0.0)) * 10 + flag(domain.rlike(r"(?i)manufacturer|samsung|apple|support\."), 4) + flag(domain.rlike("(?i)repair|parts|supplier|spare|mobile|gsm|fix"), 3)
        + flag(domain.rlike("(?i)forum|reddit|stackexchange|quora"), 1) + flag(url.rlike(r"(?i)\.(pdf|zip|jpg|png)$"), -5) + flag(F.length(snippet) > 120, 1)
    )


def select_sources(results: DataFrame, max_pages: int) -> DataFrame:
    """Results with ``how`` they are read: inline content first, then fetches by priority up to the budget, else the snippet."""
    inline = F.length(F.coalesce("raw_content", F.lit(""))) > 0
    by = Window.partitionBy("question_id")
    order = Window.partitionBy("question_id", "_inline").orderBy(F.desc("priority"), "ordinal")
    counted = results.withColumn("_inline", inline).withColumn("_budget", F.greatest(F.lit(0), F.lit(max_pages) - F.count_if(F.col("_inline")).over(by)))
    how = F.when(F.col("_inline"), "inline").when(F.row_number().over(order) <= F.col("_budget"), "fetch").otherwise("snippet")
    return counted.withColumn("how", how).drop("_inline", "_budget")


#: Why a source is only a snippet.
NO_BUDGET, NO_PAGE = "beyond the budget of pages", "the page could not be read"


def read_results(results: DataFrame, pages: DataFrame, max_pages: int) -> DataFrame:
    """Results (question_id, ordinal, url, snippet, raw_content, perhaps score) with what is read of them: raw_content, fetched, how and failure.

    Results with contents keep them. Of the others the most promising are read from ``pages`` (canonical, content, failure), as far as the budget of the question
    goes; the rest, and pages that could not be read, are left with the snippet and a ``failure`` that says why. Of several contents of an address the greatest counts.
    """
    c = F.col
    score = c("score") if "score" in results.columns else F.lit(None).cast("double")
    ranked = results.withColumns({"priority": fetch_priority(domain_of(c("url")), c("url"), score, F.coalesce("snippet", F.lit(""))), "_canonical": canonical_url(c("url"))})
    known = pages.groupBy(c("canonical").alias("_canonical")).agg(F.max(F.nullif("content", F.lit(""))).alias("_content"), F.max("failure").alias("_failure"))
    planned = select_sources(ranked, max_pages).join(known, "_canonical", "left")
    read = (c("how") == "fetch") & (F.coalesce(c("_content"), F.lit("")) != "")
    failure = F.when((c("how") == "fetch") & ~read, F.coalesce(c("_failure"), F.lit(NO_PAGE))).when(c("how") == "snippet", NO_BUDGET)
    return planned.withColumns({"raw_content": F.when(read, c("_content")).when(c("how") == "inline", c("raw_content")), "fetched": read, "failure": failure}).drop("_canonical", "_content", "_failure", "priority")


def with_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("n_words", word_count(F.col(text)))


#: First bytes of image types, in hexadecimal (fixed values).
MAGIC = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "image/webp": "52494646", "image/heic": "66747970"}


def image_type(content: Column) -> Column:
    """MIME type by the first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith(MAGIC["image/jpeg"]), "image/jpeg")
        .when(head.startswith(MAGIC["image/png"]), "image/png")
        .when(head.startswith(MAGIC["image/webp"]) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.substring(head, 9, 8) == MAGIC["image/heic"], "image/heic")
    )


#: Most characters of a request's fields, fewest of a question, the modes it may name, and fields of which it has one at least (fixed values).
REQUEST_LIMITS = {"question": 500, "device": 120, "modelNumber": 60, "part": 120, "partNumber": 60}
SHORTEST_QUESTION, REQUEST_MODES, ASKING = 3, ("auto", "phone", "part", "compatibility", "identify"), ("question", "device", "partNumber", "part")
MOST_UPLOAD = 6_000_000


def parse_requests(bodies: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """Bodies that are valid requests, as ``request`` with trimmed fields and a mode, and the others with a ``fault``.

    A request is a JSON object with a question, a device, a part or a part number. A question that is given has three characters or more, no field
    is longer than REQUEST_LIMITS, and a mode is a known one.
    """
    c = F.col
    read = bodies.withColumn("_raw", F.from_json(c(body), ", ".join(f"{n} string" for n in (*REQUEST_LIMITS, "mode"))))
    fields = [F.trim(c(f"_raw.{n}")).alias(n) for n in REQUEST_LIMITS]
    trimmed = read.withColumn("request", F.when(c("_raw").isNotNull(), F.struct(*fields, F.coalesce("_raw.mode", F.lit("auto")).alias("mode"))))
    long = F.array_compact(F.array(*[F.when(F.length(c(f"request.{n}")) > most, F.lit(n)) for n, most in REQUEST_LIMITS.items()]))
    asks = F.coalesce(*[F.nullif(c(f"request.{n}"), F.lit("")) for n in ASKING]).isNotNull()
    short = F.coalesce(F.length(c("request.question")) < SHORTEST_QUESTION, F.lit(False))
    fault = (
        F.when(c("request").isNull() | ~c(body).rlike(r"^\s*\{"), "no JSON object").when(short, "the question is too short").when(~asks, "nothing is asked")
        .when(F.size(long) > 0, F.concat(F.lit("too long: "), F.array_join(long, ", "))).when(~c("request.mode").isin(*REQUEST_MODES), "no such mode")
    )
    told = trimmed.withColumn("fault", fault).drop("_raw")
    return told.where("fault is null").drop("fault"), told.where("fault is not null").drop("request")


def accept_images(uploads: DataFrame, content: str, declared: str, most: int = MOST_UPLOAD) -> DataFrame:
    """Uploads with ``type`` by their first bytes, ``key`` and ``fault``: too large, of no known type, or of another type than is declared."""
    c = F.col
    kind = image_type(c(content))
    said = F.lower(F.trim(F.split(c(declared), ";")[0]))
    same = F.when(said == "image/jpg", "image/jpeg").otherwise(said)
    fault = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty").when(F.length(content) > most, "too large").when(kind.isNull(), "no image").when(same != kind, "not of the declared type")
    return uploads.withColumns({"type": kind, "key": F.sha2(c(content), 256), "fault": fault})
