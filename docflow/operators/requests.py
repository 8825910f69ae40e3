"""Rule checks on requests and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import trim_space
from docflow.operators.ordered import first_rows

# Tools in catalog order with output extension (none where the tool writes to
# a folder).
TOOLS = (
    ("Merge", ".pdf"),
    ("Split", None),
    ("Organize", ".pdf"),
    ("Rotate", ".pdf"),
    ("PdfToWord", ".docx"),
    ("WordToPdf", ".pdf"),
    ("PdfToImage", None),
    ("ImageToPdf", ".pdf"),
    ("PdfToExcel", ".xlsx"),
    ("PdfToPowerPoint", ".pptx"),
    ("Compress", ".pdf"),
    ("Protect", ".pdf"),
    ("Unlock", ".pdf"),
    ("Watermark", ".pdf"),
    ("PageNumbers", ".pdf"),
    ("OcrToWord", ".docx"),
    ("BackgroundRemover", ".png"),
)
FOLDER_TOOLS = [t for t, ext in TOOLS if ext is None]
DEFAULT_LANGUAGES = "uzb+eng+rus"


def _blank(c: Column) -> Column:
    return c.isNull() | (trim_space(c) == "")


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def language_codes(expr: Column, default: str = DEFAULT_LANGUAGES) -> Column:
    """Codes of ``a+b+c`` in order, each once ignoring case; the default when none is left."""

    def codes(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, r"\+"), trim_space), lambda p: p != "")
        start = F.array().cast("array<string>")
        return F.aggregate(
            parts,
            start,
            lambda acc, p: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(p)), acc).otherwise(
                F.concat(acc, F.array(p))
            ),
        )

    asked = codes(F.coalesce(expr, F.lit("")))
    return F.when(F.size(asked) > 0, asked).otherwise(codes(F.lit(default)))


def installed_languages(files: DataFrame, suffix: str = ".traineddata") -> DataFrame:
    """Language codes on disk, distinct ignoring case, in order."""
    name = F.substring(F.col("file"), F.lit(1), F.length("file") - len(suffix))
    found = files.where(F.lower("file").endswith(suffix)).select(F.lower(name).alias("code"))
    return found.where("trim(code) <> ''").distinct().orderBy("code")


def missing_languages(requests: DataFrame, installed: DataFrame, key: str, expr: str) -> DataFrame:
    """Requested codes that are not installed."""
    asked = requests.select(key, F.explode(language_codes(F.col(expr))).alias("code"))
    have = installed.select(F.lower("code").alias("__have")).distinct()
    return asked.join(have, F.lower("code") == F.col("__have"), "left_anti")


def missing_component(requests: DataFrame, installed: DataFrame, model_available: bool) -> DataFrame:
    """Which downloadable component each request lacks: ``languages``, ``model`` or none."""
    tool = F.col("tool")
    reads_scans = (tool == "OcrToWord") | (
        (tool == "PdfToWord") & F.col("has_options") & (F.col("recognition") != "TextLayerOnly")
    )
    asked = requests.where(reads_scans).withColumn(
        "languages", F.when(F.col("has_options"), F.col("languages"))
    )
    lacking = missing_languages(asked, installed, "request_id", "languages").select("request_id").distinct()
    flagged = requests.join(lacking.withColumn("__lacks", F.lit(True)), "request_id", "left")
    component = (
        F.when(F.col("__lacks"), "languages")
        .when((tool == "BackgroundRemover") & F.lit(not model_available), "model")
        .otherwise("none")
    )
    return flagged.withColumn("component", component).drop("__lacks")


def first_missing_file(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Input count and the first input that does not exist, per request."""
    known = manifest.select(F.lower("path").alias("__known")).distinct()
    looked = files.join(known, F.lower("path") == F.col("__known"), "left")
    return looked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_inputs"),
        F.min_by("path", F.when(F.col("__known").isNull(), F.col("seq"))).alias("missing_file"),
    )


def request_rules(
    requests: DataFrame, files: DataFrame, manifest: DataFrame, installed: DataFrame,
    model_available: bool = False, word_available: bool = False,
) -> DataFrame:
    """The first violated rule of each request, null for a valid one."""
    c = F.col
    tool, options = c("tool"), c("has_options")
    inputs = F.coalesce(c("n_inputs"), F.lit(0))
    no_plan = F.coalesce(c("plan_rows"), F.lit(0)) == 0
    user = F.when(options, F.coalesce("user_password", "password")).otherwise(c("password"))
    owner = F.when(options, c("owner_password"))
    to_folder = tool.isin(*FOLDER_TOOLS)
    rules = (
        (inputs == 0, "no_input"),
        (c("missing_file").isNotNull(), "file_not_found"),
        (to_folder & _blank(c("output_folder")), "no_output_folder"),
        (~to_folder & _blank(c("output_path")), "no_output_file"),
        ((tool == "Merge") & (inputs < 2) & no_plan, "merge_needs_two"),
        ((tool == "Unlock") & _empty(c("password")), "password_needed"),
        ((tool == "Protect") & _empty(user) & _empty(owner), "no_protection"),
        ((tool == "Rotate") & options & ~c("apply_to_all") & no_plan, "no_page_selection"),
        ((tool == "Split") & options & (c("split_mode") == "Ranges") & _blank(c("range_expression")), "no_ranges"),
        ((tool == "Split") & options & (c("split_mode") == "FixedChunks") & (c("pages_per_file") < 1), "bad_chunk"),
        ((tool == "Watermark") & options & _blank(c("watermark_text")), "no_watermark_text"),
        (
            (tool == "WordToPdf") & options & (c("engine") == "MicrosoftWord") & F.lit(not word_available),
            "word_not_available",
        ),
        (c("component") == "languages", "languages_missing"),
        (c("component") == "model", "model_missing"),
    )
    checked = missing_component(requests, installed, model_available).join(
        first_missing_file(files, manifest), "request_id", "left"
    )
    return checked.select(
        "request_id", "tool", F.coalesce(*(F.when(bad, F.lit(name)) for bad, name in rules)).alias("violation")
    )


def batch_outcome(items: DataFrame, keys: list[str]) -> DataFrame:
    """Succeeded and failed items per batch, and how the batch ended."""
    counted = items.groupBy(*keys).agg(
        F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    outcome = F.when(F.col("failed") == 0, "all_ok").when(F.col("ok") == 0, "all_failed").otherwise("partly")
    return counted.withColumn("outcome", outcome)
