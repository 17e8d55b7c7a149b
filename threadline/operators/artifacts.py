"""Artifact rows: classification, status, filters, triage, bounds and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import ids, text
from threadline.functions.ordered import with_row_number
from threadline.schemas import ALLOCATION_STATUSES, EXPLORER_BUCKETS, RECOVERY_STATUSES

# Extension groups of the classifier.
DATABASE_EXTENSIONS = [".db", ".sqlite", ".sqlite3"]
OFFICE_EXTENSIONS = [".doc", ".docx", ".rtf", ".txt"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".webp"]
MAIL_EXTENSIONS = [".eml", ".msg", ".mbox"]
SHEET_EXTENSIONS = [".xlsx", ".xls", ".csv"]
MEDIA_EXTENSIONS = [".mp4", ".avi", ".mp3", ".wav"]
DISK_EXTENSIONS = [".raw", ".e01", ".e02", ".dd", ".img"]
# Extension groups of the type inference.
SEEN_IMAGES = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp"]
SEEN_DOCUMENTS = [".pdf", ".docx", ".doc", ".txt", ".rtf", ".md"]
# Extensions worth extracting.
SHORTLIST_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".pdf", ".txt", ".docx", ".doc", ".xlsx", ".xls", ".csv",
    ".db", ".sqlite", ".log", ".eml", ".msg", ".bin", ".json", ".md",
]


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; none for dot files and names without one."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))


def artifact_classify(name: Column, raw_type: Column, raw_mime: Column | None = None) -> Column:
    """Struct (category, mime_type, file_extension, viewer) by the first rule that fits."""
    found = extension(name)
    ext = (
        F.when((found == "") & (raw_type == "PARTITION_TABLE"), ".hdr")
        .when((found == "") & (raw_type == "DATABASE"), ".db")
        .otherwise(found)
    )
    kind = F.coalesce(raw_type, F.lit("OTHER"))

    def row(category: Column | str, mime: Column | str, viewer: str) -> Column:
        category = F.lit(category) if isinstance(category, str) else category
        mime = F.lit(mime) if isinstance(mime, str) else mime
        return F.struct(
            category.alias("category"), mime.alias("mime_type"), ext.alias("file_extension"),
            F.lit(viewer).alias("viewer"),
        )

    # Categories, MIME types and viewers.
    binary = "application/octet-stream"
    default_mime = F.coalesce(F.nullif(raw_mime, F.lit("")), F.lit(binary)) if raw_mime is not None else F.lit(binary)
    picture = (
        F.when(ext.isin(".jpg", ".jpeg"), "jpeg").when(ext != "", F.replace(ext, F.lit("."), F.lit(""))).otherwise("jpeg")
    )
    return (
        F.when(kind == "PARTITION_TABLE", row("PARTITION_TABLE", "application/x-partition-table", "HEX"))
        .when(kind.isin("DELETED_FILE", "DELETED"), row("DELETED_FILE", binary, "HEX"))
        .when(kind == "RECOVERED_FILE", row("RECOVERED_FILE", binary, "HEX"))
        .when(ext.isin(DATABASE_EXTENSIONS) | (kind == "DATABASE"), row("DATABASE", "application/x-sqlite3", "DATABASE"))
        .when((ext == ".pdf") | (kind == "DOCUMENT"), row("DOCUMENT", "application/pdf", "PDF"))
        .when(
            ext.isin(OFFICE_EXTENSIONS),
            row("DOCUMENT", F.when(ext == ".txt", "text/plain").otherwise("application/msword"), "TEXT"),
        )
        .when(ext.isin(IMAGE_EXTENSIONS) | (kind == "IMAGE"), row("IMAGE", F.concat(F.lit("image/"), picture), "IMAGE"))
        .when(ext.isin(MAIL_EXTENSIONS) | (kind == "EMAIL"), row("EMAIL", "message/rfc822", "EMAIL"))
        .when((ext == ".log") | (kind == "LOG"), row("LOG", "text/plain", "TEXT"))
        .when(
            ext.isin(SHEET_EXTENSIONS) | kind.isin("SPREADSHEET", "CDR"),
            row(
                F.when(kind == "CDR", "CDR").otherwise("SPREADSHEET"),
                F.when(ext == ".csv", "text/csv").otherwise("application/vnd.ms-excel"),
                "SPREADSHEET",
            ),
        )
        .when(
            ext.isin(MEDIA_EXTENSIONS) | (kind == "MEDIA"),
            row("MEDIA", F.when(ext == ".mp4", "video/mp4").otherwise("audio/wav"), "MEDIA"),
        )
        .when(
            ext.isin(DISK_EXTENSIONS) | (kind == "FORENSIC_IMAGE"),
            row("FORENSIC_IMAGE", "application/x-forensic-image", "HEX"),
        )
        .otherwise(row("OTHER", default_mime, "HEX"))
    )


def artifact_status(
    raw_type: Column, allocation: Column, is_deleted: Column, recovery: Column, is_recovered: Column, is_carved: Column
) -> Column:
    """Struct (allocation_status, recovery_status): explicit valid values win over flags."""
    alloc = (
        F.when(allocation.isin(ALLOCATION_STATUSES), allocation)
        .when(raw_type == "DELETED_FILE", "DELETED")
        .when(is_deleted, "DELETED")
        .otherwise("ALLOCATED")
    )
    rec = (
        F.when(recovery.isin(RECOVERY_STATUSES), recovery)
        .when((raw_type == "RECOVERED_FILE") | F.coalesce(is_recovered, F.lit(False)), "RECOVERED")
        .when(is_carved, "CARVED")
        .otherwise("NONE")
    )
    return F.struct(alloc.alias("allocation_status"), rec.alias("recovery_status"))


def artifact_id_derive(
    source_id: Column, case_id: Column, evidence_id: Column, job_id: Column, name: Column, trace: Column
) -> Column:
    """The given id, else a deterministic one from the artifact's place."""
    derived = ids.artifact_id(case_id, evidence_id, job_id, name, trace)
    return F.coalesce(F.nullif(source_id, F.lit("")), derived)


def artifact_type_infer(path: Column, allocated: Column) -> Column:
    """Struct (artifact_type, allocation_status, recovery_status) from path words and suffix."""
    low = F.lower(path)
    ext = extension(path)
    carved, recovered, deleted = low.contains("carved"), low.contains("recovered"), low.contains("deleted")
    recovery = F.when(carved, "CARVED").when(recovered, "RECOVERED").otherwise("NONE")
    alloc = F.when(carved | recovered | deleted | ~allocated, "DELETED").otherwise("ALLOCATED")
    kind = (
        F.when(low.contains("cdr"), "CDR")
        .when(ext.isin(MAIL_EXTENSIONS) | low.contains("email"), "EMAIL")
        .when(recovery != "NONE", "RECOVERED_FILE")
        .when(alloc == "DELETED", "DELETED_FILE")
        .when(ext.isin(SEEN_IMAGES), "IMAGE")
        .when(ext.isin(SEEN_DOCUMENTS), "DOCUMENT")
        .when(ext.isin(DATABASE_EXTENSIONS), "DATABASE")
        .when(ext.isin(SHEET_EXTENSIONS), "SPREADSHEET")
        .when(ext == ".log", "LOG")
        .otherwise("OTHER")
    )
    return F.struct(kind.alias("artifact_type"), alloc.alias("allocation_status"), recovery.alias("recovery_status"))


def build_artifacts(raw: DataFrame) -> DataFrame:
    """Contract artifact rows to the artifact table."""
    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast(kind)

    name = F.coalesce(field("artifact_name"), F.lit("unnamed_artifact"))
    kind = F.coalesce(field("artifact_type"), F.lit("OTHER"))
    trace = F.coalesce(field("provenance_trace"), F.concat("job_id", F.lit(":"), F.coalesce(field("artifact_id"), F.lit("None"))))
    ident = artifact_id_derive(field("artifact_id"), F.col("case_id"), F.col("evidence_id"), F.col("job_id"), name, trace)
    classified = artifact_classify(name, kind, field("mime_type"))
    status = artifact_status(
        kind, field("allocation_status"), field("is_deleted", "boolean"), field("recovery_status"),
        field("is_recovered", "boolean"), field("is_carved", "boolean"),
    )
    rows = raw.select(
        ident.alias("artifact_id"), "case_id", "evidence_id", F.col("job_id").alias("processing_job_id"),
        name.alias("filename"), trace.alias("path_within_source"), classified.alias("c"), status.alias("s"),
        F.coalesce(field("size_bytes", "bigint"), F.lit(0)).alias("size_bytes"), field("sha256").alias("sha256"),
        field("created_at").alias("created_at_observed"), field("modified_at").alias("modified_at_observed"),
        field("accessed_at").alias("accessed_at_observed"),
        field("content_path").alias("content_path"),
        F.coalesce(field("engine_name"), F.lit("")).alias("engine_name"),
        F.coalesce(field("engine_version"), F.lit("")).alias("engine_version"),
    )
    chain = F.struct(
        "case_id", "evidence_id", "processing_job_id", "engine_name", "engine_version",
        F.concat(F.lit("EV-"), "evidence_id").alias("source_reference"),
        F.col("path_within_source").alias("observation_reference"),
    )
    place = F.concat_ws("/", "case_id", "processing_job_id", F.concat("artifact_id", "c.file_extension"))
    return rows.select(
        "artifact_id", "case_id", "evidence_id", "processing_job_id", "filename", "path_within_source",
        "c.category", "c.mime_type", "c.file_extension", "size_bytes", "sha256",
        "created_at_observed", "modified_at_observed", "accessed_at_observed",
        "s.allocation_status", "s.recovery_status",
        F.lit("FILE_SYSTEM_PARSE").alias("observation_method"),
        F.col("c.viewer").alias("recommended_viewer"),
        chain.alias("provenance_chain"),
        F.coalesce("content_path", place).alias("content_reference"),
    )


# --- filters and listings ------------------------------------------------------


def artifact_filter(
    artifacts: DataFrame,
    *,
    category: str | None = None,
    mime_type: str | None = None,
    filename: str | None = None,
    allocation_status: str | None = None,
    recovery_status: str | None = None,
    evidence_id: str | None = None,
    processing_job_id: str | None = None,
) -> DataFrame:
    """AND of the given predicates; they reach the scan as pushed filters."""
    result = artifacts
    if category and category.upper() in ("DELETED", "DELETED_FILE"):
        result = result.filter((F.col("allocation_status") == "DELETED") | F.col("category").isin("DELETED", "DELETED_FILE"))
    elif category and category.upper() in ("RECOVERED", "RECOVERED_FILE"):
        result = result.filter(
            F.col("recovery_status").isin("RECOVERED", "CARVED", "PARTIAL")
            | F.col("category").isin("RECOVERED", "RECOVERED_FILE")
        )
    elif category:
        result = result.filter(F.col("category") == category)
    if filename:
        result = result.filter(F.lower("filename").contains(filename.lower()))
    exact = {
        "mime_type": mime_type,
        "allocation_status": allocation_status,
        "recovery_status": recovery_status,
        "evidence_id": evidence_id,
        "processing_job_id": processing_job_id,
    }
    for name, value in exact.items():
        if value:
            result = result.filter(F.col(name) == value)
    return result


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows where any column contains the query, case ignored; a blank query keeps all."""
    needle = query.strip().lower()
    if not needle:
        return df
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return df.filter(hit)


def artifact_search(artifacts: DataFrame, query: str) -> DataFrame:
    return search(artifacts, query, ["filename", "artifact_id", "sha256"])


def case_search(cases: DataFrame, query: str) -> DataFrame:
    return search(cases, query, ["case_id", "name", "created_by", "description"])


def explorer_counts(artifacts: DataFrame) -> DataFrame:
    """Counts of the nine explorer buckets, zeros included."""
    kind = F.upper(F.coalesce("category", F.lit("OTHER")))
    bucket = F.when(kind == "RECOVERED_FILE", "RECOVERED").when(kind.isin(EXPLORER_BUCKETS), kind).otherwise("OTHER")
    counts = artifacts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    buckets = artifacts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in EXPLORER_BUCKETS])).alias("bucket"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


# --- text and image rows -------------------------------------------------------


def text_bounds(pages: DataFrame, max_pages: int | None = None, max_chars: int | None = None, snippet: int = 300) -> DataFrame:
    """Page text with counts over the whole text and a snippet.

    ``pages`` has (artifact_id, page_number, text).  A caller may bound the pages and the
    characters counted, to describe what a reader is shown.
    """
    kept = pages if max_pages is None else pages.filter(F.col("page_number") <= max_pages)
    whole = F.coalesce("text", F.lit(""))
    bounded = whole if max_chars is None else F.substring(whole, 1, max_chars)
    words = F.size(F.filter(F.split(bounded, r"(?U)\s+"), lambda word: word != ""))
    cut = F.lit(False) if max_chars is None else F.length(whole) > max_chars
    tail = F.when(F.length(bounded) > snippet, "...").otherwise("")
    return kept.select(
        "artifact_id", "page_number",
        F.length(bounded).alias("character_count"), words.alias("word_count"), cut.alias("truncated"),
        F.concat(F.substring(bounded, 1, snippet), tail).alias("text_snippet"),
    )


def text_totals(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("pages_inspected"), F.sum("word_count").cast("long").alias("total_words_extracted")
    )


def exif_explode(images: DataFrame) -> DataFrame:
    """One observation per tag of (artifact_id, tags map)."""
    return images.select("artifact_id", F.explode("tags").alias("key", "value")).select(
        F.concat("artifact_id", F.lit("-OBS-EXIF-"), "key").alias("observation_id"),
        "artifact_id", F.lit("IMAGE_EXIF").alias("observation_type"),
        F.concat(F.lit("EXIF:"), "key").alias("location_reference"), "key", "value",
    )


def image_summary(images: DataFrame) -> DataFrame:
    """Dimensions, aspect ratio to three decimals (0 when the height is 0), tag count, GPS flag."""
    ratio = F.when(F.col("height") != 0, F.bround(F.col("width") / F.nullif(F.col("height"), F.lit(0)), 3)).otherwise(0.0)
    tags = F.coalesce(F.size("tags"), F.lit(0))
    return images.select(
        "artifact_id", "width", "height", ratio.alias("aspect_ratio"),
        tags.alias("exif_tag_count"), F.col("has_gps"), ((tags > 0) | F.col("has_gps")).alias("has_exif"),
    )


def image_gps(images: DataFrame) -> DataFrame:
    """Decimal position from degree parts (lat_d, lat_m, lat_s, lat_ref and the same for lon)."""
    def side(name: str) -> Column:
        return text.dms_to_decimal(*[F.col(f"{name}_{part}") for part in ("d", "m", "s", "ref")])

    return images.select("artifact_id", side("lat").alias("latitude"), side("lon").alias("longitude"))


# --- shortlist, priority, format, triage ---------------------------------------


def extraction_shortlist(files: DataFrame, targets: list[str], max_size: int | None = None, keep: int | None = None) -> DataFrame:
    """Files of each image in order of extraction: named targets, then known suffixes, then the rest.

    ``files`` has (image_id, position, path, size).  Files above ``max_size`` are ranked
    like others and marked ``too_large``.  ``keep`` is a caller's bound per image; without
    it all files are ranked, large images in slices.
    """
    low = F.lower("path")
    targeted = F.lit(False)
    for target in targets:
        targeted = targeted | low.contains(target.lower())
    system = low.contains("system volume information")
    orphan = low.contains("$orphanfiles")
    rank = (
        F.when(targeted & ~orphan, 0)
        .when(extension(F.col("path")).isin(SHORTLIST_EXTENSIONS) & ~orphan, 1)
        .otherwise(2)
    )
    large = F.lit(False) if max_size is None else F.col("size") > max_size
    usable = files.filter((F.col("size") > 0) & ~system).withColumn("tier", rank).withColumn("too_large", large)
    if keep is None:
        return with_row_number(usable, ["image_id"], ["tier", "position"], "rank")
    order = Window.partitionBy("image_id").orderBy("tier", "position")
    return usable.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def parse_priority(name: Column, raw_type: Column) -> Column:
    """Databases 0, images 1, documents 2, everything else 3."""
    low, kind = F.lower(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(raw_type, F.lit("")))

    def ends(*suffixes: str) -> Column:
        hit = F.lit(False)
        for suffix in suffixes:
            hit = hit | low.endswith(suffix)
        return hit

    return (
        F.when(low.contains("autopsy.db") | (kind == "DATABASE") | ends(".db", ".sqlite", ".sqlite3"), 0)
        .when((kind == "IMAGE") | ends(".jpg", ".jpeg", ".png", ".tiff", ".webp"), 1)
        .when((kind == "DOCUMENT") | ends(".pdf"), 2)
        .otherwise(3)
    )


def format_sniff(content: Column) -> Column:
    """Format by leading bytes."""
    head = F.hex(F.substring(content, 1, 64))

    # Leading byte signatures.
    signatures = [
        ("PDF", "255044462D"),
        ("PNG", "89504E470D0A1A0A"),
        ("JPEG", "FFD8FF"),
        ("BMP", "424D"),
        ("TIFF", "49492A00"),
        ("TIFF", "4D4D002A"),
        ("GIF", "474946383761"),
        ("GIF", "474946383961"),
        ("SQLITE", "53514C69746520666F726D6174203300"),
        ("EVF", "455646"),
    ]
    result = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    for name, prefix in signatures:
        result = result.when(head.startswith(prefix), name)
    return result.otherwise("UNSUPPORTED")


def parse_triage(files: DataFrame, budget: int | None = None, size_limit: int | None = None) -> DataFrame:
    """Outcome of every file of a parse job.

    ``files`` has (job_id, artifact_id, priority, position, on_disk, size, supported,
    parses).  Budget and size limit are a caller's bounds.  Only successful parses use
    the budget, and the budget is tested before the size, so a job closes at its
    budget-th good file: that file is found with a bounded rank, and everything on disk
    after it is over budget.
    """
    large = F.lit(False) if size_limit is None else F.col("size") > size_limit
    good = F.col("on_disk") & ~large & F.col("supported") & F.col("parses")
    place = F.struct("priority", "position", "artifact_id")
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("priority", "position", "artifact_id"))
    over = F.lit(False)
    if budget is not None:
        first = files.filter(good).select("job_id", "priority", "position", "artifact_id").withColumn("rank", rank)
        closing = first.filter(F.col("rank") <= budget).filter(F.col("rank") == budget).select("job_id", place.alias("closing"))
        files = files.join(closing, "job_id", "left")
        over = F.col("closing").isNotNull() & (place > F.col("closing"))
    outcome = (
        F.when(~F.col("on_disk"), "FILE_NOT_ON_DISK")
        .when(over, "BUDGET_EXCEEDED")
        .when(large, "EXCEEDS_SIZE_LIMIT")
        .when(~F.col("supported"), "UNSUPPORTED_FORMAT")
        .when(~F.col("parses"), "PARSER_ERROR")
        .otherwise("PROCESSED")
    )
    return files.withColumn("outcome", outcome).drop("closing")


def parse_status(
    exists: Column, size: Column, max_size: Column, format_ok: Column, error: Column
) -> Column:
    """Parser status of one file; an error text never fails the job."""
    low = F.lower(error)
    broken = low.contains("corrupt") | low.contains("malformed")
    return (
        F.when(~exists, "FAILED")
        .when(size > max_size, "OVERSIZED")
        .when(~format_ok, "UNSUPPORTED")
        .when(error.isNotNull() & broken, "CORRUPTED")
        .when(error.isNotNull(), "FAILED")
        .otherwise("SUCCESS")
    )


def hash_matches(actual: Column, expected: Column) -> Column:
    """Digest comparison without case; true when nothing is expected."""
    return F.coalesce(F.lower(actual) == F.lower(F.nullif(expected, F.lit(""))), F.nullif(expected, F.lit("")).isNull())


def parse_cache_reuse(artifacts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Artifacts whose content was not parsed yet."""
    return artifacts.join(parsed.select("artifact_id", "sha256"), ["artifact_id", "sha256"], "left_anti")


# Top-level keys a contract must have.
CONTRACT_KEYS = [
    "contract_version", "case_id", "evidence_id", "source", "file_record", "extracted_artifacts", "entities",
    "relationships", "timeline_events", "observation_provenance",
]


def contract_validate(contracts: DataFrame, column: str = "contract", keys: list[str] | None = None) -> DataFrame:
    """Missing keys, incomplete artifacts and array sizes of contract JSON text."""
    required = keys or CONTRACT_KEYS
    present = F.json_object_keys(F.col(column))
    missing = F.array_except(F.array(*[F.lit(key) for key in required]), F.coalesce(present, F.array().cast("array<string>")))
    shape = "extracted_artifacts array<struct<artifact_id:string,extracted_file_path:string>>, entities array<string>, relationships array<string>, timeline_events array<string>"
    parsed = F.from_json(column, shape)

    def count(name: str) -> Column:
        return F.coalesce(F.size(parsed.getField(name)), F.lit(0))

    complete = F.forall(
        F.coalesce(parsed.getField("extracted_artifacts"), F.array().cast("array<struct<artifact_id:string,extracted_file_path:string>>")),
        lambda item: F.coalesce(item.getField("artifact_id") != "", F.lit(False)) & F.coalesce(item.getField("extracted_file_path") != "", F.lit(False)),
    )
    others = [name for name in contracts.columns if name != column]
    return contracts.select(
        *others,
        F.array_join(F.sort_array(missing), ",").alias("missing_keys"),
        complete.alias("artifacts_complete"),
        (F.size(missing) == 0).alias("keys_ok"),
        ((F.size(missing) == 0) & complete).alias("is_valid"),
        count("extracted_artifacts").alias("artifact_count"),
        count("entities").alias("entity_count"),
        count("relationships").alias("relationship_count"),
        count("timeline_events").alias("timeline_count"),
    )


def truth_compare(expected: DataFrame, observed: DataFrame, key: list[str], severity: Column | str = "HIGH") -> DataFrame:
    """Expected against observed items: FOUND, MISSING (with severity) or UNEXPECTED."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    left = expected.select(*key).distinct().withColumn("_e", F.lit(True))
    right = observed.select(*key).distinct().withColumn("_o", F.lit(True))
    verdict = F.when(F.col("_e").isNull(), "UNEXPECTED").when(F.col("_o").isNull(), "MISSING").otherwise("FOUND")
    joined = left.join(right, key, "full_outer").withColumn("verdict", verdict)
    return joined.select(*key, "verdict", F.when(F.col("verdict") == "MISSING", level).alias("severity"))
