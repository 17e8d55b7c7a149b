"""Entity signals out of observations.

Every rule turns an observation into an array of matches.  The arrays are joined
and exploded once, so extraction is one narrow pass over the observations: no
shuffle, and a huge source splits like any other scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import ids, patterns, text

MATCH = (
    "array<struct<entity_type:string,observed:string,method:string,score:double,id_suffix:string,"
    "place:string,trace:string,min_length:int,row_index:int,position:int,next_blank:int,text_key:string>>"
)

#: What places an observation, and all its signals.
SCOPE = ["case_id", "evidence_id", "artifact_id", "observation_id", "job_id"]

_extractors: dict[str, Callable[[], Column]] = {}


def register_extractor(name: str, rule: Callable[[], Column]) -> None:
    """Add a rule: a function giving a column of type ``MATCH`` over observation columns."""
    _extractors[name] = rule


def _match(
    entity_type: str,
    observed: Column,
    method: Column | str,
    score: float,
    *,
    min_length: int = 1,
    id_suffix: Column | str = "",
    place: Column | None = None,
    trace: Column | None = None,
    row_index: Column | None = None,
    position: Column | None = None,
    next_blank: Column | None = None,
    text_key: Column | None = None,
) -> Column:
    def lit(value: Column | str) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    where = place if place is not None else _place()
    none = F.lit(None)
    return F.struct(
        F.lit(entity_type).alias("entity_type"),
        observed.alias("observed"),
        lit(method).alias("method"),
        F.lit(score).alias("score"),
        lit(id_suffix).alias("id_suffix"),
        where.alias("place"),
        (trace if trace is not None else where).alias("trace"),
        F.lit(min_length).alias("min_length"),
        (row_index if row_index is not None else none).cast("int").alias("row_index"),
        (position if position is not None else none).cast("int").alias("position"),
        (next_blank if next_blank is not None else none).cast("int").alias("next_blank"),
        (text_key if text_key is not None else none).cast("string").alias("text_key"),
    )


def _place() -> Column:
    return F.coalesce(F.nullif(F.col("location_reference"), F.lit("")), F.lit("Unknown Location"))


# Fields of the structured observations, parsed once per row.
FIELDS = (
    "row_id string, account_type string, account_unique_identifier string, from_account string, to_account string, "
    "email_from string, email_to string, latitude string, longitude string, user_name string"
)
STRUCTURED = [
    "IMAGE_GPS", "FORENSIC_ACCOUNT", "FORENSIC_COMMUNICATION", "FORENSIC_EMAIL_MESSAGE", "FORENSIC_EXIF_GPS",
    "FORENSIC_WEB_HISTORY",
]


def _raw_field(name: str) -> Column:
    return F.col(f"_fields.{name}")


def _field(name: str) -> Column:
    return text.strip(F.coalesce(_raw_field(name), F.lit("")))


def _only(condition: Column, matches: Column) -> Column:
    return F.when(condition, matches).otherwise(F.array().cast(MATCH))


def _is(observation_type: str) -> Column:
    return F.col("observation_type") == observation_type


# --- free text -----------------------------------------------------------------


def _text_rule(entity_type: str, pattern: str, group: int, method: str, score: float, min_length: int) -> Column:
    value = F.col("value")
    found = F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(group)))

    def build(raw: Column) -> Column:
        observed = text.strip(raw)
        start = F.position(observed, value)
        # Where the next blank line begins, counted from the text start; 0 when there is none.
        blank = F.position(F.lit("\n\n"), value, start)
        return _match(
            entity_type, observed, method, score,
            min_length=min_length, position=start - 1, next_blank=blank - 1,
        )

    return _only(_is("DOCUMENT_TEXT") & value.isNotNull(), F.transform(found, build))


def sig_text_phone() -> Column:
    return _text_rule("PhoneNumber", patterns.PHONE, 0, "REGEX_PHONE_E164", 1.0, 10)


def sig_text_email() -> Column:
    return _text_rule("Email", patterns.EMAIL, 0, "REGEX_RFC5322_EMAIL", 1.0, 1)


def sig_text_name() -> Column:
    return _text_rule("Person", patterns.NAME_FIELD, 1, "STRUCTURED_NAME_PREFIX", 0.95, 3)


def sig_text_org() -> Column:
    """Opt-in: labelled organisation fields."""
    return _text_rule("Organization", patterns.ORG_FIELD, 1, "STRUCTURED_ORG_PREFIX", 0.95, 3)


def sig_text_ifsc() -> Column:
    return _text_rule("BankAccount", patterns.IFSC, 0, "REGEX_IFSC_CODE", 1.0, 1)


def sig_text_account() -> Column:
    return _text_rule("BankAccount", patterns.ACCOUNT_FIELD, 1, "STRUCTURED_BANK_ACCOUNT", 0.95, 1)


def sig_meta_author() -> Column:
    match = _match("Person", F.col("value"), "PDF_METADATA_AUTHOR", 0.90, min_length=3)
    return _only(_is("DOCUMENT_METADATA") & F.col("key").isin("author", "creator"), F.array(match))


# --- tabular rows --------------------------------------------------------------


def sig_row_columns() -> Column:
    """Cells of sample rows whose column name is in one of the five dictionaries."""
    parsed = F.from_json("value", "rows array<map<string,variant>>").getField("rows")
    dictionaries = [
        ("PhoneNumber", patterns.PHONE_COLUMNS, 10),
        ("Email", patterns.EMAIL_COLUMNS, 1),
        ("Person", patterns.NAME_COLUMNS, 2),
        ("BankAccount", patterns.ACCOUNT_COLUMNS, 1),
        ("Location", patterns.LOCATION_COLUMNS, 1),
    ]
    scalar = ["STRING", "BIGINT", "BOOLEAN"]

    def cells(row: Column, index: Column) -> Column:
        names = F.map_keys(row)
        place = F.concat(_place(), F.lit(", Row "), (index + 1).cast("string"))

        def cell(name: Column, position: Column) -> Column:
            value = F.get(F.map_values(row), position)
            kind = F.schema_of_variant(value)
            number = F.try_variant_get(value, "$", "bigint")
            word = F.try_variant_get(value, "$", "string")
            # Empty text, zero, false and null say nothing.
            filled = (
                F.when(kind == "STRING", word != "")
                .when(kind == "BIGINT", number != 0)
                .when(kind == "BOOLEAN", word == "true")
                .otherwise(False)
            )
            shown = F.when(kind == "BOOLEAN", F.initcap(word)).otherwise(text.strip(word))
            entity_type = F.lit(None).cast("string")
            shortest = F.lit(1)
            for label, columns, length in dictionaries:
                known = F.lower(name).isin(columns)
                entity_type = F.coalesce(entity_type, F.when(known, F.lit(label)))
                shortest = F.when(known, F.lit(length)).otherwise(shortest)
            built = _match(
                "", shown, F.concat(F.lit("SQLITE_COLUMN:"), name), 1.0,
                id_suffix=F.concat(F.lit("-R"), index.cast("string")),
                place=place, trace=F.concat(place, F.lit(":"), name),
                row_index=index, position=position,
            )
            typed = built.withField("entity_type", entity_type).withField("min_length", shortest)
            return F.when(filled & kind.isin(scalar) & entity_type.isNotNull(), typed)

        return F.array_compact(F.transform(names, cell))

    per_row = F.transform(F.coalesce(parsed, F.array().cast("array<map<string,variant>>")), cells)
    return _only(_is("SQLITE_SAMPLE_ROWS"), F.flatten(per_row))


# --- structured forensic rows --------------------------------------------------


def sig_gps() -> Column:
    latitude, longitude = _raw_field("latitude"), _raw_field("longitude")
    complete = latitude.try_cast("double").isNotNull() & longitude.try_cast("double").isNotNull()
    shown = F.concat(F.lit("Lat: "), latitude, F.lit(", Lon: "), longitude)
    row = _row_id()
    pair = text.coordinate_pair(latitude.try_cast("double"), longitude.try_cast("double"))
    image = _match("Location", shown, "IMAGE_EXIF_GPS", 1.0, text_key=pair)
    forensic = _match(
        "Location", shown, "AUTOPSY_EXIF_GPS", 1.0, text_key=pair,
        trace=F.concat(F.lit("blackboard_artifacts:"), row),
    )
    chosen = F.when(_is("IMAGE_GPS"), F.array(image)).otherwise(F.array(forensic))
    return _only(F.col("observation_type").isin("IMAGE_GPS", "FORENSIC_EXIF_GPS") & complete, chosen)


def _row_id() -> Column:
    return F.coalesce(_raw_field("row_id"), F.lit("0"))


def sig_account() -> Column:
    identifier = _field("account_unique_identifier")
    match = _match(
        "Email", identifier, "AUTOPSY_ACCOUNTS_TABLE", 1.0, trace=F.concat(F.lit("accounts:"), _row_id())
    )
    is_email = _raw_field("account_type") == "EMAIL"
    return _only(_is("FORENSIC_ACCOUNT") & is_email & (identifier != ""), F.array(match))


def sig_comm_pair() -> Column:
    def side(field: str, tag: str) -> Column:
        account = _field(field)
        low = tag.lower()
        match = _match(
            "Email", account, f"AUTOPSY_ACCOUNT_COMM_{tag}", 1.0, id_suffix=f"-{tag}",
            place=F.concat(_place(), F.lit(f":{low}")),
            trace=F.concat(F.lit("account_relationships:"), _row_id(), F.lit(f":{low}")),
        )
        return F.when(account != "", match)

    return _only(
        _is("FORENSIC_COMMUNICATION"),
        F.array_compact(F.array(side("from_account", "FROM"), side("to_account", "TO"))),
    )


def header_entries(header: Column) -> Column:
    """Mail header to an array of (name or null, address), in header order."""
    parts = F.transform(F.split(header, patterns.HEADER_SPLIT), text.strip)

    def entry(part: Column) -> Column:
        address = F.regexp_extract(part, patterns.HEADER_NAMED, 2)
        shown = text.strip(F.regexp_extract(part, patterns.HEADER_NAMED, 1))
        is_name = ~shown.contains("@") & (F.length(shown) >= 2) & shown.rlike(r"\p{L}")
        bare = F.regexp_extract(part, patterns.EMAIL, 0)
        named = F.struct(
            F.when(is_name, shown).alias("name"), F.trim(address).alias("address")
        )
        plain = F.struct(F.lit(None).cast("string").alias("name"), bare.alias("address"))
        return F.when(address != "", named).when(bare != "", plain)

    return F.array_compact(F.transform(parts, entry))


def sig_message_header() -> Column:
    def side(field: str, tag: str) -> Column:
        entries = header_entries(_field(field))
        letter = tag[0]
        low = tag.lower()

        def build(item: Column, index: Column) -> Column:
            number = index.cast("string")
            trace = F.concat(F.lit("blackboard_artifacts:"), _row_id(), F.lit(f":{low}"))
            address = _match(
                "Email", item.getField("address"), f"AUTOPSY_EMAIL_{tag}", 1.0,
                id_suffix=F.concat(F.lit(f"-{letter}"), number),
                place=F.concat(_place(), F.lit(f":{low}")), trace=trace, position=index,
            )
            person = _match(
                "Person", item.getField("name"), f"AUTOPSY_EMAIL_{tag}_NAME", 0.95, min_length=3,
                id_suffix=F.concat(F.lit(f"-{letter}P"), number),
                place=F.concat(_place(), F.lit(f":{low}_name")),
                trace=F.concat(trace, F.lit("_name")), position=index,
            )
            return F.array(address, F.when(item.getField("name").isNotNull(), person))

        return F.array_compact(F.flatten(F.transform(entries, build)))

    return _only(
        _is("FORENSIC_EMAIL_MESSAGE"), F.concat(side("email_from", "FROM"), side("email_to", "TO"))
    )


def sig_web_user() -> Column:
    user = _field("user_name")
    match = _match(
        "Person", user, "AUTOPSY_WEB_USER", 0.90, min_length=3,
        trace=F.concat(F.lit("blackboard_artifacts:"), _row_id()),
    )
    person = (user != "") & ~F.upper(user).isin(patterns.SYSTEM_USERS)
    return _only(_is("FORENSIC_WEB_HISTORY") & person, F.array(match))


for _rule in (
    sig_text_phone, sig_text_email, sig_text_name, sig_text_ifsc, sig_text_account, sig_meta_author,
    sig_row_columns, sig_gps, sig_account, sig_comm_pair, sig_message_header, sig_web_user,
):
    register_extractor(_rule.__name__, _rule)


def extract_signals(
    observations: DataFrame, rules: list[str] | None = None, keep: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """All signals of the observations.

    Extraction has as many tasks as its input has partitions.  Tables that lie in few files
    or row groups need ``partitions``: observations are then dealt once by their whole
    scope, the key that the relationship rules join on, into so many.

    ``rules`` picks rules by name (default: all registered); ``keep`` names further
    observation columns to carry along, such as an event time.
    """
    carried = keep or []
    if partitions:
        observations = observations.repartition(partitions, *SCOPE)
    extra = {"sig_text_org": sig_text_org}
    chosen = [{**extra, **_extractors}[name] for name in (rules or list(_extractors))]
    matches = F.concat(*[rule() for rule in chosen]) if len(chosen) > 1 else chosen[0]()

    def normalise(match: Column) -> Column:
        value = text.norm_dispatch(match.getField("entity_type"), match.getField("observed"))
        return F.struct(match.alias("m"), F.coalesce(match.getField("text_key"), value).alias("normalized_value"))

    def identify(item: Column) -> Column:
        match, value = item.getField("m"), item.getField("normalized_value")
        source = F.concat(F.col("observation_id"), match.getField("id_suffix"))
        key = ids.digest(F.col("case_id"), source, match.getField("entity_type"), value)
        return F.struct(match.alias("m"), value.alias("normalized_value"), key.alias("signal_key"))

    # Values and keys are computed inside the arrays, so that each is computed once and
    # the columns after the explode are plain fields.
    long_enough = F.filter(
        F.transform(matches, normalise),
        lambda item: F.length(item.getField("normalized_value")) >= item.getField("m").getField("min_length"),
    )
    fields = F.when(F.col("observation_type").isin(STRUCTURED), F.from_json("value", FIELDS))
    rows = observations.withColumn("_fields", fields).select(
        "case_id", "evidence_id", "artifact_id", "observation_id", "job_id", *carried,
        F.inline(F.transform(long_enough, identify)),
    )
    return rows.select(
        ids.signal_id(F.col("m.entity_type"), F.col("signal_key")).alias("signal_id"),
        "signal_key",
        "case_id",
        "evidence_id",
        "artifact_id",
        "observation_id",
        "job_id",
        F.col("m.entity_type").alias("entity_type"),
        text.strip(F.col("m.observed")).alias("observed_value"),
        "normalized_value",
        F.col("m.place").alias("source_location"),
        F.col("m.method").alias("extraction_method"),
        F.col("m.score").alias("confidence"),
        F.concat_ws("", "artifact_id", F.lit(":"), "observation_id", F.lit("#"), "m.trace").alias(
            "provenance_trace"
        ),
        F.col("m.row_index").alias("row_index"),
        F.col("m.position").alias("position"),
        F.col("m.next_blank").alias("next_blank"),
        *carried,
    )


# --- raw byte text -------------------------------------------------------------


def byte_signals(files: DataFrame, content: str = "text", limit: int | None = None) -> DataFrame:
    """Phones and addresses in the decoded bytes of documents and logs.

    ``files`` has an ``artifact_id`` and the decoded text.  The whole text is read
    and every match kept; ``limit`` keeps the first so many distinct values of each
    kind per file, by position.
    """
    phones = F.transform(
        F.filter(
            F.regexp_extract_all(F.col(content), F.lit(patterns.LOOSE_PHONE), F.lit(0)), text.phone_digits_ok
        ),
        lambda raw: F.trim(raw),
    )
    emails = F.regexp_extract_all(F.col(content), F.lit(patterns.LOOSE_EMAIL), F.lit(0))
    return _two_kinds(files, phones, emails, "PhoneNumber", "Email", 0.95, limit)


def image_signals(files: DataFrame, content: str = "text", limit: int | None = None) -> DataFrame:
    """Digit runs and addresses in a decoded image header, with the mapped type names."""
    phones = F.regexp_extract_all(F.col(content), F.lit(patterns.DIGIT_RUN), F.lit(0))
    emails = F.regexp_extract_all(F.col(content), F.lit(patterns.LOOSE_EMAIL), F.lit(0))
    return _two_kinds(files, phones, emails, "PhoneNumber", "Email", 1.0, limit)


def observed_filesystem(content: Column) -> Column:
    """File system named by the header bytes; FAT32 when nothing is recognised."""
    return (
        F.when(content.contains("NTFS"), "NTFS")
        .when(content.contains("FAT") | content.contains("MSDOS"), "FAT32")
        .when(content.contains("EXT"), "EXT4")
        .otherwise("FAT32")
    )


def _two_kinds(
    files: DataFrame, phones: Column, emails: Column, phone: str, email: str, score: float, limit: int | None
) -> DataFrame:
    def kind(values: Column, label: str) -> Column:
        distinct = F.array_distinct(values)
        if limit is not None:
            distinct = F.slice(distinct, 1, limit)
        return F.transform(
            distinct,
            lambda value, index: F.struct(
                F.lit(label).alias("entity_type"), value.alias("observed_value"), (index + 1).alias("rank")
            ),
        )

    found = F.concat(kind(phones, phone), kind(emails, email))
    return files.select("artifact_id", F.explode(found).alias("m")).select(
        "artifact_id", "m.entity_type", "m.observed_value", "m.rank", F.lit(score).alias("confidence")
    )
