"""Rows that fail to parse, set apart with their reasons; all others loaded.

Every column is taken as nullable text. Constraint and cast rules are Column expressions whose
failures are gathered in an array ``errors`` per row (``reason: detail``, most basic reason first);
rows with an empty array are the valid ones. Reasons are ``quoting`` (a quote is missing, stray or
unescaped), ``columns`` (otherwise: too few or too many fields, or values in the wrong columns) and
``value`` (otherwise: an ID that is no positive whole number, a date that is none, an error or null
marker as content, or a repeated header).

Lines of raw CSV are first split into fields by a strict tokenizer in an Arrow map. For rows loaded
already, a record torn into parts shows by its neighbours, found with an equi-join on the row number
(never a global window): a part that starts with running text and the row before it whose fields
after the content are missing.

Defined cases: an empty table gives empty results; null dates and contents are fine; blank dates are
fine; a null or blank ID is a ``value``; a null raw line is ``columns`` with 0 fields; extra columns are
kept in the valid rows; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhspark.functions.dates import parse_timestamp
from lekhspark.functions.text import trim_all as _trim
from lekhspark.session import settle_names

# The export's columns in their order.
EXPORT_COLUMNS = (
    "ID", "Date", "Title", "Content", "Permalink", "Categories", "Locations", "Tags", "Contributors",
    "wph_summary", "wph_article_type", "wph_multimedia_type", "_yoast_wpseo_title", "_yoast_wpseo_metadesc", "wph_partner_label",
)

# What exports write in place of a text, in lower case.
MARKERS = ("null", "(null)", "none", "nil", "nan", "n/a", "na", "undefined", "\\n", "#n/a", "#ref!", "#value!", "#name?", "#div/0!", "#num!", "#null!", "#error!", "false", "true", "nat")
_MARKER_FORMS = r"(?i)^(?:error(?:[ :#]*\d+|:.{0,60})|#[A-Z/0-9]+[!?]?|\[object \w+\]|(?:fatal error|warning|exception|traceback)\b.{0,60})$"
_URL = r"^\s*https?://\S+\s*$"


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def split_record(raw: str | None) -> tuple[list[str], str | None]:
    """Fields of one CSV record and what is wrong with its quotes, if anything."""
    if raw is None:
        return [], None
    fields: list[str] = []
    i, n = 0, len(raw)
    while True:
        if raw[i : i + 1] == '"':
            j, parts = i + 1, []
            while True:
                k = raw.find('"', j)
                if k < 0:
                    return fields, "unclosed quote"
                parts.append(raw[j:k])
                if raw[k + 1 : k + 2] != '"':
                    break
                parts.append('"')
                j = k + 2
            fields.append("".join(parts))
            i = k + 1
            if i >= n:
                return fields, None
            if raw[i] != ",":
                return fields, "text after a closing quote"
        else:
            k = raw.find(",", i)
            k = n if k < 0 else k
            if '"' in raw[i:k]:
                return fields, "quote inside an unquoted field"
            fields.append(raw[i:k])
            i = k
            if i >= n:
                return fields, None
        i += 1


def parse_lines(raw: DataFrame, text_col: str = "raw", columns: tuple[str, ...] = EXPORT_COLUMNS) -> DataFrame:
    """All columns of ``raw`` but ``text_col``, then ``n_fields``, ``quote_error`` and the record's fields by name (null where absent)."""
    raw = settle_names(raw, (text_col, "n_fields", "quote_error", "errors", *columns))
    clash = {"n_fields", "quote_error", "errors", *columns}
    raw = raw.withColumnsRenamed({c: f"{c}_extra" for c in raw.columns if c in clash})
    keep = [c for c in raw.columns if c != text_col]
    types = [raw.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_record(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array([len(f) for f, _ in split], pa.int32()), pa.array([e for _, e in split], pa.string()), pa.array([f for f, _ in split], pa.list_(pa.string()))],
                names=[*[f"k{i}" for i in range(len(keep))], "n_fields", "quote_error", "fields"],
            )

    schema = ", ".join([*[f"k{i} {t}" for i, t in enumerate(types)], "n_fields int, quote_error string, fields array<string>"])
    parsed = raw.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("raw")).mapInArrow(run, schema)
    return parsed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_fields", "quote_error", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def value_rules() -> list[tuple[Column, str]]:
    """Conditions under which a row of the right columns is wrong, with the error each gives."""
    ident, date, content = F.col("ID"), F.col("Date"), _trim(F.col("Content"))
    header = sum((F.coalesce(_trim(F.col(f"`{c}`")) == c, F.lit(False))).cast("int") for c in EXPORT_COLUMNS) >= 8
    positive = F.coalesce(_trim(ident).rlike("^[0-9]*[1-9][0-9]*$"), F.lit(False))
    blank_date = F.coalesce(_trim(date) == "", F.lit(True))
    marker = F.coalesce(F.lower(content).isin(*MARKERS) | content.rlike(_MARKER_FORMS), F.lit(False))
    return [
        (header, "value: the header repeated"),
        (~positive, "value: ID is no positive whole number"),
        (~blank_date & parse_timestamp(date).isNull(), "value: Date is no date"),
        (marker, "value: Content is a marker"),
    ]


def _errors(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))


def reason(errors: Column) -> Column:
    """The first error's reason."""
    return F.substring_index(F.get(errors, F.lit(0)), ":", 1)


def check_lines(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """``raw`` parsed, with ``errors``."""
    parsed = parse_lines(raw, text_col)
    quoting = F.col("quote_error").isNotNull()
    count = F.col("n_fields") != len(EXPORT_COLUMNS)
    structure = [(quoting, "quoting: broken quotes"), (~quoting & count, "columns: not 15 fields"), (~quoting & ~count & _shifted(), "columns: values in the wrong columns")]
    sound = ~quoting & ~count & ~_shifted()
    return parsed.withColumn("errors", _errors(structure + [(sound & cond, text) for cond, text in value_rules()]))


def _shifted() -> Column:
    """Whether the one address of the row stands elsewhere than in its own column, or a date where the ID should be."""
    is_url = lambda c: F.coalesce(F.col(c).rlike(_URL), F.lit(False))
    elsewhere = F.lit(False)
    for c in EXPORT_COLUMNS:
        # Texts further on may consist of a link; only these columns never do.
        if c in ("ID", "Date", "Title", "Content", "Categories", "Locations", "Tags", "Contributors"):
            elsewhere = elsewhere | is_url(c)
    link = _trim(F.col("Permalink"))
    header = F.coalesce(link == "Permalink", F.lit(False))
    foreign = ~is_url("Permalink") & F.coalesce((link != "") & ~header, F.lit(False))
    dated = parse_timestamp(_trim(F.col("ID"))).isNotNull() & F.coalesce(_trim(F.col("Date")) != "", F.lit(False)) & parse_timestamp(F.col("Date")).isNull()
    return (~is_url("Permalink") & elsewhere) | foreign | dated


def check_rows(rows: DataFrame, order_col: str = "src_row") -> DataFrame:
    """Rows of an already loaded export with ``errors``; ``order_col`` numbers them in their order."""
    rows = settle_names(rows, (*EXPORT_COLUMNS, order_col)).withColumnsRenamed({"errors": "errors_extra", "follows_n": "follows_n_extra"})
    missing_tail = F.lit(True)
    for c in EXPORT_COLUMNS[4:]:
        missing_tail = missing_tail & F.col(f"`{c}`").isNull()
    ident, content = F.col("ID"), F.col("Content")
    marked_up = F.coalesce(ident.rlike(r"<[a-zA-Z/!]|[\n\"]"), F.lit(False))
    running_text = F.coalesce((F.length(_trim(ident)) > 40) & _trim(ident).rlike(r"\s"), F.lit(False))
    is_part = marked_up | running_text
    swallowed = F.coalesce((F.regexp_count(content, F.lit('","|",\\n|",,')) >= 3) | content.rlike(r'"?,"?https?://[^\s,"]+"?,'), F.lit(False))
    loose_quote = F.coalesce((_quotes(content) % 2 == 1) | content.rlike(r'^\s*"[^"]*$|^[^"]*"\s*$'), F.lit(False))
    # Only rows that break off after the content without a trace in it depend on the row behind them. They and the
    # fragments are few, so no other row is shuffled; the join is by equality of row numbers, never over an ordered window.
    depends = missing_tail & ~is_part & ~loose_quote & ~swallowed
    follows = rows.where(is_part).select((F.col(order_col) - 1).alias("follows_n")).distinct()
    alone = rows.where(~depends).withColumn("follows_n", F.lit(None).cast(rows.schema[order_col].dataType))
    open_rows = rows.where(depends)
    marked = alone.unionByName(open_rows.join(follows, open_rows[order_col] == F.col("follows_n"), "left"))
    torn = is_part | (missing_tail & (F.col("follows_n").isNotNull() | loose_quote)) | (missing_tail & swallowed)
    quoting = torn | (swallowed & (F.col("Permalink").isNull() | ~F.coalesce(F.col("Permalink").rlike(_URL), F.lit(False))))
    columns = ~quoting & (_shifted() | missing_tail)
    structure = [(quoting, "quoting: torn or swallowed"), (columns, "columns: values in the wrong columns")]
    sound = ~quoting & ~columns
    return marked.withColumn("errors", _errors(structure + [(sound & cond, text) for cond, text in value_rules()])).drop("follows_n")


def clean_id(ident: Column) -> Column:
    """The number that a valid ID is."""
    return _trim(ident).cast("long")


def valid(checked: DataFrame) -> DataFrame:
    """The rows without errors."""
    return checked.where(F.size("errors") == 0).drop("errors", "n_fields", "quote_error")


def rejected(checked: DataFrame) -> DataFrame:
    """The rows with errors, with ``reason``."""
    return checked.where(F.size("errors") > 0).withColumn("reason", reason(F.col("errors")))


def found(articles: DataFrame, raw_records: DataFrame) -> DataFrame:
    """``src, row_no, reason`` of every damaged row of both tables."""
    a = rejected(check_rows(articles)).select(F.lit("articles").alias("src"), F.col("src_row").cast("long").alias("row_no"), "reason")
    r = rejected(check_lines(raw_records)).select(F.lit("raw_records").alias("src"), F.col("rec_no").cast("long").alias("row_no"), "reason")
    return a.unionByName(r).distinct()
