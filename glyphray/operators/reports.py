"""Text reports and structured reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.functions.names import coding_scheme, instance_uid
from glyphray.functions.text import is_blank
from glyphray.operators.chain import used_modules_text

# Fixed values of the report file and of the structured report.
IMAGE_HEAD = "Resultaten voor afbeelding: "
MODULES_HEAD = "Gebruikte modules: "
CHARSET = "ISO_IR 100"
SR_CLASS = "1.2.840.10008.5.1.4.1.1.88.33"
SCALARS = (
    "instance_creation_date instance_creation_time study_date series_date content_date study_time "
    "series_time content_time accession_number modality conversion_type manufacturer station_name "
    "study_description series_description study_instance_uid series_instance_uid study_id "
    "series_number instance_number requested_procedure_id content_label content_description "
    "presentation_creation_date presentation_creation_time content_creator_name"
).split()
GROUPS = 5


def report_lines(images: DataFrame, texts: DataFrame, image: str = "image_path", used: str = "used",
                 line_no: str = "line_no", text: str = "text") -> DataFrame:
    """The report as ordered rows ``image, part, line_no, line``: head, modules, texts, blank line.

    A report is a file of lines, so lines stay rows: no image's text is ever gathered in one place.
    Write with ``sinks.write_lines`` ordered by image, part and line number.
    """
    frame = images.select(image, F.inline(_frame(F.col(image), F.col(used))))
    body = texts.filter(~is_blank(F.col(text))).select(
        image, F.lit(2).alias("part"), F.col(line_no).cast("bigint").alias("line_no"), F.col(text).alias("line")
    )
    return frame.unionByName(body)


def _row(part: int, line: Column, line_no: Column | None = None) -> Column:
    number = F.lit(0) if line_no is None else line_no
    return F.struct(F.lit(part).alias("part"), number.cast("bigint").alias("line_no"), line.alias("line"))


def _frame(image: Column, used: Column) -> Column:
    return F.array(
        _row(0, F.concat(F.lit(IMAGE_HEAD), image)),
        _row(1, F.concat(F.lit(MODULES_HEAD), used_modules_text(used))),
        _row(3, F.lit("")),
    )


def report_rows(read: DataFrame, lines: Column, image: str = "image_path", used: str = "used") -> DataFrame:
    """Same rows where the recognised lines of an image are still at hand: a plain projection."""
    kept = F.filter(lines, lambda x: ~is_blank(x["text"]))
    body = F.transform(kept, lambda x: _row(2, x["text"], x["line_no"]))
    return read.select(image, F.inline_outer(F.concat(_frame(F.col(image), F.col(used)), body)))


def concept(code: Column, meaning: Column, text: Column) -> Column:
    return F.struct(
        F.lit("CONTAINS").alias("relationship"),
        F.lit("TEXT").alias("value_type"),
        F.array(
            F.struct(code.alias("code"), coding_scheme(code).alias("scheme"), meaning.alias("meaning"))
        ).alias("concept"),
        text.alias("text"),
    )


def content_items(groups: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Flat (code, meaning, text) groups to content items in order."""
    return F.array(*[concept(*g) for g in groups])


def flat_items(df: DataFrame, content: str = "content") -> DataFrame:
    """Inverse of ``content_items``: one row per item, its first concept flattened."""
    keep = [c for c in df.columns if c != content]
    return df.select(*keep, F.posexplode(content).alias("item_no", "item")).select(
        *keep, "item_no", "item.relationship", "item.value_type",
        F.get("item.concept", F.lit(0))["code"].alias("code"),
        F.get("item.concept", F.lit(0))["scheme"].alias("scheme"),
        F.get("item.concept", F.lit(0))["meaning"].alias("meaning"),
        "item.text",
    )


def build_report(df: DataFrame, key: Column, scalars: Mapping[str, Column],
                 groups: Sequence[tuple[Column, Column, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """One structured report per row: fixed fields, the scalar fields, five content items."""
    unknown = set(scalars) - set(SCALARS)
    if unknown:
        raise ValueError(f"unknown report fields: {sorted(unknown)}")
    fixed = {
        "specific_character_set": F.lit(CHARSET),
        "sop_class_uid": F.lit(SR_CLASS),
        "sop_instance_uid": instance_uid(key),
        "referring_physician_name": F.lit(""),
    }
    given = {n: scalars.get(n, F.lit(None)).cast("string") for n in SCALARS}
    fields = [c.alias(n) for n, c in {**fixed, **given}.items()]
    return df.select(*keep, F.struct(*fields, content_items(groups).alias("content")).alias("report"))


def report_json(reports: DataFrame, report: str = "report") -> DataFrame:
    return reports.withColumn("document", F.to_json(report)).drop(report)


def first_item(df: DataFrame, key: str, order: str, item: Column) -> DataFrame:
    """Only the first of each group's items, without building the group."""
    return df.groupBy(key).agg(F.min_by(item, order).alias("first_item"))


def findings(items: DataFrame, codes: Sequence[str], study: str = "study", code: str = "code",
             text: str = "text", order: str = "item_no") -> DataFrame:
    """Study by code table; the first text of a code counts."""
    cells = [
        F.min_by(F.when(F.col(code) == c, F.col(text)), F.when(F.col(code) == c, F.col(order))).alias(c)
        for c in codes
    ]
    return items.groupBy(study).agg(*cells)
