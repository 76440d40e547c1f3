"""String functions of the retrieval engine as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which words make a question one for a value, a comparison, a catalogue.
VALUE_WORDS = (
    "pressure|temperature|voltage|current|power|watt|mass|weight|torque|force|flow|frequency|speed|velocity|thrust|impulse|acceleration|"
    "dimension|thickness|diameter|radius|height|width|length|depth|area|volume|resistance|impedance|capacitance|inductance|gain|loss|efficiency|"
    r"spec(?:ification)?s?|parameter|rating|rated|nominal|maximum|minimum|max\b|min\b|tolerance|limit|threshold|range|margin|"
    r"measurement|reading|value\s+of|how\s+(?:much|many)"
)
COMPARISON_WORDS = r"top.perform|best|highest|most efficient|lowest|least massive|rank|leader|which .{0,20}(best|highest|top)|among .{0,40}documents?"
CATALOG_WORDS = (
    r"(?:table|list|overview|summary|inventory|index)\s+of\s+(?:all\s+)?(?:files?|documents?)|"
    r"\b(?:create|make|generate|show|give|build|display|produce)\b.{0,40}\b(?:table|list)\b.{0,50}\b(?:documents?|files?|revisions?)\b|"
    r"\b(?:all|each|every)\s+(?:files?|documents?)\b|\bfile\s*names?\s*(?:and|with|,)|\bdocument\s+(?:inventory|index|catalog|register)\b|"
    r"\b(?:all|each|every|list)\b.{0,50}\b(?:revision|version|rev)\b"
)
SUBSYSTEM = r"\b([A-Z]+-\d+(?:\s+[A-Z][A-Za-z]*){1,3})\b"
VALUE_RE = rf"(?i)\b({VALUE_WORDS})\b"
COMPARISON_RE = rf"(?i)\b({COMPARISON_WORDS})\b"
CATALOG_RE = rf"(?i){CATALOG_WORDS}"
TIMESTAMPED = r"^\s*\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}"
KEY_VALUE = r"^\s{2}(\w[\w ()/-]{2,40}?)\s{3,}([\d.]+)\s+(.+?)\s*$"
NOT_FOUND = "That information is not in the ingested documents."
#: Fixed value: tokens of the keyword index; decimals are one token. Word characters are Unicode's.
TOKEN = r"(?U)\d+\.\d+|[\w\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens in their order, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_value_question(text: Column) -> Column:
    return text.rlike(VALUE_RE)


def is_comparison(text: Column) -> Column:
    return text.rlike(COMPARISON_RE)


def is_catalog_question(text: Column) -> Column:
    return text.rlike(CATALOG_RE)


def subsystem_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SUBSYSTEM), F.lit(1))


def lines(text: Column) -> Column:
    """Lines as ``splitlines`` gives them: any line end, no empty piece after the last one."""
    parts = F.split(text, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def without_telemetry(text: Column) -> Column:
    """Text without the lines that begin with a time stamp."""
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(TIMESTAMPED)), "\n")


def title(text: Column, filename: Column) -> Column:
    """What follows ``Title :`` in the first 40 lines (120 characters at most), or else the file name."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 40), "\n")
    found = F.trim(F.regexp_extract(head, r"(?im)^[ \t]*Title[ \t]*:[ \t]*(\S.*)$", 1))
    return F.coalesce(F.nullif(F.substring(found, 1, 120), F.lit("")), filename)


def key_values(text: Column) -> Column:
    """``key: value unit`` of each line that is a row of a specification table."""
    rows = F.filter(lines(text), lambda x: x.rlike(KEY_VALUE))
    return F.transform(rows, lambda x: F.concat(F.trim(F.regexp_extract(x, KEY_VALUE, 1)), F.lit(": "), F.regexp_extract(x, KEY_VALUE, 2), F.lit(" "), F.regexp_extract(x, KEY_VALUE, 3)))


def summary_text(title_: Column, text: Column) -> Column:
    """Title and key-value rows in one line; null without such rows."""
    kv = key_values(text)
    return F.when(F.size(kv) > 0, F.concat(title_, F.lit(" | "), F.array_join(kv, " | ")))


def clean_folder(folder: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.substring(F.trim(folder), 1, 64)), F.lit("")), F.lit("General"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(relpath: Column) -> Column:
    """The parent folder of a relative path (64 characters at most), ``General`` at the root."""
    parent = F.substring(F.regexp_extract(relpath, r"^(.*)/[^/]*$", 1), 1, 64)
    return F.coalesce(F.nullif(parent, F.lit("")), F.lit("General"))


def is_doc_id(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{16}$")


def content_id(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def catalog_field(reply: Column, name: str) -> Column:
    """``name: value`` of a reply of two lines; blank and dashes count as absent."""
    value = F.regexp_replace(F.regexp_extract(reply, rf"(?im)^\s*{name}\s*:\s*(.+?)\s*$", 1), "^[ \t\"']+|[ \t\"']+$", "")
    return F.when(value.isin("", "-", "--"), F.lit("—")).otherwise(value)


def step_lines(reply: Column) -> Column:
    """Lines ``1. ...`` of a numbered reply."""
    return F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+\.\s+.+$"))


def clamp_step(wanted: Column, steps: Column) -> Column:
    return F.greatest(F.lit(0), F.least(wanted, F.size(steps) - 1))


def context_block(filename: Column, page: Column, text: Column) -> Column:
    return F.concat(F.lit("["), filename, F.lit(", page "), page.cast("string"), F.lit("]\n"), text)


def chunk_id(doc_id: Column, page: Column, index: Column) -> Column:
    return F.concat_ws("_", doc_id, page.cast("string"), index.cast("string"))


def figure_number(chunk_index: Column) -> Column:
    """The number of an image chunk's figure on its page; null for other chunks."""
    return F.when(chunk_index <= -100, -100 - chunk_index)


def markdown_table(rows: Column) -> Column:
    """Rows of cells (the first is the head) as a markdown table; null cells are empty, bars escaped, line ends blanks. Null if there are no rows."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.trim(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), row)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(row(rows[0]), rule), body), "\n"))


#: Units that an answer's numbers may carry.
ANSWER_VALUE = r"(?<![\w.])(-?\d+(?:\.\d+)?)\s*(°?[CFK]\b|V\b|A\b|W\b|Hz\b|kHz\b|MHz\b|GHz\b|kg\b|g\b|mm\b|cm\b|m\b|bar\b|psi\b|Nm\b|%|s\b|ms\b|min\b|h\b)?"


def answer_values(text: Column) -> Column:
    """The set of numbers with their units in an answer, numbers in a form that does not depend on their notation (six significant digits)."""
    nums, units = F.regexp_extract_all(text, F.lit(ANSWER_VALUE), F.lit(1)), F.regexp_extract_all(text, F.lit(ANSWER_VALUE), F.lit(2))
    short = lambda n: F.regexp_replace(F.format_string("%.6g", n.cast("double")), r"\.?0+(?=$|e)", "")
    plain = lambda n: F.when(n.rlike(r"^-?\d{1,6}$"), n.cast("int").cast("string")).otherwise(short(n))
    return F.array_sort(F.array_distinct(F.zip_with(nums, units, lambda n, u: F.concat(plain(n), F.lower(F.coalesce(u, F.lit("")))))))
