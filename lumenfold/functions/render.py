"""Values as text of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in HTML, the ampersand first.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), HTML, text)


def optional_number(value: Column) -> Column:
    """Four decimals, or n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.4f", value.cast("double")))


def html_row(cells: list[Column], tag: str = "td") -> Column:
    """Null cells are empty."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), F.coalesce(escaped(c.cast("string")), F.lit("")), F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))


def markdown_row(cells: list[Column]) -> Column:
    """Bars are escaped and line ends become spaces, so that a row stays a row."""
    plain = [F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))
