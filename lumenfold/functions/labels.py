"""Labels, names and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score levels, figure titles, and protein names by what an upper-case label without hyphens holds.
HIGH, MEDIUM = 0.90, 0.82
FIGURE = r"(?i)figure\s+(\d+)"
PROTEINS = (("PTBK1", "p-TBK1"), ("TBK1", "TBK1"), ("CGAS", "cGAS"), ("STING", "STING"), ("ANT2", "ANT2"), ("SPG7", "SPG7"), ("CYPD", "CypD"), ("TUBULIN", "tubulin"), ("GAPDH", "GAPDH"), ("ACTIN", "actin"))


def present(label: Column) -> Column:
    return label.isNotNull() & (label != "")


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def aggregate_level(n: Column, n_high: Column, mean_top: Column) -> Column:
    return F.when((n >= 2) & (n_high >= 2) & (mean_top >= HIGH), "high").when((n >= 2) & (mean_top >= MEDIUM), "medium").otherwise("low")


def figure_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FIGURE, 1), F.lit("")).try_cast("int")


def panel_label(text: Column) -> Column:
    """The one letter of a panel label, in upper case, or null."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters.rlike("^[A-Z]$"), letters)


def protein_label(text: Column, short: bool = False) -> Column:
    """The protein a label names, or null; the first name that is held wins. short: a bare AS also names cGAS."""
    folded = F.replace(F.upper(F.translate(F.regexp_replace(text, "[^A-Za-z0-9\u03b1\u0391-]", ""), "\u03b1\u0391", "aA")), F.lit("-"), F.lit(""))
    endings = {"PTBK1": ("PTBK",), "CGAS": ("GAS",)}
    out = None
    for held, name in PROTEINS:
        fits = folded.contains(held)
        for e in endings.get(held, ()):
            fits = fits | folded.endswith(e)
        if held == "CGAS" and short:
            fits = fits | (folded == "AS")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def has_text(text: Column) -> Column:
    """Two characters that aren't blank, or a Chinese one."""
    return (F.length(F.regexp_replace(text, r"\s", "")) >= 2) | text.rlike("[\\x{4E00}-\\x{9FFF}]")


def file_stem(path: Column) -> Column:
    """The file's name without its ending, in characters that any file system takes."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), F.lit("-")), F.lit("")), F.lit("image"))


def aggregate_id(figure: Column, panel_a: Column, panel_b: Column, row_label: Column, row_index: Column) -> Column:
    row = F.coalesce(F.nullif(row_label, F.lit("")), F.concat(F.lit("row-"), F.coalesce(row_index.cast("string"), F.lit("None"))))
    return F.concat(F.replace(figure, F.lit(" "), F.lit("-")), F.lit("_"), panel_a, F.lit("_vs_"), panel_b, F.lit("_"), row)


def figure_name(number: Column) -> Column:
    return F.concat(F.lit("Figure "), number.cast("string"))


def aggregate_name(number: Column, panel_a: Column, panel_b: Column, row_label: Column, row_index: Column) -> Column:
    return aggregate_id(figure_name(number), panel_a, panel_b, row_label, row_index)


def _row(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("row"))


def _slug(number: Column) -> Column:
    return F.lower(F.replace(figure_name(number), F.lit(" "), F.lit("-")))


def match_name(figure: Column, row_label: Column, strip_a: Column, strip_b: Column, score: Column) -> Column:
    """The file name of a strip match's review image."""
    return F.format_string("%s_%s_%s_vs_%s_%.3f.png", _slug(figure), _row(row_label), strip_a, strip_b, score)


def panel_match_name(figure_a: Column, panel_a: Column, figure_b: Column, panel_b: Column, score: Column) -> Column:
    return F.format_string("whole-panel_%s-%s_vs_%s-%s_%.3f.png", _slug(figure_a), panel_a, _slug(figure_b), panel_b, score)


def aggregate_image_name(figure: Column, row_label: Column, panel_a: Column, panel_b: Column) -> Column:
    return F.format_string("%s_aggregate_%s_%s_vs_%s.png", _slug(figure), _row(row_label), panel_a, panel_b)
