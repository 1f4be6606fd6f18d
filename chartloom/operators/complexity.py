"""How a text is laid out, and the chunk size that suits it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list line starts with one of these or with a number; a header line looks like this.
BULLETS = ("• ", "- ", "* ", "· ", "○ ", "► ", "▪ ")
NUMBERED = r"^\s*\p{Nd}+[.):]\s"
HEADER = r"^[A-Z][A-Z\s]{3,}$|^#{1,6}\s|^\*\*.*\*\*$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"
COMPLEX, MODERATE, SIMPLE = 500, 250, 310


def lines(text: Column) -> Column:
    return F.split(text, r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]", -1)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def numeric_density(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, r"[^\p{N}]", ""))
    return F.least(F.lit(1.0), digits.cast("double") / F.greatest(F.lit(1), F.length(text)) * 5)


def table_signature(text: Column, split: Column | None = None) -> Column:
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    tabs = F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
    groups = lambda line: F.size(F.filter(F.split(line, r"[^\p{N}.,-]+"), lambda g: g.rlike(r"^\p{N}")))
    aligned = F.size(F.filter(lines(text) if split is None else split, lambda line: groups(line) >= 3))
    part = lambda n, least, cap, over: F.when(n > least, F.least(F.lit(cap), n / F.lit(over))).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), part(pipes, 5, 0.5, 20.0) + part(tabs, 10, 0.3, 50.0) + part(aligned, 3, 0.4, 10.0))


def trimmed(split: Column) -> Column:
    return F.transform(split, lambda line: F.regexp_replace(line, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", ""))


def _share(found: Column, test, times: int) -> Column:
    return F.least(F.lit(1.0), F.size(F.filter(found, test)).cast("double") / F.size(found) * times)


def list_strength(text: Column, found: Column | None = None) -> Column:
    """``found``: the trimmed lines, where the caller has them."""

    def is_list(line):
        out = line.rlike(NUMBERED)
        for b in BULLETS:
            out = out | line.startswith(b)
        return out

    return _share(found, is_list, 3) if found is not None else _let(trimmed(lines(text)), lambda t: _share(t, is_list, 3))


def header_strength(text: Column, found: Column | None = None) -> Column:
    is_header = lambda line: line.rlike(HEADER)
    return _share(found, is_header, 10) if found is not None else _let(trimmed(lines(text)), lambda t: _share(t, is_header, 10))


def analyze(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the four scores, ``complexity`` and ``chunk_words`` (CPX-01..05)."""
    t = F.col(text)
    out = df.withColumn("__lines", lines(t)).withColumn("__trimmed", trimmed(F.col("__lines")))  # split and trimmed once
    out = out.withColumns({"table_signature": table_signature(t, F.col("__lines")), "numeric_density": numeric_density(t), "list_strength": list_strength(t, F.col("__trimmed")), "header_strength": header_strength(t, F.col("__trimmed"))})
    out = out.drop("__lines", "__trimmed")
    is_complex = (F.col("table_signature") > 0.4) | (F.col("numeric_density") > 0.3)
    is_moderate = (F.col("list_strength") > 0.3) | (F.col("header_strength") > 0.2)
    return out.withColumns({
        "complexity": F.when(is_complex, "complex").when(is_moderate, "moderate").otherwise("simple"),
        "chunk_words": F.when(is_complex, COMPLEX).when(is_moderate, MODERATE).otherwise(SIMPLE),
    })
