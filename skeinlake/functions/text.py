"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Transliterations, in order. Several have two-letter results, so ``translate`` can't do them.
TRANSLITERATIONS = (("&", "and"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"), ("ä", "ae"), ("é", "e"), ("ö", "oe"), ("ü", "ue"))

#: What a canonical key may not hold.
NOT_KEY = r'[^A-Za-z0-9_\-.@()+=;$!*%:,}{\]\["]'


def clean_text(c: Column) -> Column:
    """Runs of three dots or more and runs of spaces become one; a space after a line end and empty lines go; trimmed."""
    c = F.regexp_replace(c, r"\.\.\.+", "...")
    c = F.regexp_replace(c, " +", " ")
    c = F.regexp_replace(c, "\n ", "\n")
    c = F.regexp_replace(c, "\n+", "\n")
    return F.regexp_replace(c, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")


def clean_paragraphs(c: Column) -> Column:
    """The same, but paragraph breaks (empty lines) stay, as the chunker needs them."""
    c = F.regexp_replace(c, r"\.\.\.+", "...")
    c = F.regexp_replace(c, " +", " ")
    c = F.regexp_replace(c, "\n ", "\n")
    c = F.regexp_replace(c, "\n\n+", "\n\n")
    return F.regexp_replace(c, r"^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")


def transliterate(c: Column) -> Column:
    for a, b in TRANSLITERATIONS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def canonical_key(c: Column) -> Column:
    """Spaces become underscores, then all characters that a key may not hold go."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), NOT_KEY, "")


def display_label(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def chunk_label(file_name: Column, h1: Column) -> Column:
    """``file - heading`` without asterisks, or the file's name where there is no heading."""
    return F.when(F.coalesce(h1, F.lit("")) != "", F.replace(F.concat(file_name, F.lit(" - "), h1), F.lit("*"), F.lit(""))).otherwise(file_name)


def type_of_id(c: Column) -> Column:
    """``Type`` of ``Type/key``."""
    return F.split_part(c, F.lit("/"), F.lit(1))


def community_key(degree: Column, index: Column) -> Column:
    return F.format_string("%05d/%05d", degree.cast("int"), index.cast("int"))


def community_column(level: int) -> str:
    return f"community_{level:03d}"


def render_chunk(h1: Column, h2: Column, h3: Column, body: Column) -> Column:
    """Headings and body as Markdown, empty parts left out."""

    def part(mark: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))

    return F.concat_ws("\n\n", part("# ", h1), part("## ", h2), part("### ", h3), part("", body))


def page_hint(ref: Column) -> Column:
    """``Page (3)`` or ``Pages (3-5)`` from page indexes that begin with 0; empty without any."""
    first, last = F.element_at(ref, 1) + 1, F.element_at(ref, -1) + 1
    one = F.format_string("Page (%d)", first)
    return F.when(F.size(ref) < 1, F.lit("")).when(first == last, one).otherwise(F.format_string("Pages (%d-%d)", first, last))


def content_block(label: Column, content: Column) -> Column:
    """``label: content`` with a line end."""
    return F.concat(label, F.lit(": "), content, F.lit("\n"))


def json_bounds(c: Column) -> Column:
    """From the first opening to the last closing brace; empty without both."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def salvage_summary(c: Column) -> Column:
    """``struct(label, description)`` of a summary answer: as JSON, or else cut out of nearly-JSON.

    Null where neither works, where the label has fewer than 5 characters, or the description fewer than 20.
    """
    schema = "struct<label:string,description:string>"
    parsed = F.from_json(json_bounds(c), schema)
    trim = r"""^[ ,"'}\n]+|[ ,"'}\n]+$"""
    label = F.regexp_replace(F.regexp_extract(c, r'(?s)"label":([^{}]*?)"description":', 1), trim, "")
    description = F.regexp_replace(F.regexp_extract(c, r'(?s)"description":([^{]*)$', 1), trim, "")
    label = F.trim(F.coalesce(parsed["label"], label))
    description = F.trim(F.coalesce(parsed["description"], description))
    good = (F.length(label) >= 5) & (F.length(description) >= 20)
    return F.when(good, F.struct(label.alias("label"), description.alias("description")))


def node_text(labels: Column, props: Column) -> Column:
    """``Label, Label ; key: value ; ...`` of a property-graph node, keys in order, null values left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(props, lambda k, v: v.isNotNull())))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" ; ", F.concat(F.lit("label: "), F.array_join(labels, ", ")), shown)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
