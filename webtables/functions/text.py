"""Text, title and paragraph normalisation as Catalyst expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions._cols import ColumnLike, as_col, trim_control

# --- fixed values: named entities that are decoded; anything else stays as written ---
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9",
    "reg": "\u00ae", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "ldquo": "\u201c",
    "rdquo": "\u201d", "lsquo": "\u2018", "rsquo": "\u2019", "middot": "\u00b7", "bull": "\u2022",
    "times": "\u00d7", "divide": "\u00f7", "laquo": "\u00ab", "raquo": "\u00bb",
}
# --- fixed values: tags whose open and close marks become line breaks in clean text ---
BREAK_TAGS = "div|p|br|hr|h[1-6]|article|dd|dl"
# --- fixed values: characters trimmed from both ends of a line ---
BLANK_CLASS = "\\x00-\\x20\u00a0\u3000"
# --- fixed values: characters that may precede a title repeated at the start of a body ---
TITLE_LEAD = (
    "\\s\u3000\u00a0\\p{Punct}\u3001\u3002\uff0c\uff1a\uff1b\uff01\uff1f\u2026\u2014\uff5e\u00b7"
    "\u300c\u300d\u300e\u300f\u201c\u201d\u2018\u2019\uff08\uff09\u300a\u300b\u3008\u3009\u3010\u3011"
)
INDENT = "\u3000\u3000"


def decode_entities(col: ColumnLike) -> Column:
    """Decode named and numeric character references in one pass; unknown ones are left alone."""
    c = as_col(col)
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def code_point(digits: Column, base: int) -> Column:
        value = F.conv(digits, base, 10).cast("long")
        usable = (F.length(digits) <= 10) & (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32"))

    def one(piece: Column) -> Column:
        name = F.lower(F.substring(piece, 2, 32))
        bare = F.regexp_replace(name, ";$", "")
        hexa = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1)
        dec = F.regexp_extract(piece, "^&#([0-9]+);$", 1)
        decoded = (
            F.when(hexa != "", code_point(hexa, 16))
            .when(dec != "", code_point(dec, 10))
            .otherwise(F.try_element_at(names, bare))
        )
        return F.when(
            piece.startswith("&") & piece.endswith(";") & (F.length(piece) > 2), F.coalesce(decoded, piece)
        ).otherwise(piece)

    pieces = F.regexp_extract_all(c, F.lit("&#?[0-9A-Za-z]{1,11};|&|[^&]++"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def normalize_newlines(col: ColumnLike) -> Column:
    """Drop a leading byte-order mark and turn CR LF and CR into LF."""
    return F.regexp_replace(F.regexp_replace(as_col(col), "^\ufeff", ""), "\r\n?", "\n")


def collapse_ws(col: ColumnLike) -> Column:
    """Runs of blank characters become one space; both ends trimmed."""
    return trim_control(F.regexp_replace(as_col(col), "[ \t\r\n\u00a0]+", " "))


def squash_line(col: ColumnLike) -> Column:
    """Blanks inside one line (also ideographic ones) become one space; both ends trimmed."""
    return trim_control(F.regexp_replace(as_col(col), "[ \t\u00a0\u3000\u000b]+", " "))


def tidy(col: ColumnLike) -> Column:
    """Squash each line and keep at most one blank line between two lines."""
    lines = F.transform(F.split(F.regexp_replace(as_col(col), "\r", "\n"), "\n"), squash_line)
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{2,}", "\n\n")
    return F.regexp_replace(joined, "^\n+|\n+$", "")


def trim_blank(col: ColumnLike) -> Column:
    """Trim control characters, spaces, no-break and ideographic spaces at both ends."""
    return F.regexp_replace(as_col(col), f"^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$", "")


def clean_text(col: ColumnLike) -> Column:
    """Markup to plain text: block marks become line breaks, the rest is dropped, blank lines vanish."""
    t = F.regexp_replace(as_col(col), "\r\n?", "\n")
    t = F.regexp_replace(t, f"(?i)</?(?:{BREAK_TAGS})(?:[\\s/][^>]*)?>", "\n")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    lines = F.split(F.translate(decode_entities(t), "\u00a0", " "), "\n")
    kept = F.filter(F.transform(lines, trim_blank), lambda x: x != "")
    return F.array_join(kept, "\n")


def title_key(col: ColumnLike) -> Column:
    """Letters and digits only, lower case: two titles with the same key are the same work."""
    return F.lower(F.regexp_replace(as_col(col), "[^\\p{L}\\p{Nd}]", ""))


def title_matches(a: ColumnLike, b: ColumnLike) -> Column:
    left = title_key(a)
    return (left != "") & (left == title_key(b))


def _quoted(col: Column) -> Column:
    """A column value as a literal inside a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def format_paragraphs(body: ColumnLike, title: ColumnLike, book: ColumnLike | None = None) -> Column:
    """Title on its own line, every later non-blank line indented; a repeated title is removed once."""
    text = F.coalesce(as_col(body), F.lit(""))
    name = trim_blank(F.coalesce(as_col(title), F.lit("")))
    lead = F.lit(f"^[{TITLE_LEAD}")
    if book is not None:
        work = F.trim(F.coalesce(as_col(book), F.lit("")))
        lead = F.concat(lead, F.when(work != "", _quoted(work)).otherwise(F.lit("")))
    pattern = F.concat(lead, F.lit("]*"), _quoted(name), F.lit("[\\s\u3000\u00a0]+"))
    text = F.when(name != "", F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)
    lines = F.filter(F.transform(F.split(text, "\n"), trim_blank), lambda x: x != "")
    indented = F.transform(lines, lambda x: F.concat(F.lit(INDENT), x))
    head = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, indented), "\n")


def _strip_tail(col: Column) -> Column:
    """Remove up to five trailing bracket groups."""
    out = F.trim(col)
    groups = "\\([^(]*\\)|\uff08[^\uff08]*\uff09|\\[[^\\[]*\\]|\u3010[^\u3010]*\u3011"
    for _ in range(5):
        out = F.regexp_replace(out, f"(?s)^(.+?)\\s*(?:{groups})$", "$1")
    return out


def split_title_author(file_name: ColumnLike) -> Column:
    """Title and author from a file name: ``Title - Author.txt``."""
    base = F.regexp_replace(as_col(file_name), "(?s)^(.+)\\.[^.]*$", "$1")
    base = F.trim(F.translate(base, "\u300a\u300b_", "   "))
    dash = "-\uff0d\u2014\u2013"
    parts = f"(?s)^(.+)[{dash}]([^{dash}]*)$"
    head, tail = F.regexp_extract(base, parts, 1), F.regexp_extract(base, parts, 2)
    cut = (head != "") & (F.length(tail) <= 13) & ~tail.rlike("[0-9]")
    author = F.when(cut, _strip_tail(tail)).otherwise(F.lit(""))
    author = F.trim(F.regexp_replace(author, "^\u4f5c\u8005[:\uff1a]?", ""))
    title = _strip_tail(F.when(cut, head).otherwise(base))
    return F.struct(
        F.when(title == "", base).otherwise(title).alias("title"),
        author.alias("author"),
    )


def one_line(col: ColumnLike) -> Column:
    """A name on one line, in full."""
    return F.translate(trim_control(as_col(col)), "\n", " ")


def clamp_name(col: ColumnLike, size: int = 60) -> Column:
    """A one-line name of at most ``size`` characters, for display."""
    return F.substring(one_line(col), 1, size)


def replace_tail(col: ColumnLike, pattern: str, replacement: str = "") -> Column:
    """Regex replacement across lines; an invalid pattern leaves the value unchanged."""
    c = as_col(col)
    if not pattern:
        return c
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    try:
        context._jvm.java.util.regex.Pattern.compile("(?s)" + pattern)
    except Exception:  # the JVM rejected the pattern
        return c
    return F.regexp_replace(c, "(?s)" + pattern, replacement)


def subtitle(author: ColumnLike, kind: ColumnLike, word_count: ColumnLike, source_name: ColumnLike) -> Column:
    """Non-empty parts joined for display."""
    words = F.nullif(as_col(word_count), F.lit(""))
    return F.concat_ws(
        "  |  ",
        F.nullif(as_col(author), F.lit("")),
        F.nullif(as_col(kind), F.lit("")),
        F.concat(words, F.lit("\u5b57")),
        F.nullif(as_col(source_name), F.lit("")),
    )


def first_of(*cols: ColumnLike) -> Column:
    """The first alternative that is not blank, else an empty string."""
    options = [F.when(F.trim(as_col(c)) != "", as_col(c)) for c in cols]
    return F.coalesce(*options, F.lit(""))


def concat_all(*cols: ColumnLike) -> Column:
    """All parts in order, missing ones as empty strings."""
    return F.concat(*[F.coalesce(as_col(c), F.lit("")) for c in cols])


def join_list(items: ColumnLike, separator: str) -> Column:
    """A list of extracted values joined by a separator."""
    return F.array_join(as_col(items), separator)
