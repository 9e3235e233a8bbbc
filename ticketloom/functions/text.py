"""Text column functions: tokens, titles, markup removal, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores in any script.
TOKEN_GAP = r"[^\p{L}\p{N}_]+"

#: The patterns decide which texts have front matter and a title.
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n"
HEADING = r"(?m)^#\s+(.+)$"


def tokens(text: Column) -> Column:
    """Lower-case tokens in reading order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_GAP), "")


def token_line(text: Column) -> Column:
    """The same tokens as one text, with a space for every gap, also before the first and after the last."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TOKEN_GAP, " ")


def query_terms(text: Column) -> Column:
    """Distinct tokens of a query; an empty array means no result."""
    return F.array_distinct(tokens(text))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def after_first_line(text: Column) -> Column:
    cut = F.instr(text, "\n")
    return F.when(cut == 0, F.lit("")).otherwise(F.substring(text, cut + 1, F.length(text)))


def combine_text(subject: Column, body: Column) -> Column:
    """Subject twice, then the body: the subject counts double in the features."""
    return F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))


def embed_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n\n", title, content)


def token_estimate(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def article_title(content: Column, file_name: Column) -> Column:
    """First ``# heading`` of the file, else the title-cased file stem."""
    heading = F.trim(F.regexp_extract(content, HEADING, 1))
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "[-_]", " ")
    return F.when(heading != "", heading).otherwise(F.initcap(stem))


def front_matter(content: Column) -> Column:
    """The text between the leading ``---`` lines, or ''."""
    return F.regexp_extract(content, FRONT_MATTER, 1)


def front_matter_value(matter: Column, key: str) -> Column:
    """Value of ``key: value`` in the front matter (last one wins, key in any case), or NULL."""
    lines = F.filter(
        F.split(matter, "\n"),
        lambda x: F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).eqNullSafe(F.lit(key)) & x.contains(":"),
    )
    value = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), r"^[^:]*:", "")
    return F.trim(value)


def front_matter_tags(matter: Column) -> Column:
    """``[a, b]`` as an array of trimmed strings; no tags line gives an empty array."""
    raw = F.regexp_replace(front_matter_value(matter, "tags"), r"^[\[\]]+|[\[\]]+$", "")
    return F.coalesce(F.transform(F.split(raw, ","), lambda t: F.trim(t)), F.array().cast("array<string>"))


def without_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, FRONT_MATTER, "")


def _unescape(text: Column) -> Column:
    """The five predefined entities, the no-break space; ``&amp;`` last so nothing is unescaped twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    """Markup to plain text: script, style, head parts and comments out, tags to line breaks, entities unescaped."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    text = _unescape(text)
    return collapse_blank_lines(text)


def collapse_blank_lines(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n")
    return F.regexp_replace(text, r"^[ \t\n]+|[ \t\n]+$", "")


def markdown_to_text(content: Column) -> Column:
    """Markdown to plain text: marks removed, link texts kept, paragraph breaks kept."""
    text = F.regexp_replace(content, r"(?m)^\s{0,3}#{1,6}\s+", "")
    text = F.regexp_replace(text, r"(?m)^\s{0,3}>\s?", "")
    text = F.regexp_replace(text, r"(?m)^\s*(?:[-*+]|\d+\.)\s+", "")
    text = F.regexp_replace(text, r"(?m)^```.*$", "")
    text = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"\*\*|__|`", "")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    text = _unescape(text)
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def summary(text: Column, size: int = 500) -> Column:
    """First non-blank paragraph, at most ``size`` characters; NULL when there is none."""
    paragraphs = F.filter(
        F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""
    )
    return F.substring(F.try_element_at(paragraphs, F.lit(1)), 1, size)
