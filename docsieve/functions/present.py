"""Presentation columns: titles, base names, links, snippets and their fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_val(values: Column) -> Column:
    """First element of an array, or an empty string."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def basename(path: Column) -> Column:
    """Last component; Windows rules where there is a backslash, a drive prefix included."""
    windows = F.element_at(F.split(F.regexp_replace(path, "^[A-Za-z]:", ""), r"[/\\]"), -1)
    return F.when(path.contains("\\"), windows).otherwise(F.element_at(F.split(path, "/"), -1))


def format_number(n: Column) -> Column:
    return F.coalesce(F.format_number(n.try_cast("bigint"), 0), n.cast("string"))


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_title(marked: Column, title: Column, path: Column, doc_id: Column) -> Column:
    return F.coalesce(filled(marked), filled(str_val(title)), filled(basename(path)), filled(path), doc_id)


def quoted(path: Column) -> Column:
    """Percent-encoded but for / : @ ~ and unreserved characters."""
    out = F.url_encode(path)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def repository_href(url: Column, base: Column, path: Column) -> Column:
    """The document's own link, else its repository's, with the path where there is one."""
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), quoted(F.ltrim(path, F.lit("/"))))
    return F.coalesce(filled(url), F.when(filled(base).isNotNull(), F.when(filled(path).isNull(), base).otherwise(joined)))


def file_href(path: Column, root: str = "") -> Column:
    """A file link; existence is not checked, since executors do not share the caller's disk."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    return F.when(filled(path).isNotNull(), F.concat(F.lit("file://"), quoted(whole)))


def action_href(path: Column, group: Column, href: Column) -> Column:
    """The link of a document's action row; none where the document stands in a group of its own path."""
    return F.when(group.isNull() | (path != group), href)


def field_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def page_links(page: int, pages: Column, around: int = 2) -> Column:
    """The numbers of the pages that a result list links to; none where there are no pages that far."""
    first, last = F.lit(max(1, page - around)).cast("long"), F.least(pages.cast("long"), F.lit(page + around).cast("long"))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def meta_line(author: Column, modified: Column) -> Column:
    return F.concat_ws(" ", filled(author), modified.cast("string"))


def unwrap(values: Column) -> Column:
    """The only element of a one-element array, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def fallback_snippet(code: Column, ocr: Column, content: Column, chars: int = 300) -> Column:
    return F.substring(F.coalesce(filled(code), filled(ocr), filled(str_val(content)), F.lit("")), 1, chars)


def snippet_label(code: Column, ocr: Column) -> Column:
    """Which field the snippets shown come from."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.when(some(code), "code").when(some(ocr), "ocr").otherwise("text")


def preferred_snippets(code: Column, content: Column, ocr: Column, grouped: bool = False) -> Column:
    some = lambda c: F.when(F.size(c) > 0, c)
    order = (content, code, ocr) if grouped else (code, content, ocr)
    picked = F.coalesce(*map(some, order))
    return F.slice(picked, 1, 2) if grouped else picked


def escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text
