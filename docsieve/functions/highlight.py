"""Highlighting: tokens with their places in the text, what a query marks among them, and the best passages.

Texts of one page are analysed again, each field by its own chain, with character offsets. A passage is the stretch of
tokens that end in one stride of so many characters, from the start of the first of them to that of the next passage, so it
begins and ends at a word. It counts the clauses found in it, then the marks; the first of equals comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.functions import analysis
from docsieve.parser import Bool, Leaf

ALONE = r"\p{Han}\p{Hiragana}"
WORD = regex.compile(rf"[{ALONE}]|(?:(?![{ALONE}])[\p{{L}}\p{{M}}\p{{N}}ー])+")
BLOCK = regex.compile(r"[^ \t\n\x0b\f\r]+")


class Spot(NamedTuple):
    """A term of a text, its position, and where its characters begin and end."""

    term: str
    pos: int
    start: int
    end: int


def code_spots(text: str) -> list[Spot]:
    out, at = [], 0
    for m in BLOCK.finditer(text):
        cuts = [(c.start(), c.end()) for c in analysis.CUTTER.finditer(m[0])]
        edges = [0, *(x for c in cuts for x in c), len(m[0])]
        parts = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
        out.append(Spot(m[0].lower(), at, m.start(), m.end()))
        run = -1
        for k, (a, b) in enumerate(parts):
            number = bool(regex.match(r"\p{N}", m[0][a]))
            if (a, b) != (0, len(m[0])):
                out.append(Spot(m[0][a:b].lower(), at + k, m.start() + a, m.start() + b))
            if k == 0 or number != bool(regex.match(r"\p{N}", m[0][parts[k - 1][0]])):
                run = k
            elif k + 1 == len(parts) or number != bool(regex.match(r"\p{N}", m[0][parts[k + 1][0]])):
                joined = "".join(m[0][x:y] for x, y in parts[run : k + 1])
                out.append(Spot(joined.lower(), at + run, m.start() + parts[run][0], m.start() + b))
        at += max(1, len(parts))
    return out


def spots(kind: str, text: str) -> list[Spot]:
    """The index-side chain of a field kind, with offsets."""
    if kind == "code":
        return code_spots(text)
    out = []
    for pos, m in enumerate(WORD.finditer(text)):
        term = m[0].lower()
        if term not in analysis.STOP:
            out.append(Spot(term, pos, m.start(), m.end()))
        if kind == "ocr" and (plain := term.translate(analysis.FOLD)) != term and plain not in analysis.STOP:
            out.append(Spot(plain, pos, m.start(), m.end()))
    return out


def osa(a: str, b: str) -> int:
    """Restricted edit distance, as ``plans.terms.osa`` computes it on executors."""
    older, old = [], [*range(len(b) + 1)]
    for i, c in enumerate(a):
        row = [i + 1]
        for j, d in enumerate(b):
            best = min(old[j + 1] + 1, row[j] + 1, old[j] + (c != d))
            if i and j and c == b[j - 1] and a[i - 1] == d:
                best = min(best, older[j - 1] + 1)
            row.append(best)
        older, old = old, row
    return old[-1]


def phrase_spots(found: list[Spot], pieces: list[analysis.Piece], slop: int) -> set[Spot]:
    """The spots that stand in a match of the phrase."""
    at: dict[str, list[Spot]] = {}
    for s in found:
        at.setdefault(s.term, []).append(s)
    where = lambda terms: [s for t in terms for s in at.get(t, ())]
    marked: set[Spot] = set()
    if slop:
        wanted = analysis.slots(pieces)
        first = wanted[0]
        for p in where(first.terms):
            best: tuple[int, list[Spot]] | None = None
            near = [sorted((q for q in where(t.terms) if abs(q.pos - p.pos - t.pos + first.pos) <= slop), key=lambda q: q.pos) for t in wanted[1:]]
            offs = [t.pos - first.pos for t in wanted[1:]]
            for low in {p.pos, *(q.pos - o for some, o in zip(near, offs, strict=True) for q in some if q.pos - o <= p.pos)}:
                chosen = [p]
                for some, o in zip(near, offs, strict=True):
                    free = [q for q in some if q.pos - o >= low and all(q.pos != c.pos for c in chosen)]
                    if not free:
                        break
                    chosen.append(free[0])
                else:
                    span = max([p.pos, *(c.pos - o for c, o in zip(chosen[1:], offs, strict=True))]) - low
                    if span <= slop and (best is None or span < best[0]):
                        best = span, chosen
            marked |= set(best[1]) if best else set()
        return marked

    def ways(at_pos: int | None, rest: list[analysis.Piece]) -> Iterator[list[Spot]]:
        if not rest:
            yield []
            return
        for way in rest[0].ways:
            for begin in where(way[0]):
                if at_pos is not None and begin.pos != at_pos + rest[0].skip:
                    continue
                steps = [begin, *(next((s for s in where(g) if s.pos == begin.pos + k), None) for k, g in enumerate(way[1:], 1))]
                if None not in steps:
                    for more in ways(begin.pos + len(way), rest[1:]):
                        yield [*steps, *more]

    for way in ways(None, pieces):
        marked |= set(way)
    return marked


def marker(leaf: Leaf, kind: str) -> Callable[[list[Spot]], set[Spot]]:
    """What the clause marks among the spots of a field of this kind."""
    word = leaf.text.lower()
    if leaf.kind in ("term", "phrase"):
        pieces = analysis.query_pieces(kind, leaf.text)
        return lambda found: phrase_spots(found, pieces, leaf.slop) if pieces else set()
    if leaf.kind == "fuzzy":
        test = lambda t: abs(len(t) - len(word)) <= leaf.slop and osa(t, word) <= leaf.slop
    elif leaf.kind in ("wildcard", "regex"):
        pattern = regex.compile(analysis.wildcard(word) if leaf.kind == "wildcard" else leaf.text)
        test = lambda t: pattern.fullmatch(t) is not None
    elif leaf.kind == "range":
        above = lambda t: leaf.low is None or (t >= leaf.low if leaf.closed[0] else t > leaf.low)
        test = lambda t: above(t) and (leaf.high is None or (t <= leaf.high if leaf.closed[1] else t < leaf.high))
    else:
        return lambda found: set()
    return lambda found: {s for s in found if test(s.term)}


def positive(node: Leaf | Bool) -> list[Leaf]:
    """Clauses whose matches are marked: all but the negated ones."""
    return [node] if isinstance(node, Leaf) else [x for o, p in node.parts if o != "not" for x in positive(p)]


def marked(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """The stretch of a text, escaped, with what lies in ``spans`` in <mark>."""
    out, at = [], start
    for a, b in spans:
        out += [escape(text[at:a]), "<mark>", escape(text[a:b]), "</mark>"]
        at = b
    return "".join([*out, escape(text[at:end])])


def snippets(texts: list[str], kind: str, leaves: list[Leaf], count: int = schema.SNIPPETS, chars: int = schema.SNIPPET_CHARS) -> list[str]:
    """The best passages of a field's values, at most ``count``."""
    markers = [marker(leaf, kind) for leaf in leaves]
    found = []
    for nth, text in enumerate(texts):
        all_spots = spots(kind, text)
        by_clause = [m(all_spots) for m in markers]
        starts: dict[int, int] = {}
        for s in all_spots:
            starts[s.end // chars] = min(starts.get(s.end // chars, s.start), s.start)
        order = sorted(starts)
        for k, passage in enumerate(order):
            begin, stop = starts[passage] if k else 0, starts[order[k + 1]] if k + 1 < len(order) else len(text)
            inside = [{s for s in some if s.end // chars == passage} for some in by_clause]
            if any(inside):
                spans: list[tuple[int, int]] = []
                for s in sorted({(s.start, s.end) for some in inside for s in some}):
                    if spans and s[0] < spans[-1][1]:
                        spans[-1] = spans[-1][0], max(spans[-1][1], s[1])
                    else:
                        spans.append(s)
                score = sum(map(bool, inside)), len(spans)
                found.append(((-score[0], -score[1], nth, passage), marked(text, min(begin, spans[0][0]), max(stop, spans[-1][1]), spans).strip()))
    return [text for _, text in sorted(found)[:count]]


def highlight(docs: DataFrame, node: Leaf | Bool, names: list[str]) -> DataFrame:
    """(id, field, snippets) of the ``docs`` of a page: every clause marks in every field, as each field is analysed."""
    leaves = positive(node)
    fields = [(n, schema.field(n).kind, schema.field(n).many) for n in names]

    def work(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = []
            for doc in page.to_dict("records"):
                for name, kind, many in fields:
                    value = doc[name]
                    texts = [] if value is None or isinstance(value, float) else [v for v in value if v is not None] if many else [value]
                    if best := snippets(texts, kind, leaves):
                        rows.append((doc["id"], name, best))
            yield pd.DataFrame(rows, columns=["id", "field", "snippets"])

    return docs.select(F.col("id"), *names).mapInPandas(work, "id string, field string, snippets array<string>")
