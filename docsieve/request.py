"""Search requests: parsing of URL arguments, the modifier ladder and literal filter strings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

from docsieve import schema
from docsieve.errors import SearchError

ALL = "*:*"


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    phrase: bool = False
    exact: bool = False
    fuzzy: str = "0"
    proximity: str = "0"
    op: str = "OR"
    parser: str = "edismax"
    mm: str = ""
    bf: str = ""
    lang: str = ""
    repository: tuple[str, ...] = ()
    file_type: tuple[str, ...] = ()
    date_from: str = ""
    date_to: str = ""
    fq: str = ""
    sort: str = "score desc"
    rows: int = 10
    page: int = 1
    group_by: str = ""
    hl: bool = True
    debug: bool = False

    def __post_init__(self):
        if self.op not in ("OR", "AND"):
            raise SearchError(f"op: {self.op}")
        if self.parser not in ("edismax", "dismax", "lucene"):
            raise SearchError(f"parser: {self.parser}")

    @property
    def start(self) -> int:
        return (self.page - 1) * self.rows

    @property
    def active(self) -> bool:
        """Whether a browse page runs it: a query or a filter is given."""
        return any((self.q, self.lang, self.repository, self.file_type, self.date_from, self.date_to, self.fq))

    @classmethod
    def from_args(cls, args: Mapping) -> SearchRequest:
        """From a mapping of names to a string or a list of strings."""

        def many(name: str) -> tuple[str, ...]:
            found = args.getlist(name) if hasattr(args, "getlist") else args.get(name, [])
            return tuple(v for x in ([found] if isinstance(found, str) else found) if (v := x.strip()))

        def one(name: str, default: str = "") -> str:
            return (many(name) or (default,))[0]

        def number(name: str, default: int) -> int:
            try:
                return int(one(name, str(default)))
            except ValueError:
                raise ValueError(f"{name} must be an integer") from None

        return cls(
            q=one("q"), phrase=one("phrase") == "1", exact=one("exact") == "1", fuzzy=one("fuzzy", "0"), proximity=one("proximity", "0"), op=one("op", "OR"),
            parser=one("parser", "edismax"), mm=one("mm"), bf=one("bf"), lang=one("lang"), repository=many("repository"), file_type=many("file_type"),
            date_from=one("date_from"), date_to=one("date_to"), fq=one("fq"), sort=one("sort", "score desc"), rows=max(0, min(number("rows", 10), schema.MAX_ROWS)),
            page=max(number("page", 1), 1), group_by=one("group_by"), hl=one("hl") != "0", debug=one("debug") == "1",
        )


def whole(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        return 0


def words(q: str) -> list[str]:
    """Whitespace-separated terms; quoted stretches stay together."""
    import re

    return re.findall(r'-?"[^"]*"|\S+', q)


def rewrite(request: SearchRequest) -> str:
    """The query string after modifiers: proximity, else exact or fuzzy terms, else one phrase."""
    q = request.q or ALL
    bare = q.strip('"')
    if q == ALL:
        return q
    if (slop := whole(request.proximity)) > 0:
        return f'"{bare}"~{slop}'
    if request.phrase:
        return f'"{bare}"'
    plain = lambda t: t[0] in '-"' or t.endswith('"')  # noqa: E731  already negated or quoted
    if request.exact:
        return " ".join(t if plain(t) else f'"{t}"' for t in words(q))
    if (edits := whole(request.fuzzy)) > 0:
        return " ".join(t if plain(t) else f"{t}~{edits}" for t in words(q))
    return q


def required(n: int, spec: str) -> int:
    """How many of n optional clauses must match."""
    spec, wanted = spec.strip() or "1", n
    if "<" in spec:
        for part in spec.split():
            bound, _, rule = part.partition("<")
            if n <= int(bound):
                return wanted if wanted < n else min(n, wanted)
            wanted = required(n, rule)
        return wanted
    value = int(float(spec.rstrip("%")) * n / 100) if spec.endswith("%") else int(spec)
    return max(0, min(n, n + value if value < 0 or spec.startswith("-") else value))


def _edit(url: str, change) -> str:
    parsed = urlparse(url)
    args = parse_qs(parsed.query, keep_blank_values=True)
    change(args)
    return urlunparse(parsed._replace(query=urlencode(args, doseq=True)))


def remove_param(url: str, name: str) -> str:
    return _edit(url, lambda a: a.pop(name, None))


def set_param(url: str, name: str, value: str) -> str:
    return _edit(url, lambda a: a.update({name: [value]}))


def add_facet(url: str, name: str, value: str) -> str:
    return _edit(url, lambda a: a.update({name: [value], "page": ["1"]}))


def toggle_facet(url: str, name: str, value: str) -> str:
    """Add the value to a repeated argument or take it away, and go back to page 1."""
    name = {"language": "lang"}.get(name, name)

    def change(args: dict) -> None:
        now = args.pop(name, [])
        if left := [x for x in now if x != value] + [value] * (value not in now):
            args[name] = left
        args["page"] = ["1"]

    return _edit(url, change)


def page_window(page: int, pages: int, around: int = 2) -> list[int]:
    return [*range(max(1, page - around), min(pages, page + around) + 1)]
