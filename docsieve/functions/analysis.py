"""Text analysis: Column expressions for documents, and the same chains in Python for query strings.

A Column analyzer gives an array of (term, pos) structs. Both sides share the tables and patterns below.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and synonym classes.
STOP = ("a", "an", "the", "is", "in", "on", "at", "of", "to", "and", "or", "for", "with")
SYNONYMS = (("auth", "authentication", "authorize"), ("payment", "billing", "charge"), ("search", "query", "find", "lookup"))
GAP = 100
#: Han and Hiragana stand alone; everything else is a run of letters, marks and digits.
SINGLE = r"([\p{IsHan}\p{IsHiragana}])"
BREAK = r"[^\p{L}\p{M}\p{N}ー]+"
#: Accented letters and what they fold to, by Unicode decomposition; crossed letters do not decompose.
CROSSED = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}


def _folding() -> tuple[str, str]:
    import unicodedata

    pairs = dict(CROSSED)
    for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(k))[0]
        if base != chr(k) and base.isascii():
            pairs[chr(k)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _folding()
FOLD = str.maketrans(ACCENTED, PLAIN)


#: Nothing below this character stands alone; a cheap test that spares most texts the look at scripts.
EAST = "[\u2e80-\U0010ffff]"


def standard(text: Column) -> Column:
    """Word-break tokens of a string."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.when(text.rlike(EAST), F.regexp_replace(text, SINGLE, " $1 ")).otherwise(text), BREAK), "")


def numbered(tokens: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def unstopped(tokens: Column) -> Column:
    """Lower-cased tokens without stop words; positions keep their gaps."""
    return F.filter(tokens, lambda t: ~t["term"].isin(*STOP))


def general(text: Column) -> Column:
    return unstopped(numbered(standard(F.lower(text))))


def ocr(text: Column) -> Column:
    """Lower-cased, with accented terms also in plain form at the same position, stop words out."""
    both = F.transform(numbered(standard(F.lower(text))), lambda t: F.transform(F.array_distinct(F.array(t["term"], F.translate(t["term"], ACCENTED, PLAIN))), lambda x: F.struct(x.alias("term"), t["pos"].alias("pos"))))
    return unstopped(F.flatten(both))


#: Where an identifier is cut: before a capital after a small letter, between letters and digits, at punctuation.
CUT = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|[^\p{L}\p{M}\p{N}]+"


CUTTER = regex.compile(CUT)


def parts(token: Column) -> Column:
    return F.array_remove(F.split(token, CUT), "")


def code(text: Column, catenate: bool = True) -> Column:
    """Whitespace tokens cut into parts at positions of their own. A token as it is stands where its first part stands, and with
    ``catenate`` a run of word parts or of number parts stands joined where the run begins: a graph of forms, flattened.

    The n-th part of a text has position n, whatever token it is of, so no position waits for the tokens before it."""

    def number(part: Column) -> Column:
        return part.rlike(r"^\p{N}")

    def joined(pieces: Column, at: Column) -> Column:
        """The run that begins at a part, in one."""
        kind = number(F.get(pieces, at))
        rest = F.transform(F.slice(pieces, at + 1, F.size(pieces)), lambda x: F.when(number(x) == kind, x).otherwise(F.lit(" ")))
        return F.get(F.split(F.array_join(rest, ""), " ", 2), F.lit(0))

    def forms(token: Column) -> Column:
        """For each part of the token, what stands at its position."""

        def cut(pieces: Column) -> Column:
            def at(part: Column, k: Column) -> Column:
                found = [F.array(part), F.when(k == 0, F.array(token)).otherwise(F.array().cast("array<string>"))]
                if catenate:
                    begins = (k == 0) | (number(F.get(pieces, k - 1)) != number(part))
                    found.append(F.when(begins, F.array(joined(pieces, k))).otherwise(F.array().cast("array<string>")))
                return F.array_distinct(F.transform(F.concat(*found), lambda x: F.lower(x)))

            return F.when(F.size(pieces) < 2, F.array(F.array_distinct(F.transform(F.concat(pieces, F.array(token)), lambda x: F.lower(x))))).otherwise(F.transform(pieces, at))

        return F.get(F.transform(F.array(parts(token)), cut), F.lit(0))

    tokens = F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), "")
    return F.flatten(F.transform(F.flatten(F.transform(tokens, forms)), lambda found, n: F.transform(found, lambda x: F.struct(x.alias("term"), n.alias("pos")))))


def multi(values: Column, chain) -> Column:
    """A multi-valued field: each value's positions start GAP after the end of the one before. One value needs no shifting."""
    sized = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: chain(v))

    def step(held: Column, tokens: Column) -> Column:
        moved = F.transform(tokens, lambda t: F.struct(t["term"].alias("term"), (t["pos"] + held["base"]).alias("pos")))
        end = F.coalesce(F.array_max(F.transform(moved, lambda t: t["pos"])) + 1, held["base"])
        return F.struct(F.concat(held["all"], moved).alias("all"), (end + GAP).cast("int").alias("base"))

    start = F.struct(F.array().cast("array<struct<term:string,pos:int>>").alias("all"), F.lit(0).alias("base"))
    return F.when(F.size(values) == 1, chain(F.get(values, F.lit(0)))).otherwise(F.aggregate(sized, start, step, lambda held: held["all"]))


COLUMNS = {"general": general, "ocr": ocr, "code": code, "string": lambda text: F.when(text.isNull(), F.array().cast("array<struct<term:string,pos:int>>")).otherwise(numbered(F.array(text)))}


class Token(NamedTuple):
    """A query token: equivalent terms at a position."""

    terms: tuple[str, ...]
    pos: int


def synonym_table(rules: tuple = SYNONYMS) -> dict[str, tuple[str, ...]]:
    """Terms and what they expand to; a rule is a class of equals, or a pair ("a => b", explicit) given as {from: to}."""
    table: dict[str, tuple[str, ...]] = {}
    for rule in rules:
        for left, right in (rule.items() if isinstance(rule, dict) else ((w, tuple(rule)) for w in rule)):
            table[left] = tuple(right) if not isinstance(right, str) else (right,)
    return table


def parse_synonyms(text: str) -> tuple:
    """Rules of a synonym file: "a, b" is a class of equals, "a, b => c, d" maps each left term to the right ones."""
    rules: list = []
    split = lambda part: tuple(w.strip().lower() for w in part.split(",") if w.strip())
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if "=>" in line:
            left, _, right = line.partition("=>")
            rules.append({w: split(right) for w in split(left)})
        elif line:
            rules.append(split(line))
    return tuple(rules)


class Piece(NamedTuple):
    """A stretch of a query: the ways through it, each a row of neighbouring places with equivalent terms, and the places left
    empty before it, where words were dropped."""

    ways: tuple[tuple[tuple[str, ...], ...], ...]
    skip: int = 0


def query_pieces(kind: str, text: str) -> list[Piece]:
    """The query-side chain of a field kind as a graph of forms. An identifier can be passed whole or part by part; from all
    other tokens there is one way on."""
    if kind != "code":
        out, at = [], None
        for t in query_tokens(kind, text):
            out.append(Piece(((t.terms,),), 0 if at is None else t.pos - at - 1))
            at = t.pos
        return out
    out = []
    for token in text.split():
        whole, cut = ((token.lower(),),), tuple((p.lower(),) for p in CUTTER.split(token) if p)
        out.append(Piece((whole, cut) if cut and cut != whole else (whole,)))
    return out


def slots(pieces: list[Piece]) -> list[Token]:
    """The longest way through the pieces, place by place."""
    out, at = [], 0
    for p in pieces:
        at += p.skip
        for terms in max(p.ways, key=len):
            out.append(Token(terms, at))
            at += 1
    return out


def query_tokens(kind: str, text: str) -> list[Token]:
    """The query-side chain of a field kind, place by place; identifiers are given part by part, and whole at their first part."""
    if kind == "string":
        return [Token((text,), 0)] if text else []
    if kind == "code":
        out, at = [], 0
        for p in query_pieces(kind, text):
            for way in p.ways:
                out += [Token(terms, at + k) for k, terms in enumerate(way)]
            at += max(map(len, p.ways))
        return out
    spaced = regex.sub(r"([\p{Han}\p{Hiragana}])", r" \1 ", text)
    words = [(i, w) for i, w in enumerate(x for x in regex.split(BREAK, spaced) if x)]
    if kind == "ocr":
        low = [(i, w.lower()) for i, w in words]
        return [Token(tuple(dict.fromkeys((w, w.translate(FOLD)))), i) for i, w in low if w not in STOP]
    table = synonym_table()
    return [Token(tuple(dict.fromkeys((w.lower(), *table.get(w.lower(), ())))), i) for i, w in words if w.lower() not in STOP]


def wildcard(pattern: str) -> str:
    """The regular expression of a term with * and ?; a backslash takes the next character as it is."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c[-1]) for c in re.findall(r"\\.|.", pattern, re.S))
