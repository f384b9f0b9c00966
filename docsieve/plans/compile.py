"""From the AST to Columns: per-row frequencies first, then scores from those and one row of corpus statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.errors import SearchError
from docsieve.functions import analysis
from docsieve.parser import Bool, Leaf
from docsieve.plans import terms
from docsieve.plans.boost import date_math

K1, B = 1.2, 0.75


def tokens(name: str) -> Column:
    f = schema.field(name)
    chain = analysis.COLUMNS[f.kind if f.text else "string"]
    return analysis.multi(F.col(name), chain) if f.many else chain(F.col(name).cast("string"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def literal(name: str, text: str) -> Column:
    """A value of a field's type, checked before anything runs."""
    kind = schema.field(name).kind
    if kind == "date":
        return date_math(text)
    try:
        if kind in ("int", "long"):
            int(text)
        elif kind in ("float", "double"):
            float(text)
        elif kind == "boolean" and text.lower() not in ("true", "false"):
            raise ValueError
    except ValueError:
        raise SearchError(f"{text} is not a value of field {name}") from None
    return F.lit(text).cast(schema.KINDS[kind])


def predicate(leaf: Leaf) -> Column:
    """A leaf on a field that is not analysed."""
    name, f = leaf.field, schema.field(leaf.field)
    if not f.indexed and leaf.kind != "exists":
        raise SearchError(f"field {name} is not indexed")
    if leaf.kind == "exists":
        return F.col(name).isNotNull()

    def test(c: Column) -> Column:
        if leaf.kind == "range":
            low = F.lit(True) if leaf.low is None else c >= literal(name, leaf.low) if leaf.closed[0] else c > literal(name, leaf.low)
            high = F.lit(True) if leaf.high is None else c <= literal(name, leaf.high) if leaf.closed[1] else c < literal(name, leaf.high)
            return low & high & c.isNotNull()
        if leaf.kind == "wildcard":  # values that are not analysed keep their case
            return c.cast("string").rlike(f"^(?:{analysis.wildcard(leaf.text)})$")
        if leaf.kind == "regex":
            return c.cast("string").rlike(terms.expression(leaf))
        if leaf.kind == "fuzzy":
            return terms.near(c.cast("string"), leaf.text, leaf.slop)
        return c == literal(name, leaf.text)

    return F.coalesce(F.exists(F.col(name), test) if f.many else test(F.col(name)), F.lit(False))


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; as a plain expression it would be computed wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spots(toks: Column, words: tuple[str, ...]) -> Column:
    return F.array_distinct(F.transform(F.filter(toks, lambda t: t["term"].isin(*words)), lambda t: t["pos"]))


def places(toks: Column, groups: list[tuple[str, ...]]) -> Column:
    """A struct of the places of each group of terms, found once for a text."""
    return F.struct(*(spots(toks, g).alias(f"g{k}") for k, g in enumerate(groups)))


def walk_frequency(toks: Column, pieces: list[analysis.Piece]) -> Column:
    """At how many places a way through all pieces begins, each piece right after the one before and the places it skips."""
    groups = [*dict.fromkeys(g for p in pieces for way in p.ways for g in way)]

    def walk(at: Column) -> Column:
        def goes(q: Column, way: tuple) -> Column:
            return reduce(lambda a, b: a & b, (F.array_contains(at[f"g{groups.index(g)}"], q + k) for k, g in enumerate(way)))

        def on(states: Column, rest: list[analysis.Piece]) -> Column:
            """``states``: where a way began, and where it goes on."""
            if not rest:
                return F.size(F.array_distinct(F.transform(states, lambda s: s["begun"]))).cast("double")
            piece, rest = rest[0], rest[1:]
            step = lambda way: F.transform(F.filter(states, lambda s: goes(s["next"] + piece.skip, way)), lambda s: F.struct(s["begun"].alias("begun"), (s["next"] + (piece.skip + len(way))).alias("next")))
            return held(F.concat(*map(step, piece.ways)), lambda found: on(found, rest))

        def begin(way: tuple) -> Column:
            first = at[f"g{groups.index(way[0])}"]
            return F.transform(F.filter(first, lambda q: goes(q, way)), lambda q: F.struct(q.alias("begun"), (q + len(way)).alias("next")))

        return held(F.concat(*map(begin, pieces[0].ways)), lambda found: on(found, pieces[1:]))

    return held(places(toks, groups), walk)


def sloppy_frequency(toks: Column, wanted: list[analysis.Token], slop: int) -> Column:
    """Sum of 1 / (1 + span) over the places of the first term.

    A term at place p that the query has at its o-th place is out of place by p - o; the span of an alignment is the largest
    such number less the smallest. For each place of the first term the alignment of least span counts, if it is within the
    slop; no place of the text serves two terms. For each smallest number that an alignment may have, terms take the
    first free place from there on, in the order of the query: a later term may start no earlier, so none is served worse."""
    groups = [*dict.fromkeys(t.terms for t in wanted)]
    first, rest = wanted[0], wanted[1:]

    def weigh(at: Column) -> Column:
        def near(p: Column) -> Column:
            """The other terms' places that can be within the slop of a first term at ``p``, with the terms' offsets."""
            one = lambda t: F.struct(F.array_sort(F.filter(at[f"g{groups.index(t.terms)}"], lambda q: F.abs(q - p - (t.pos - first.pos)) <= slop)).alias("at"), F.lit(t.pos - first.pos).alias("off"))
            return F.array(*map(one, rest))

        def span(p: Column, others: Column, low: Column) -> Column:
            def take(held_: Column, t: Column) -> Column:
                free = F.filter(t["at"], lambda q: (q - t["off"] >= low) & ~F.array_contains(held_["used"], q))
                return held(F.get(free, F.lit(0)), lambda q: F.struct(F.when(q.isNotNull() & held_["high"].isNotNull(), F.greatest(held_["high"], q - t["off"])).alias("high"), F.concat(held_["used"], F.array(F.coalesce(q, F.lit(-1)))).alias("used")))

            return F.aggregate(others, F.struct(p.alias("high"), F.array(p).alias("used")), take, lambda held_: held_["high"] - low)

        def least(p: Column) -> Column:
            def over(others: Column) -> Column:
                shifted = F.flatten(F.transform(others, lambda t: F.filter(F.transform(t["at"], lambda q: q - t["off"]), lambda x: x <= p)))
                return F.array_min(F.transform(F.array_distinct(F.concat(F.array(p), shifted)), lambda low: span(p, others, low)))

            return held(near(p), over)

        weight = lambda p: held(least(p), lambda d: F.when(d <= slop, 1.0 / (1.0 + d)).otherwise(0.0))
        some = reduce(lambda a, b: a & b, (F.size(at[f"g{k}"]) > 0 for k in range(len(groups))))
        return F.when(some, F.aggregate(F.transform(at[f"g{groups.index(first.terms)}"], weight), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)

    return held(places(toks, groups), weigh)


def holds(toks: Column, words: tuple[str, ...]) -> Column:
    return F.exists(toks, lambda t: t["term"].isin(*words))


def occurrences(toks: Column, words: tuple[str, ...] | list[str]) -> Column:
    """How many tokens are one of some terms."""
    if len(words) > 4:
        return F.size(F.filter(toks, lambda t: t["term"].isin(*words))).cast("double")
    plain = F.transform(toks, lambda t: t["term"])
    return (F.size(plain) * len(words) - sum((F.size(F.array_remove(plain, x)) for x in words), F.lit(0))).cast("double")


def frequency(leaf: Leaf, name: str, toks: Column, found: terms.Terms | None = None) -> Column | None:
    """How often the leaf matches in the field; None where its analysis leaves nothing. ``found``: the terms that a clause by a
    test names; without them each token is tested."""
    f = schema.field(name)
    if leaf.kind == "exists":
        return F.col(name).isNotNull().cast("double")
    if not f.text:
        return predicate(Leaf(leaf.kind if leaf.kind != "phrase" else "term", leaf.text, name, leaf.slop, leaf.low, leaf.high, leaf.closed)).cast("double")
    if leaf.kind in terms.TESTED:
        if found is not None:
            return sum((w * occurrences(toks, words) for w, words in found.by_weight.items()), F.lit(0.0))
        return F.aggregate(F.filter(toks, lambda t: terms.passes(leaf, t["term"])), F.lit(0.0), lambda a, t: a + terms.weight(leaf, t["term"]))
    pieces = analysis.query_pieces(f.kind, leaf.text)
    if not pieces:
        return None
    wanted = analysis.slots(pieces)
    if len(pieces) == 1 and len(pieces[0].ways) == 1 and len(wanted) == 1:
        return occurrences(toks, wanted[0].terms)
    return sloppy_frequency(toks, wanted, leaf.slop) if leaf.slop and len(wanted) > 1 else walk_frequency(toks, pieces)


def named_terms(leaf: Leaf, name: str, found: terms.Terms | None) -> tuple[tuple[str, ...], Callable[[Column], Column] | None]:
    """The terms that ``frequency`` of a leaf counts in an analysed field: words, or a test of a term."""
    if leaf.kind in terms.TESTED:
        return (tuple(found.all), None) if found is not None else ((), lambda x: terms.passes(leaf, x))
    return tuple(dict.fromkeys(x for p in analysis.query_pieces(schema.field(name).kind, leaf.text) for way in p.ways for g in way for x in g)), None


def clauses(node: Leaf | Bool) -> int:
    return 1 if isinstance(node, Leaf) else sum(clauses(part) for _, part in node.parts)


def tree(value: Column, what: str, parts: list[Column], **details: Column) -> Column:
    """A part of an explanation as JSON; parts that are null are left out."""
    some = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return F.to_json(F.struct(value.cast("double").alias("value"), F.lit(what).alias("what"), *(c.cast("double").alias(k) for k, c in details.items()), some.alias("parts")))


class Compiled:
    """Columns of one query. ``row``: what each document gives before statistics; ``stats``: aggregates over all rows."""

    def __init__(self, node: Bool, weights: dict[str, float], available: set[str], mm: str | None = None, whole: str | None = None, found: dict[tuple[Leaf, str], terms.Terms | None] | None = None, explain: bool = False):
        self.explain = explain
        self.weights, self.available, self.found = {k: v for k, v in weights.items() if k in available}, available, found or {}
        self.toks: dict[str, Column] = {}
        self.row: dict[str, Column] = {}
        #: Of the columns of ``row`` that come from tokens, the analysed field; others come from values.
        self.from_tokens: dict[str, str] = {}
        self.stats: dict[str, Column] = {"__n": F.count("id")}
        self.leaves: list[str] = []
        #: What each leaf in each field adds to a score, before the best field of a leaf is taken.
        self.shares: dict[str, Column] = {}
        if clauses(node) > schema.MAX_CLAUSES:
            raise SearchError(f"more than {schema.MAX_CLAUSES} clauses")
        #: By analysed field, what terms each clause names: words, or a test of a term.
        self.picks: dict[str, list[tuple[tuple[str, ...], Callable[[Column], Column] | None]]] = {}
        self.text_only = True
        #: By clause or group of clauses, what its score is made of, as JSON; see ``explanation``.
        self.trees: dict[int, Column] = {}
        self.match, self.score = self._node(node, mm)
        self.parts = [(self.match, self.trees.get(id(node)))]
        strings = {n: w for n, w in self.weights.items() if not schema.field(n).text}
        if whole is not None and strings:
            # A value that is not analysed can be the whole query, which no single term of it would find.
            leaf = Leaf("term", whole)
            match, score = self._leaf(leaf, strings)
            self.match, self.score = self.match | match, F.when(self.match, self.score).otherwise(0.0) + score
            self.parts.append((match, self.trees.get(id(leaf))))

    def explanation(self, boost: Column) -> Column:
        """What a score is made of, as JSON: {value, what, parts}, where parts are JSON texts of their own. A sum is that of its
        parts times its boost; of the fields of a clause the best counts; a clause in a field is weight x idf x tf, and tf is
        frequency / (frequency + norm), where norm grows with the field's length."""
        extra = tree(boost, "boost function", [])
        return tree(F.when(self.match, self.score + boost), "sum", [*(F.when(m, t) for m, t in self.parts), F.when(boost != 0, extra)], boost=F.lit(1.0))

    def _field(self, name: str) -> Column:
        if name not in self.toks and schema.field(name).text:
            self.toks[name] = tokens(name)
            self.from_tokens[f"__d_{name}"] = name
            self.row[f"__d_{name}"] = F.size(F.array_distinct(F.transform(F.col(f"__t_{name}"), lambda t: t["pos"])))
            self.stats[f"__a_{name}"] = F.avg(f"__d_{name}")
        return F.col(f"__t_{name}")

    def _leaf(self, leaf: Leaf, fields: dict[str, float] | None = None) -> tuple[Column | None, Column | None]:
        """Match and score; None where analysis leaves nothing of the leaf."""
        if leaf.kind == "all":
            self.text_only = False
            value = F.lit(leaf.constant if leaf.constant is not None else leaf.boost)
            self._note(leaf, lambda: tree(value, "all", []))
            return F.lit(True), value
        tests, scores, shares = [], [], []
        if leaf.field is None and leaf.kind == "term" and not analysis.query_tokens("general", leaf.text):
            return None, None  # a stop word asks for nothing, also in fields that keep it
        if leaf.field and schema.field(leaf.field).name not in self.available:
            raise SearchError(f"the documents have no field {leaf.field}")
        for name, weight in (fields or ({leaf.field: 1.0} if leaf.field else self.weights)).items():
            some = self.found.get((leaf, name))
            freq = frequency(leaf, name, self._field(name), some)
            if freq is None:
                continue
            f, key = schema.field(name), f"{len(self.leaves)}"
            if f.text and leaf.kind != "exists":
                self.picks.setdefault(name, []).append(named_terms(leaf, name, some))
            else:
                self.text_only = False
            self.leaves.append(f"{name}:{leaf.kind}:{leaf.text}")
            self.row[f"__f_{key}"] = freq
            if f.text and leaf.kind != "exists":
                self.from_tokens[f"__f_{key}"] = name
            # A phrase is as rare as its words together; anything else as the documents that it is found in.
            wanted = analysis.slots(analysis.query_pieces(f.kind, leaf.text)) if f.text and leaf.kind in ("term", "phrase") else []
            if len(wanted) > 1:
                for j, t in enumerate(wanted):
                    self.from_tokens[f"__g_{key}_{j}"] = name
                    self.row[f"__g_{key}_{j}"] = holds(self._field(name), t.terms)
                    self.stats[f"__c_{key}_{j}"] = F.sum(F.col(f"__g_{key}_{j}").cast("long"))
                counts = [F.col(f"__c_{key}_{j}") for j in range(len(wanted))]
            else:
                self.stats[f"__c_{key}"] = F.sum((F.col(f"__f_{key}") > 0).cast("long"))
                counts = [F.col(f"__c_{key}")]
            tf, n = F.col(f"__f_{key}"), F.col("__n")
            idf = sum((F.log(1 + (n - df + 0.5) / (df + 0.5)) for df in counts), F.lit(0.0))
            long = K1 * (1 - B + B * F.col(f"__d_{name}") / F.col(f"__a_{name}")) if f.text else F.lit(K1)
            tests.append(tf > 0)
            scores.append(F.when(tf > 0, weight * idf * tf / (tf + long)).otherwise(0.0))
            self.shares[self.leaves[-1]] = scores[-1]
            size = {"length": F.col(f"__d_{name}"), "average": F.col(f"__a_{name}")} if f.text else {}
            if self.explain:
                shares.append(F.when(tf > 0, tree(scores[-1], self.leaves[-1], [], weight=F.lit(float(weight)), idf=idf, frequency=tf, tf=tf / (tf + long), norm=long, **size)))
        if not tests:
            return None, None
        best = scores[0] if len(scores) == 1 else F.greatest(*scores)
        match = any_of(tests)
        score = F.when(match, leaf.constant).otherwise(0.0) if leaf.constant is not None else best * leaf.boost
        self._note(leaf, lambda: tree(score, "constant", []) if leaf.constant is not None else tree(score, "best", shares, boost=F.lit(leaf.boost)))
        return match, score

    def _node(self, node: Leaf | Bool, mm: str | None = None) -> tuple[Column, Column]:
        from docsieve.request import required

        if isinstance(node, Leaf):
            return self._leaf(node)
        before = len(self.leaves)
        found = [(occur, part, *self._node(part)) for occur, part in node.parts]
        # Clauses that analysis leaves empty (stop words) are not counted.
        found = [x for x in found if x[2] is not None]
        must, should = [m for o, _, m, _ in found if o == "must"], [m for o, _, m, _ in found if o == "should"]
        never = [m for o, _, m, _ in found if o == "not"]
        match = reduce(lambda a, b: a & b, must, F.lit(bool(must or should or (never and before >= 0))))
        if should:
            need = required(len(should), mm) if mm else 0 if must else 1
            if need:
                match = match & (sum((m.cast("int") for m in should), F.lit(0)) >= need)
        for m in never:
            match = match & ~m
        score = sum((F.when(m, s).otherwise(0.0) for o, _, m, s in found if o != "not"), F.lit(0.0)) * node.boost
        if node.constant is not None:
            score = F.when(match, node.constant).otherwise(0.0)
            self._note(node, lambda: tree(score, "constant", []))
        else:
            self._note(node, lambda: tree(score, "sum", [F.when(m, self.trees[id(part)]) for o, part, m, _ in found if o != "not"], boost=F.lit(node.boost)))
        return match, score

    def _note(self, part: Leaf | Bool, make: Callable[[], Column]) -> None:
        if self.explain:
            self.trees[id(part)] = make()


def order(spec: str, available: set[str] | None = None) -> list[Column]:
    """Sort keys of "field dir, ..."; ids break ties. ``available``: fields that the documents have."""
    keys = []
    for part in spec.split(","):
        name, _, way = part.strip().partition(" ")
        way = way.strip() or "asc"
        if way not in ("asc", "desc"):
            raise SearchError(f"sort direction {way}")
        if name == "score":
            keys.append(F.desc("score") if way == "desc" else F.asc("score"))
            continue
        f = schema.field(name)
        if available is not None and name not in available:
            raise SearchError(f"cannot sort by {name}: the documents have no such field")
        c = F.get(F.col(name), F.lit(0)) if f.many else F.col(name)
        last = f.kind in ("string", "boolean") or f.text
        keys.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last() if last else c.asc_nulls_first())
    return [*keys, F.asc("id")]
