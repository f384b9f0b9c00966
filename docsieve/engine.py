"""The search engine: a request in, lazy DataFrames out."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docsieve import schema
from docsieve.errors import SearchError
from docsieve.functions import highlight, present
from docsieve.parser import Bool, Leaf, parse
from docsieve.plans import terms
from docsieve.plans.boost import boost_function
from docsieve.plans.compile import Compiled, frequency, order, predicate, tokens
from docsieve.request import ALL, SearchRequest, rewrite


@dataclass
class SearchResult:
    """Lazy parts of an answer; nothing runs before an action on one of them."""

    request: SearchRequest
    matches: DataFrame
    docs: DataFrame
    facets: DataFrame
    stats: DataFrame
    groups: DataFrame | None = None
    highlighting: DataFrame | None = None
    debug: dict = field(default_factory=dict)
    ranked: DataFrame | None = None
    cards: DataFrame | None = None

    def to_dict(self) -> dict:
        """The answer as the JSON interface gives it: one page, so small. What all parts read is computed once and kept
        (on disk where memory is short) until the answer is whole."""
        if self.ranked is None:
            return self._answer()
        self.ranked.persist()
        try:
            return self._answer()
        finally:
            self.ranked.unpersist()

    def _answer(self) -> dict:
        r, found = self.request, self.stats.first()
        pages = math.ceil(found.num_found / r.rows) if r.rows else 1
        unwrap = lambda v: v[0] if isinstance(v, list) and len(v) == 1 else v
        docs = [{k: unwrap(v) for k, v in x.asDict(recursive=True).items()} for x in self.docs.collect()] if self.groups is None else []
        debug = self.debug | ({"explain": {d["id"]: d.pop("explain") for d in docs}} if docs and "explain" in docs[0] else {})
        if docs and "explanation" in docs[0]:
            debug["explanation"] = {d["id"]: explained(d.pop("explanation")) for d in docs}
        facets: dict[str, list] = {}
        for x in self.facets.collect():
            facets.setdefault(x.facet, []).append((x.value, x.n))
        marks: dict[str, dict] = {}
        for x in self.highlighting.collect() if self.highlighting is not None else ():
            marks.setdefault(x.id, {})[x.field] = x.snippets
        groups = [x.asDict(recursive=True) for x in self.groups.collect()] if self.groups is not None else []
        return {
            "docs": docs, "groups": groups, "grouped": self.groups is not None, "num_found": found.num_found, "total_pages": pages, "page": r.page, "rows": r.rows, "start": r.start,
            "facets": facets, "highlighting": marks, "debug": debug, "error": None, "q": rewrite(r), "params": r.__dict__,
        }


def explained(tree: str) -> dict:
    """An explanation and its parts from their JSON."""
    node = json.loads(tree)
    return node | {"parts": [explained(p) for p in node["parts"]]}


def empty_answer(error: str | None) -> dict:
    return {"docs": [], "groups": [], "grouped": False, "num_found": 0, "facets": {}, "highlighting": {}, "debug": {}, "error": error}


def predicate_of(node: Leaf | Bool, available: set[str] | None = None) -> Column:
    """A filter expression: no scores, no statistics. ``available``: fields that the documents have."""
    if isinstance(node, Leaf):
        if node.kind == "all":
            return F.lit(True)
        if node.field is None:
            raise SearchError("a filter clause needs a field")
        f = schema.field(node.field)
        if available is not None and node.field not in available:
            raise SearchError(f"cannot filter by {node.field}: the documents have no such field")
        if f.text and node.kind not in ("exists",):
            found = frequency(node, node.field, tokens(node.field))
            return F.lit(False) if found is None else found > 0
        return predicate(Leaf("term" if node.kind == "phrase" else node.kind, node.text, node.field, node.slop, node.low, node.high, node.closed))
    must = [predicate_of(p, available) for o, p in node.parts if o == "must"]
    should = [predicate_of(p, available) for o, p in node.parts if o == "should"]
    never = [~predicate_of(p, available) for o, p in node.parts if o == "not"]
    both = must + never + ([reduce(lambda a, b: a | b, should)] if should and not must else [])
    return reduce(lambda a, b: a & b, both, F.lit(True))


def day(name: str, text: str, time: str) -> Column:
    try:
        return F.lit(dt.datetime.fromisoformat(f"{dt.date.fromisoformat(text)} {time}")).cast("timestamp_ntz")
    except ValueError:
        raise SearchError(f"{name} must be a date: {text}") from None


def filters(request: SearchRequest, available: set[str] | None = None) -> dict[str, Column]:
    """The filters of a request by tag; values are literals, a missing date is no bound."""
    out = {}
    asked = {"language": request.lang, "repository": request.repository, "file_type": request.file_type, "last_modified": request.date_from or request.date_to}
    for name, value in asked.items():
        if value and available is not None and name not in available:
            raise SearchError(f"cannot filter by {name}: the documents have no such field")
    if request.lang:
        out["language"] = F.col("language") == request.lang
    for name in ("repository", "file_type"):
        if values := getattr(request, name):
            out[name] = F.col(name).isin(*values)
    if request.date_from:
        out["from"] = F.col("last_modified") >= day("date_from", request.date_from, "00:00:00")
    if request.date_to:
        out["to"] = F.col("last_modified") <= day("date_to", request.date_to, "23:59:59")
    if request.fq:
        # A tag that the user types lets the facet of that name ignore the filter.
        tag, own = re.match(r"\s*(?:\{!tag=(\w+)\})?", request.fq)[1] or "fq", predicate_of(parse(request.fq), available)
        out[tag] = out[tag] & own if tag in out else own
    return out


def whole_query(request: SearchRequest, node: Bool) -> str | None:
    """The query as one value, where it is several plain words: a field that is not analysed may hold just that."""
    plain = all(isinstance(p, Leaf) and o != "not" and p == Leaf("term", p.text) for o, p in node.parts)
    return request.q.strip() if plain and len(node.parts) > 1 and request.parser != "lucene" and rewrite(request) == request.q else None


class SearchEngine:
    """Searches a DataFrame whose columns are registry fields; fields it lacks are not searched.

    Scan mode: one pass gives each document its term frequencies and lengths (no text); a repartition is the barrier that
    lets the statistics and the scores share that pass; statistics come back as one broadcast row. Filters are flags there,
    since statistics are corpus-wide; where a query has no statistics they are plain predicates that reach the scan.

    ``partitions``: tasks for the analysis. A collection of fewer files than that is dealt out first, so that one small
    file is not analysed by one task; larger ones are read as they are split."""

    def __init__(self, docs: DataFrame, facets: tuple[str, ...] = schema.FACETS, partitions: int | None = None):
        self.docs, self.partitions = docs, partitions
        #: Fewer partitions than tasks: files say too little, since one large file is split.
        self.few = partitions is not None and 0 < len(docs.inputFiles()) and docs.rdd.getNumPartitions() < partitions
        self.facet_fields = tuple(f for f in facets if f in docs.columns)
        for name in docs.columns:
            schema.field(name)

    def ping(self) -> bool:
        """Whether the collection can be read; an empty one can."""
        try:
            self.docs.limit(1).isEmpty()
        except Exception:
            return False
        return True

    def answer(self, args: Mapping) -> dict:
        """The answer to URL arguments; without any, the first page of all documents. A request that cannot be answered gives
        the same structure, empty, with the reason in ``error``."""
        try:
            return self.search(SearchRequest.from_args(args)).to_dict()
        except (ValueError, PySparkException) as error:
            return empty_answer(str(error))

    def browse(self, args: Mapping) -> dict:
        """As ``answer``, but a request that asks for nothing runs nothing, as on a start page."""
        try:
            idle = not SearchRequest.from_args(args).active
        except ValueError as error:
            return empty_answer(str(error))
        return empty_answer(None) if idle else self.answer(args)

    def vocabulary(self, name: str) -> DataFrame:
        """The distinct terms of an analysed field: a pass over its texts."""
        source = self.docs.repartition(self.partitions) if self.few else self.docs
        return source.select(F.explode_outer(F.array_distinct(F.transform(tokens(name), lambda t: t["term"]))).alias("term")).filter("term is not null").distinct()

    def named(self, node: Leaf | Bool, weights: dict[str, float], available: set[str]) -> dict[tuple[Leaf, str], terms.Terms | None]:
        """The terms that fuzzy, wildcard, regex and range clauses name, each distinct term tested once. This runs when a
        request is planned."""
        asked: dict[str, list[Leaf]] = {}
        for leaf, name in terms.tested(node, [n for n in weights if n in available]):
            if name in available and leaf not in asked.setdefault(name, []):
                asked[name].append(leaf)
        return {(leaf, name): some for name, leaves in asked.items() for leaf, some in zip(leaves, terms.resolve(self.vocabulary(name), leaves), strict=True)}

    def compiled(self, request: SearchRequest, available: set[str]) -> Compiled:
        weights = {"edismax": schema.WEIGHTS, "dismax": schema.DISMAX_WEIGHTS, "lucene": {"content": 1.0}}[request.parser]
        mm = (request.mm or "1") if request.parser == "edismax" and request.op == "OR" else None
        node = self.parse(request)
        return Compiled(node, weights, available, mm, whole_query(request, node), self.named(node, weights, available), request.debug)

    def parse(self, request: SearchRequest) -> Bool:
        return parse(rewrite(request), request.op)

    def ranked(self, request: SearchRequest, push: bool = False) -> DataFrame:
        """Every matching document: id, score, a flag for each filter, and the columns that facets, groups and sorts read.

        With ``push``, and where the query needs no statistics, filters are applied to the documents instead of flagged."""
        q = self.compiled(request, set(self.docs.columns))
        kept, source = filters(request, set(self.docs.columns)), self.docs
        if push and not q.row:
            source, kept = reduce(lambda d, c: d.filter(c), kept.values(), source), {}
        names = self.read(request)
        narrow = {"id": F.col("id")} | {n: F.col(n) for n in sorted(names - {"id"})}
        narrow |= {f"__k_{k}": F.coalesce(c, F.lit(False)) for k, c in kept.items()}
        if request.bf and request.parser != "lucene":
            narrow["__bf"] = boost_function(request.bf, set(self.docs.columns))
        if q.toks and self.few:
            source = source.repartition(self.partitions)
        base = source.withColumns({f"__t_{n}": c for n, c in q.toks.items()}) if q.toks else source
        rows = base.withColumns(q.row) if q.row else base
        rows = rows.select(*(c.alias(n) for n, c in narrow.items()), *q.row)
        if q.row:
            rows = rows.repartition(self.partitions) if self.partitions else rows.repartition("id")
            stats = rows.agg(*(c.alias(n) for n, c in q.stats.items()))
            rows = rows.crossJoin(F.broadcast(stats))  # one row
        explain = {}
        if request.debug and q.shares:
            entries = [x for name, share in q.shares.items() for x in (F.lit(name), share)]
            explain["__explain"] = F.map_filter(F.create_map(*entries), lambda k, v: v > 0)
            explain["__tree"] = q.explanation(F.col("__bf") if "__bf" in narrow else F.lit(0.0))
        score = F.when(q.match, q.score + (F.col("__bf") if "__bf" in narrow else F.lit(0.0)))
        return rows.withColumn("score", score).filter("score is not null").select(*narrow, "score", *(c.alias(n) for n, c in explain.items()))

    def read(self, request: SearchRequest) -> set[str]:
        """The fields that facets, groups and sorts read, all checked to be there."""
        order(request.sort, set(self.docs.columns))
        if request.group_by and schema.field(request.group_by).name not in self.docs.columns:
            raise SearchError(f"cannot group by {request.group_by}: the documents have no such field")
        return {*self.facet_fields, *([request.group_by] if request.group_by else [])} | {p.strip().split(" ")[0] for p in request.sort.split(",")} - {"score"}

    def scored(self, request: SearchRequest) -> bool:
        """Whether the query reads corpus statistics: all do but the one for all documents."""
        return rewrite(request) != ALL

    def search(self, request: SearchRequest) -> SearchResult:
        ranked = self.ranked(request)
        flags = [c for c in ranked.columns if c.startswith("__k_")]
        whole = reduce(lambda a, b: a & b, map(F.col, flags), F.lit(True))
        hits = ranked.filter(whole).drop(*flags) if self.scored(request) else self.ranked(request, push=True)
        groups = None
        if request.group_by:
            if schema.field(request.group_by).many:
                raise SearchError(f"cannot group by {request.group_by}: it has several values")
            groups = self._groups(request, hits)
            stats = hits.agg(F.count(F.lit(1)).alias("matches"), (F.countDistinct(request.group_by) + F.max(F.col(request.group_by).isNull().cast("int"))).alias("num_found"))
            stats = stats.select(F.coalesce(F.nullif("num_found", F.lit(0)), "matches").alias("num_found"), "matches")
        else:
            stats = hits.agg(F.count(F.lit(1)).alias("num_found"))
        page = hits.orderBy(*order(request.sort)).offset(request.start).limit(request.rows).select("id", "score", *(c for c in hits.columns if c in ("__explain", "__tree")))
        # The wide columns are fetched for the page alone.
        docs = self.fetch(page).orderBy(*order(request.sort)).withColumnsRenamed({"__explain": "explain", "__tree": "explanation"})
        # In a grouped answer the documents shown are those of the groups.
        shown = docs if groups is None else self.fetch(groups.select(F.col("key").cast("string").alias("__group"), F.explode("docs.id").alias("id")))
        marks = self._highlight(request, shown) if request.hl and request.q else None
        debug = {"parsedquery": repr(self.parse(request)), "q": rewrite(request), "plan": hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")} if request.debug else {}
        return SearchResult(request, hits, docs, self.facets(request, ranked), stats, groups, marks, debug, ranked if self.scored(request) else None, self._cards(request, shown, marks))

    def fetch(self, page: DataFrame) -> DataFrame:
        """The documents that a page names, with what the page says of them."""
        return self.docs.join(F.broadcast(page), "id")

    def facets(self, request: SearchRequest, ranked: DataFrame | None = None) -> DataFrame:
        """(facet, value, n) by count, then value; each facet ignores the filter of its own tag. One pass for all."""
        ranked = self.ranked(request) if ranked is None else ranked
        if not self.facet_fields:
            return ranked.select(F.lit("").alias("facet"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).limit(0)
        flags = [c for c in ranked.columns if c.startswith("__k_")]
        entries = []
        for name in self.facet_fields:
            others = reduce(lambda a, b: a & b, (F.col(c) for c in flags if c != f"__k_{name}"), F.lit(True))
            entries.append(F.when(others & F.col(name).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
        exploded = ranked.select(F.explode(F.array(*entries)).alias("e")).filter("e is not null")
        counted = exploded.groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))
        best = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
        return counted.withColumn("rank", best).filter(F.col("rank") <= schema.FACET_LIMIT).drop("rank").orderBy("facet", F.desc("n"), "value")

    def _groups(self, request: SearchRequest, hits: DataFrame) -> DataFrame:
        """Pages of groups in the order of their best document; each with its count and ten best documents."""
        key = request.group_by
        ordered = order(request.sort)
        top = W.partitionBy(key).orderBy(F.desc("score"), "id")
        # Counts first, by partial aggregation; the window keeps ten rows a group before it shuffles.
        counts = hits.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
        best = hits.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*ordered))).filter("__r = 1")
        page = best.orderBy(*ordered).offset(request.start).limit(request.rows).select(F.col(key), F.monotonically_increasing_id().alias("__place"))
        docs = hits.withColumn("__r", F.row_number().over(top)).filter(F.col("__r") <= schema.GROUP_LIMIT)
        listed = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("__r").alias("rank"), "id", "score"))).alias("docs"))
        page, counts, listed = page.withColumnRenamed(key, "key"), counts.withColumnRenamed(key, "key"), listed.withColumnRenamed(key, "key")
        joined = page.join(counts, page.key.eqNullSafe(counts.key)).drop(counts.key).join(listed, page.key.eqNullSafe(listed.key)).drop(listed.key)
        return joined.orderBy("__place").select("key", "count", F.greatest(F.col("count") - schema.GROUP_LIMIT, F.lit(0)).alias("overflow"), "docs")

    def _highlight(self, request: SearchRequest, docs: DataFrame) -> DataFrame:
        return highlight.highlight(docs, self.parse(request), [n for n in schema.HIGHLIGHTED if n in self.docs.columns])

    def _cards(self, request: SearchRequest, docs: DataFrame, marks: DataFrame | None) -> DataFrame:
        """What a result list shows of each document of the page: title, link, snippets and their source, author and date."""
        grouped = "__group" in docs.columns
        if marks is not None:
            found = marks.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "snippets"))).alias("__marks"))
            docs = docs.join(F.broadcast(found), "id", "left")
        else:
            docs = docs.withColumn("__marks", F.lit(None).cast("map<string,array<string>>"))
        mark = lambda name: F.col("__marks").getItem(name)
        col = lambda name: F.col(name) if name in self.docs.columns else F.lit(None).cast(schema.field(name).type)
        path, href = col("file_path"), present.repository_href(col("url"), col("repository_path"), col("file_path"))
        group = F.col("__group") if grouped else F.lit(None).cast("string")
        return docs.select(
            "id", group.alias("group"), present.display_title(F.get(mark("title"), F.lit(0)), col("title"), path, F.col("id")).alias("title"), present.action_href(path, group, href).alias("href"),
            F.coalesce(
                present.preferred_snippets(mark("source_code_content"), mark("content"), mark("image_orc_text"), grouped),
                F.array(present.escaped(present.fallback_snippet(col("source_code_content"), col("image_orc_text"), col("content"), 200 if grouped else 300))),
            ).alias("snippets"),
            present.snippet_label(mark("source_code_content"), mark("image_orc_text")).alias("source"),
            (F.lit("") if grouped else present.meta_line(col("author"), col("last_modified"))).alias("meta"),
        )
