"""An inverted index as tables, whole requests answered from them, and segments that batches of documents add.

Tables, each of a column ``segment``:

- ``postings``: field, term, id, tf, positions; ranged by field, term and id, so that few row groups hold a term and no task
  all postings of a frequent one;
- ``documents``: the values that are not analysed, the number of positions of each analysed field (``__d_``), and whether it
  is there (``__e_``);
- ``stored``: the documents as they came, in folders by a hash of the id, so that a page's documents are read from few;
- ``vocabulary``: field, term, and in how many documents how often; ``statistics``: documents and positions of each field;
- ``neighbours``: each term under what is left of its beginning after up to two deletions; terms within two edits share such
  a form, so fuzzy words are found by equality; ``grams``: each term under its three-character pieces, its ends marked.

A query reads the postings of its terms alone. Scores are those of the scan mode, from the same expressions. A batch of
documents becomes a segment of its own that is never changed; what it supersedes in older segments is listed in ``masks`` and
taken off by an anti join, and off the statistics by negative rows. Segments count once the manifest names them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.engine import SearchEngine, filters, whole_query
from docsieve.functions import analysis
from docsieve.parser import Bool, Leaf, parse
from docsieve.plans import terms
from docsieve.plans.boost import boost_function
from docsieve.plans.compile import Compiled, any_of, predicate, tokens
from docsieve.request import SearchRequest
from docsieve.sources.manifest import publish, published
from docsieve.sources.store import index_postings, upsert_latest

TOKENS = "array<struct<term:string,pos:int>>"
TABLES, LOOKUPS = ("postings", "documents", "stored", "vocabulary", "statistics"), ("neighbours", "grams")
#: Characters at the beginning of a term that deletions are tried in, and deletions.
BEGINNING, DELETIONS = 10, 2
GRAM = 3
#: Folders of stored documents.
BUCKETS = 64


def deletions(term: Column) -> Column:
    """What is left of a term's beginning after up to DELETIONS deletions."""
    without = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    found = [F.array(F.substring(term, 1, BEGINNING))]
    for _ in range(DELETIONS):
        found.append(F.array_distinct(F.flatten(F.transform(found[-1], without))))
    return F.array_distinct(F.concat(*found))


def word_deletions(word: str, edits: int) -> set[str]:
    left = {word[:BEGINNING]}
    for _ in range(edits):
        left |= {w[:k] + w[k + 1 :] for w in left for k in range(len(w))}
    return left


def grams(term: Column) -> Column:
    whole = F.concat(F.lit("\x02"), term, F.lit("\x03"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term)), lambda k: F.substring(whole, k, F.lit(GRAM))))


def text_grams(runs: list[str]) -> list[str]:
    return sorted({r[k : k + GRAM] for r in runs for k in range(len(r) - GRAM + 1)})


def literals(leaf: Leaf) -> tuple[str, list[str]]:
    """What every term that a wildcard or expression matches begins with, and stretches that it holds, its ends marked."""
    if leaf.kind == "wildcard":
        parts = [re.sub(r"\\(.)", r"\1", p) for p in re.split(r"(?<!\\)[*?]", leaf.text.lower())]
        return parts[0], ["\x02" + parts[0], *parts[1:-1], parts[-1] + "\x03"] if len(parts) > 1 else ["\x02" + parts[0] + "\x03"]
    if re.search(r"[|()\\]", leaf.text):
        return "", []
    # Brackets and whatever may be missing or repeated break a stretch.
    parts = re.split(r"\[[^\]]*\][*?+]?(?:\{[^}]*\})?|.(?:[*?]|\{[^}]*\})|[.^$+]", leaf.text)
    whole = re.match(r"[^\[\].^$+*?{]*", leaf.text)[0]
    begin = whole if len(whole) == len(leaf.text) or leaf.text[len(whole)] not in "*?{" else whole[:-1]
    return begin, [p for p in parts if not re.search(r"[\]{}*?]", p)]


def after(prefix: str) -> str | None:
    """The first text behind all that begin with ``prefix``, in the order of code points."""
    for k in range(len(prefix) - 1, -1, -1):
        if ord(prefix[k]) < 0x10FFFF:
            code = ord(prefix[k]) + 1
            return prefix[:k] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def ordered(table: str, df: DataFrame) -> DataFrame:
    """A table dealt and sorted as it is written."""
    if table == "stored":
        return df.withColumn("__bucket", bucket(F.col("id"))).repartition("__bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(16))).sortWithinPartitions("__bucket", "id")
    keys = {"postings": ("field", "term", "id"), "vocabulary": ("field", "term"), "neighbours": ("field", "variant", "term"), "grams": ("field", "gram", "term")}.get(table)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


class InvertedIndex:
    """The tables of an index, of live documents alone."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables
        self.postings, self.documents, self.stored = (tables[t] for t in TABLES[:3])
        self.fields = tuple(c.removeprefix("__d_") for c in self.documents.columns if c.startswith("__d_"))

    @classmethod
    def build(cls, docs: DataFrame) -> InvertedIndex:
        """The tables of ``docs``, whose columns are registry fields and whose ids differ."""
        text = [c for c in docs.columns if schema.field(c).text]
        sizes = [F.size(F.array_distinct(F.transform(tokens(c), lambda t: t["pos"]))).alias(f"__d_{c}") for c in text]
        there = [F.col(c).isNotNull().alias(f"__e_{c}") for c in text]
        documents = docs.select(*(c for c in docs.columns if c not in text), *sizes, *there)
        postings = reduce(DataFrame.unionByName, [index_postings(docs, c) for c in text]) if text else docs.sparkSession.createDataFrame([], "field string, term string, id string, tf int, positions array<int>")
        vocabulary = counted_terms(postings)
        return cls(postings=postings, documents=documents, stored=docs, vocabulary=vocabulary, statistics=statistics(documents), **lookups(vocabulary))

    def write(self, path: str, segment: int = 0, lookup: tuple[str, ...] = LOOKUPS) -> None:
        """Add the tables to the index at ``path`` as a segment that no query sees yet. Tables that sum up or rearrange others are
        made from what has been written of those, so texts are analysed once for postings and once for lengths. Without a
        ``lookup`` table the clauses it serves are tested on the whole vocabulary."""
        spark, written = self.stored.sparkSession, {}
        made = {
            "postings": lambda: self.postings, "documents": lambda: self.documents, "stored": lambda: self.stored, "vocabulary": lambda: counted_terms(written["postings"]),
            "statistics": lambda: statistics(written["documents"]), "neighbours": lambda: lookups(written["vocabulary"])["neighbours"], "grams": lambda: lookups(written["vocabulary"])["grams"],
        }
        for table in (*TABLES, *lookup):
            parts = {"postings": ["field"], "stored": ["__bucket"]}.get(table, [])
            ordered(table, made[table]()).write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{table}/segment={segment}")
            written[table] = spark.read.parquet(f"{path}/{table}/segment={segment}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> InvertedIndex:
        """The live documents of the index at ``path``: all segments of its manifest, without what later ones supersede. An index
        that was written without a manifest has one segment."""
        live = [r.name for r in published(spark, path)] or ["0"]
        some = F.col("segment").isin(*map(int, live))
        tables = {t: spark.read.parquet(f"{path}/{t}").filter(some) for t in TABLES}
        for t in LOOKUPS:
            try:
                tables[t] = spark.read.parquet(f"{path}/{t}").filter(some)
            except AnalysisException as error:  # an index may do without them
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        if len(live) > 1:
            masks = spark.read.parquet(f"{path}/masks").filter(F.col("by").isin(*map(int, live))).select("segment", "id")
            for t in ("postings", "documents", "stored"):
                tables[t] = tables[t].join(masks, ["segment", "id"], "left_anti")
        return cls(**{t: df.drop("segment") for t, df in tables.items()})

    def engine(self, **more) -> IndexEngine:
        return IndexEngine(self, **more)

    def ranked(self, request: SearchRequest) -> DataFrame:
        """id and score of every matching document, before filters."""
        from dataclasses import replace

        bare = replace(request, lang="", repository=(), file_type=(), date_from="", date_to="", fq="", sort="score desc", group_by="")
        return IndexEngine(self, facets=()).ranked(bare).select("id", "score")


def statistics(documents: DataFrame) -> DataFrame:
    """A row for each analysed field: its positions in all documents; one of field "" with the number of documents."""
    sizes = [c for c in documents.columns if c.startswith("__d_")]
    one = documents.agg(F.count("id").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes))
    rows = [F.struct(F.lit(c.removeprefix("__d_")).alias("field"), F.col(c).cast("long").alias("total")) for c in sizes]
    return one.select(F.inline(F.array(F.struct(F.lit("").alias("field"), F.col("n").alias("total")), *rows)))


def counted_terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def lookups(vocabulary: DataFrame) -> dict[str, DataFrame]:
    words = vocabulary.select("field", "term").distinct()
    return {
        "neighbours": words.select("field", F.explode(deletions(F.col("term"))).alias("variant"), "term"),
        "grams": words.select("field", F.explode(grams(F.col("term"))).alias("gram"), "term"),
    }


def commit(docs: DataFrame, path: str, lookup: tuple[str, ...] = LOOKUPS) -> int:
    """Add a batch of documents to the index at ``path`` as a new segment and publish it; the number of the segment. ``lookup`` is
    the same for all batches of an index, see ``InvertedIndex.write``.

    Of rows of one id in the batch the one of the highest ``_version_`` counts, of equal versions the last one. Documents of
    that id in older segments are superseded."""
    spark = docs.sparkSession
    old = published(spark, path)
    segment = max((int(r.name) for r in old), default=-1) + 1
    batch = docs.withColumn("__row", F.monotonically_increasing_id())
    version = F.coalesce(F.col("_version_"), F.lit(0)) if "_version_" in docs.columns else F.lit(0)
    batch = upsert_latest(batch.withColumn("__order", F.struct(version.alias("v"), F.col("__row").alias("r"))), "id", "__order").drop("__row", "__order")
    InvertedIndex.build(batch).write(path, segment, lookup)
    if old:
        live = F.col("segment").isin(*(int(r.name) for r in old))
        before = {t: spark.read.parquet(f"{path}/{t}").filter(live) for t in ("postings", "documents")}
        masks = spark.read.parquet(f"{path}/masks").filter(F.col("by").isin(*(int(r.name) for r in old))).select("segment", "id") if len(old) > 1 else None
        if masks is not None:
            before = {t: df.join(masks, ["segment", "id"], "left_anti") for t, df in before.items()}
        again = spark.read.parquet(f"{path}/documents/segment={segment}").select("id")
        gone = before["documents"].select("segment", "id").join(again, "id", "left_semi")
        gone.select(F.col("segment").cast("int").alias("segment"), "id").write.mode("overwrite").parquet(f"{path}/masks/by={segment}")
        gone = spark.read.parquet(f"{path}/masks/by={segment}")
        # What is superseded is taken off: negative rows, added to the segment's own.
        lost = before["postings"].join(gone, ["segment", "id"], "left_semi").groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf"))
        lost.select("field", "term", "df", "cf").write.mode("append").parquet(f"{path}/vocabulary/segment={segment}")
        less = statistics(before["documents"].join(gone, ["segment", "id"], "left_semi")).select("field", (-F.col("total")).alias("total"))
        less.write.mode("append").parquet(f"{path}/statistics/segment={segment}")
    publish(spark, path, [*((r.name, r.source, r.number) for r in old), (str(segment), "batch", segment)], old)
    return segment


def merge(spark: SparkSession, path: str) -> int:
    """Replace all segments by one of the same documents, with the same lookups; the number of the new segment."""
    index, old = InvertedIndex.read(spark, path), published(spark, path)
    segment = max(int(r.name) for r in old) + 1
    InvertedIndex(**(index.tables | {"stored": index.stored.drop("__bucket")})).write(path, segment, tuple(t for t in LOOKUPS if t in index.tables))
    publish(spark, path, [(str(segment), "merge", segment)], old)
    return segment


class IndexEngine(SearchEngine):
    """Answers whole requests from an index: matches and scores from postings, filters, facets, groups and sorts from the values
    of ``documents``, and pages from ``stored``."""

    def __init__(self, index: InvertedIndex, facets: tuple[str, ...] = schema.FACETS):
        self.index = index
        super().__init__(index.stored.drop("__bucket"), facets)

    def fetch(self, page: DataFrame) -> DataFrame:
        """Only the folders of the page's documents are read."""
        if "__bucket" not in self.index.stored.columns:
            return super().fetch(page)
        return self.index.stored.join(F.broadcast(page.withColumn("__bucket", bucket(F.col("id")))), ["__bucket", "id"]).drop("__bucket")

    def vocabulary(self, name: str) -> DataFrame:
        return self.index.tables["vocabulary"].filter(F.col("field") == name).select("term").distinct()

    def candidates(self, leaf: Leaf, name: str) -> DataFrame:
        """Terms of a field, all that the clause names among them: by equality of deletions, by a range of terms, by grams."""
        mine = lambda table: self.index.tables[table].filter(F.col("field") == name)
        words = mine("vocabulary")
        if leaf.kind == "fuzzy" and "neighbours" in self.index.tables:
            return mine("neighbours").filter(F.col("variant").isin(*sorted(word_deletions(leaf.text.lower(), leaf.slop)))).select("term").distinct()
        if leaf.kind == "range":
            low, high = leaf.low, leaf.high
            words = words if low is None else words.filter(F.col("term") >= low)
            return (words if high is None else words.filter(F.col("term") <= high)).select("term").distinct()
        prefix, runs = literals(leaf) if leaf.kind != "fuzzy" else ("", [])
        if prefix:
            words = words.filter(F.col("term") >= prefix)
            return (words.filter(F.col("term") < after(prefix)) if after(prefix) else words).select("term").distinct()
        pieces = text_grams(runs)
        if pieces and "grams" in self.index.tables:
            found = mine("grams").filter(F.col("gram").isin(*pieces)).select("term", "gram").distinct()
            return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(pieces)).select("term")
        return self.vocabulary(name)

    def named(self, node: Leaf | Bool, weights: dict[str, float], available: set[str]) -> dict[tuple[Leaf, str], terms.Terms | None]:
        asked = dict.fromkeys((leaf, name) for leaf, name in terms.tested(node, [n for n in weights if n in available]) if name in available)
        return {(leaf, name): terms.resolve(self.candidates(leaf, name), [leaf])[0] for leaf, name in asked}

    def found(self, query: Compiled) -> DataFrame:
        """id and, for each analysed field, the tokens of the document that some clause of the query names."""
        parts = []
        for name, picks in query.picks.items():
            mine = self.index.postings.filter(F.col("field") == name)
            exact = sorted({w for words, _ in picks for w in words})
            tests = [test(F.col("term")) for _, test in picks if test is not None]
            chosen = mine.filter(F.col("term").isin(*exact))
            if tests:  # more terms than are named one by one: each distinct term is tested once
                close = self.vocabulary(name).filter(any_of(tests) & ~F.col("term").isin(*exact))
                chosen = chosen.unionByName(mine.join(close, "term", "left_semi").select(*mine.columns))
            parts.append(chosen.select("id", F.lit(name).alias("field"), "term", F.explode("positions").alias("pos")))
        rows = reduce(DataFrame.unionByName, parts)
        one = lambda n: F.sort_array(F.collect_list(F.when(F.col("field") == n, F.struct("pos", "term"))))
        whole = rows.groupBy("id").agg(*(one(n).alias(n) for n in query.picks))
        return whole.select("id", *(F.transform(n, lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"))).cast(TOKENS).alias(f"__t_{n}") for n in query.picks))

    def split(self, node: Bool, weights: dict[str, float]) -> tuple[Bool, list[Leaf]]:
        """The query without its plain negated words, and those, which are taken off by an anti join."""
        plain = [p for o, p in node.parts if o == "not" and isinstance(p, Leaf) and p.kind == "term" and all(self.one_place(p, n) for n in ([p.field] if p.field else weights))]
        if not any(o != "not" for o, _ in node.parts):
            return node, []
        return Bool(tuple((o, p) for o, p in node.parts if not (o == "not" and p in plain)), node.boost, node.constant), plain

    def one_place(self, leaf: Leaf, name: str) -> bool:
        f = schema.field(name)
        pieces = analysis.query_pieces(f.kind, leaf.text) if f.text else []
        return len(pieces) < 2 and all(len(p.ways) == 1 and len(p.ways[0]) == 1 for p in pieces)

    def without(self, rows: DataFrame, leaf: Leaf, weights: dict[str, float]) -> DataFrame:
        """``rows`` whose document does not hold the word in any field that it is asked of."""
        if leaf.field is None and not analysis.query_tokens("general", leaf.text):
            return rows  # a stop word asks for nothing
        for name in [leaf.field] if leaf.field else weights:
            if name not in self.docs.columns:
                continue
            if schema.field(name).text:
                words = [w for p in analysis.query_pieces(schema.field(name).kind, leaf.text) for g in p.ways[0] for w in g]
                rows = rows.join(self.index.postings.filter((F.col("field") == name) & F.col("term").isin(*words)).select("id"), "id", "left_anti")
            else:
                held = self.index.documents.filter(predicate(Leaf("term", leaf.text, name))).select("id")
                rows = rows.join(held, "id", "left_anti")
        return rows

    def rows(self, q: Compiled, docs: DataFrame) -> DataFrame:
        """The columns of ``q.row`` for the documents that may match; what is counted over all documents comes from ``counts``."""
        there = [F.when(F.col(f"__e_{n}"), F.lit("")).alias(n) for n in self.index.fields]
        docs = docs.select("*", *there)
        values = {k: c for k, c in q.row.items() if k not in q.from_tokens}
        if q.picks:
            docs = docs.join(self.counted(q), "id", "inner" if q.text_only else "left")
        found = [k for k in q.from_tokens if not k.startswith("__d_")]
        zero = lambda k: F.coalesce(F.col(k), F.lit(False) if k.startswith("__g_") else F.lit(0.0))
        return docs.withColumns({k: zero(k) for k in found} | values) if found or values else docs

    def counted(self, q: Compiled) -> DataFrame:
        """id and frequencies of the documents that hold a term of the query."""
        return self.found(q).select("id", *(c.alias(k) for k, c in q.row.items() if k in q.from_tokens and not k.startswith("__d_")))

    def stats(self, q: Compiled) -> DataFrame:
        """The one row of statistics: totals from the statistics of the segments, frequencies from postings and values."""
        totals = self.index.tables["statistics"].groupBy("field").agg(F.sum("total").alias("total"))
        n = F.max(F.when(F.col("field") == "", F.col("total")))
        lengths = [k.removeprefix("__a_") for k in q.stats if k.startswith("__a_")]
        one = totals.agg(n.alias("__n"), *((F.max(F.when(F.col("field") == x, F.col("total"))) / n).alias(f"__a_{x}") for x in lengths))
        counts = {k: c for k, c in q.stats.items() if k.startswith("__c_")}
        base = lambda k: k.replace("__c_", "__g_" if k.count("_") > 3 else "__f_")
        words = {k: c for k, c in counts.items() if base(k) in q.from_tokens}
        if words:
            one = one.crossJoin(self.counted(q).agg(*(F.coalesce(c, F.lit(0)).alias(k) for k, c in words.items())))
        if rest := {k: c for k, c in counts.items() if k not in words}:
            there = [F.when(F.col(f"__e_{n}"), F.lit("")).alias(n) for n in self.index.fields]
            values = self.index.documents.select("*", *there).select(*(q.row[base(k)].alias(base(k)) for k in rest))
            one = one.crossJoin(values.agg(*(F.coalesce(c, F.lit(0)).alias(k) for k, c in rest.items())))
        return one

    def matching(self, node: Bool) -> DataFrame:
        """The ids of the documents that a filter expression over any fields lets pass."""
        available = set(self.docs.columns)
        q = Compiled(node, {}, available, None, None, self.named(node, {}, available))
        return self.rows(q, self.index.documents).filter(q.match).select("id")

    def ranked(self, request: SearchRequest, push: bool = False) -> DataFrame:
        available = set(self.docs.columns)
        weights = {"edismax": schema.WEIGHTS, "dismax": schema.DISMAX_WEIGHTS, "lucene": {"content": 1.0}}[request.parser]
        mm = (request.mm or "1") if request.parser == "edismax" and request.op == "OR" else None
        whole = self.parse(request)
        node, banned = self.split(whole, weights)
        q = Compiled(node, weights, available, mm, whole_query(request, whole), self.named(node, weights, available), request.debug)
        names, docs, flags = self.read(request), self.index.documents, {}
        expression = parse(request.fq) if request.fq else None
        analysed = expression is not None and any(schema.field(n).text for n in fields_of(expression))
        kept = filters(request if not analysed else without_fq(request), available)
        if analysed:  # a filter on texts is a semi join with what the index finds
            tag = re.match(r"\s*(?:\{!tag=(\w+)\})?", request.fq)[1] or "fq"
            ids = self.matching(expression)
            if tag in self.facet_fields:
                docs = docs.join(ids.select("id", F.lit(True).alias("__passes")), "id", "left")
                passes = F.coalesce(F.col("__passes"), F.lit(False))
                kept[tag] = kept[tag] & passes if tag in kept else passes
            else:
                docs = docs.join(ids, "id", "left_semi")
        for tag, test in kept.items():
            # Facets ignore the filter of their own tag; all other filters go first.
            if tag in self.facet_fields and not (push and not q.row):
                flags[f"__k_{tag}"] = F.coalesce(test, F.lit(False))
            else:
                docs = docs.filter(test)
        rows = self.rows(q, docs)
        for leaf in banned:
            rows = self.without(rows, leaf, weights)
        narrow = {"id": F.col("id")} | {n: F.col(n) for n in sorted(names - {"id"})} | flags
        if request.bf and request.parser != "lucene":
            narrow["__bf"] = boost_function(request.bf, available)
        if q.row:
            rows = rows.crossJoin(F.broadcast(self.stats(q)))  # one row
        boost = narrow.get("__bf", F.lit(0.0))
        score = F.when(q.match, q.score + boost)
        if request.debug and q.row:
            narrow["__tree"] = q.explanation(boost)
        return rows.select(*(c.alias(k) for k, c in narrow.items()), score.alias("score")).filter("score is not null")


def fields_of(node: Leaf | Bool) -> set[str]:
    if isinstance(node, Leaf):
        return {node.field} if node.field and node.kind != "exists" else set()
    return {n for _, part in node.parts for n in fields_of(part)}


def without_fq(request: SearchRequest) -> SearchRequest:
    from dataclasses import replace

    return replace(request, fq="")
