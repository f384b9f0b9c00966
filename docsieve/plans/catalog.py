"""Every search query the engine registers, with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.engine import SearchEngine
from docsieve.functions import analysis, present
from docsieve.operators import IndexEngine, InvertedIndex, commit, merge
from docsieve.request import SearchRequest
from docsieve.sources import store
from docsieve.sources.store import index_postings, upsert_latest
from docsieve.streaming.ingest import stream_json

STOPS = ", ".join(f"'{w}'" for w in analysis.STOP)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.array("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("repository"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title, body = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_replace("html", r"(?s)<[^>]*>", " ")
    return p.select(F.col("page_id").cast("string").alias("id"), F.array(title).alias("title"), F.array(body).alias("content"), "url")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.array("text").alias("content"), F.col("role").alias("author"), F.col("conv_id").cast("string").alias("repository"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.array("p_name").alias("title"), F.col("p_brand").alias("repository"), F.col("p_type").alias("file_type"), F.col("p_size").alias("size_i"), F.col("p_retailprice").alias("price_d"))


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose author is a value of two words."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.array("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("author"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of code: getRedWidget12 = economy_Brand#17"""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.concat(F.lit("get"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_size"), F.lit(" = "), F.lower("p_type"), F.lit("_"), F.col("p_brand"))
    return p.select(F.col("p_partkey").cast("string").alias("id"), line.alias("source_code_content"))


def code_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(sources(spark, sf_dir)).select("id", F.inline(analysis.code(F.col("source_code_content"))))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("last_modified"), F.col("o_orderstatus").alias("repository"), F.col("o_orderpriority").alias("file_type"))


def dealt(docs: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt out, so that one small file is not analysed by one task."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 0 < len(docs.inputFiles()) < cores else docs


def engine(docs: DataFrame, **more) -> SearchEngine:
    return SearchEngine(docs, partitions=docs.sparkSession.sparkContext.defaultParallelism, **more)


def top(source, **request) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(source(spark, sf_dir)).search(SearchRequest(**request)).docs.select("id", F.round("score", 6).alias("score"))

    return run


def matches(source, **request) -> Callable[[SparkSession, str], DataFrame]:
    """All matches, not a page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(source(spark, sf_dir)).search(SearchRequest(**request)).matches.select("id", F.round("score", 6).alias("score"))

    return run


def written(docs: DataFrame, lookup: tuple[str, ...] = ()) -> IndexEngine:
    """An engine over an index of the documents that is written and read back."""
    path = store.scratch_dir(docs.sparkSession)
    InvertedIndex.build(dealt(docs)).write(path, lookup=lookup)
    return InvertedIndex.read(docs.sparkSession, path).engine()


def indexed(source, part: str = "matches", columns: tuple[str, ...] = ("id", "score"), lookup: tuple[str, ...] = (), **request) -> Callable[[SparkSession, str], DataFrame]:
    """All matches, or another part of an answer, from a written index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(written(source(spark, sf_dir), lookup).search(SearchRequest(**request)), part)
        return found.select(*(F.round("score", 6).alias("score") if c == "score" else F.get("content", F.lit(0)).alias("text") if c == "text" else c for c in columns))

    return run


def index_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(corpus(spark, sf_dir)).search(SearchRequest(q="that", group_by="repository", rows=5)).groups
    return found.select("key", "count", "overflow", F.inline("docs")).select("key", "count", "overflow", "rank", "id", F.round("score", 6).alias("score"))


def index_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in an index of three batches: all documents, every third one again with a word more, every fifth one once more
    under a new id; with the segments merged before the last batch."""
    path, docs = store.scratch_dir(spark), dealt(corpus(spark, sf_dir))
    number = F.col("id").cast("long")
    commit(docs, path, ())
    commit(docs.filter(number % 3 == 0).withColumn("content", F.array(F.concat(F.lit("that "), F.get("content", F.lit(0))))), path, ())
    merge(spark, path)
    commit(docs.filter(number % 5 == 0).withColumn("id", (number + 10_000_000).cast("string")), path, ())
    found = InvertedIndex.read(spark, path).engine().search(SearchRequest(q="that from")).matches
    return found.select("id", F.round("score", 6).alias("score"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document frequencies that an index keeps, added up over two segments."""
    path, docs = store.scratch_dir(spark), dealt(corpus(spark, sf_dir))
    commit(docs, path, ())
    commit(docs.filter(F.col("id").cast("long") % 3 == 0).withColumn("content", F.array(F.lit("that this"))), path, ())
    terms = InvertedIndex.read(spark, path).tables["vocabulary"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return terms.filter("df > 0")


def facet(source, **request) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(source(spark, sf_dir)).search(SearchRequest(**request)).facets


def groups(source, **request) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(source(spark, sf_dir)).search(SearchRequest(**request)).groups
        return found.select("key", "count", "overflow", F.inline("docs")).select("key", "count", "overflow", "rank", "id", F.round("score", 6).alias("score"))

    return run


TOKENS = f"""
words AS (
  SELECT doc_id AS id, lower(t) AS t, i FROM (
    SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}ー]+'), lambda x: x <> '') AS l FROM documents))
  WHERE lower(t) NOT IN ({STOPS})),
lens AS (SELECT doc_id AS id, lang, source, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM words GROUP BY id) w ON doc_id = w.id),
stats AS (SELECT count(*) AS n, avg(dl) AS a FROM lens)"""


def scored(tests: dict[str, str], where: str, tail: str, tf: str = "count(*)::DOUBLE") -> str:
    """BM25 over the words that pass each test; ``where`` is over m_<name> (0 or 1)."""
    ctes, joins, score = [], [], []
    for name, test in tests.items():
        ctes.append(f"tf_{name} AS (SELECT id, {tf} AS f FROM words WHERE {test} GROUP BY id), df_{name} AS (SELECT count(*) AS df FROM tf_{name} WHERE f > 0)")
        joins.append(f"LEFT JOIN tf_{name} ON tf_{name}.id = lens.id CROSS JOIN df_{name}")
        score.append(f"CASE WHEN tf_{name}.f > 0 THEN ln(1 + (n - df_{name}.df + 0.5) / (df_{name}.df + 0.5)) * tf_{name}.f / (tf_{name}.f + 1.2 * (1 - 0.75 + 0.75 * dl / a)) ELSE 0 END")
    flags = ", ".join(f"(coalesce(tf_{k}.f, 0) > 0)::INT AS m_{k}" for k in tests)
    return f"WITH {TOKENS}, {', '.join(ctes)}, found AS (SELECT lens.id, lang, source, {flags}, {' + '.join(score)} AS s FROM lens CROSS JOIN stats {' '.join(joins)}) SELECT id::VARCHAR AS id, round(s, 6) AS score FROM found WHERE {where} {tail}"


def is_(word: str) -> str:
    return f"t = '{word}'"


TOP10 = "ORDER BY s DESC, id::VARCHAR LIMIT 10"
PAIR = {"a": is_("that"), "b": is_("from")}
TRIO = {**PAIR, "c": is_("this")}
FOUR = {**TRIO, "d": is_("are")}


def phrase_sql(terms: list[str], slop: int, where: str = "") -> str:
    """Phrases by trying every choice of places: of those that a place of the first term can be part of, the one whose places,
    each less its term's offset, lie closest together. No place is chosen twice. A phrase's rarity is that of its terms together."""
    shifted = ", ".join(f"x{k}.i - {k}" for k in range(len(terms)))
    joins = "".join(f" JOIN words x{k} ON x{k}.id = x0.id AND x{k}.t = '{t}' AND x{k}.i - x0.i - {k} BETWEEN -{slop} AND {slop}" + "".join(f" AND x{k}.i <> x{j}.i" for j in range(k)) for k, t in enumerate(terms) if k)
    idf = " + ".join(f"(SELECT ln(1 + (n - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5)) FROM words, stats WHERE t = '{t}' GROUP BY n)" for t in terms)
    return f"""WITH {TOKENS}, near AS (SELECT x0.id, x0.i, min(greatest({shifted}) - least({shifted})) AS gap FROM words x0{joins} WHERE x0.t = '{terms[0]}' GROUP BY x0.id, x0.i),
tf AS (SELECT id, sum(1.0 / (1 + gap))::DOUBLE AS f FROM near WHERE gap <= {slop} GROUP BY id)
SELECT tf.id::VARCHAR AS id, round(({idf}) * f / (f + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM tf JOIN lens ON lens.id = tf.id CROSS JOIN stats {where}"""


def edits_sql(word: str) -> str:
    """How many edits a term ``t`` is from a word, a swap of neighbours being one and no place edited twice; 3 for more than two.
    Plain distance knows no swaps, so terms with one swap, two swaps, or a swap and an edit beside it are told by their parts. It
    also counts bytes, so each character that a word of plain letters cannot hold stands for one byte."""
    t = "regexp_replace(t, '[^ -~]', '#', 'g')"
    swaps = [(word[:k], word[k + 1] + word[k], word[k + 2 :]) for k in range(len(word) - 1) if word[k] != word[k + 1]]
    two = [f"'{u + pair + v[:k] + v[k + 1] + v[k] + v[k + 2 :]}'" for u, pair, v in swaps for k in range(len(v) - 1)]
    beside = [f"(starts_with({t}, '{u + pair}') AND levenshtein(({t})[{len(u) + 3}:], '{v}') <= 1) OR (suffix({t}, '{pair + v}') AND levenshtein(({t})[: length({t}) - {len(pair + v)}], '{u}') <= 1)" for u, pair, v in swaps]
    once = ", ".join(f"'{u + pair + v}'" for u, pair, v in swaps)
    return f"CASE WHEN t = '{word}' THEN 0 WHEN levenshtein({t}, '{word}') = 1 OR t IN ({once}) THEN 1 WHEN levenshtein({t}, '{word}') = 2 OR {' OR '.join(beside)} OR t IN ({', '.join(two) or 'NULL'}) THEN 2 ELSE 3 END"


def fuzzy_sql(word: str, edits: int) -> str:
    long = f"greatest(length(t), {len(word)})"
    return scored({"a": f"{edits_sql(word)} <= {edits}"}, "m_a = 1", "", f"sum(greatest(1.0 - ({edits_sql(word)}) / {long}, 1.0 / ({long} + 1)))::DOUBLE")


def analyze(chain, column: str, table: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column)).select(F.explode_outer(chain(F.col(column))).alias("t")).filter("t is not null")
        return rows.groupBy(F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("n"))

    return run


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(analysis.general(F.col("text")))
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).agg(F.count("doc_id").alias("n_docs"), F.sum(n).alias("n_words"), F.round(F.avg(n), 6).alias("mean_words"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_postings(dealt(corpus(spark, sf_dir)), "content").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return upsert_latest(e, "user_id", "event_id")


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    path = store.scratch_dir(spark)
    store.write_json(corpus(spark, sf_dir), path)
    return store.read_json(spark, path, lines=True).select("id", F.get("content", F.lit(0)).alias("text"), "language", "repository")


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from files of JSON arrays."""
    path = store.scratch_dir(spark)
    store.write_json_arrays(orders(spark, sf_dir), path)
    return store.read_json(spark, path).select("id", "last_modified", "repository", "file_type")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of JSON arrays streamed into the log, current documents read from it."""
    path = store.scratch_dir(spark)
    store.write_json_arrays(orders(spark, sf_dir), f"{path}/in")
    stream_json(spark, f"{path}/in", f"{path}/log", f"{path}/checkpoint", None).awaitTermination()
    return store.current(spark, f"{path}/log").select("id", "last_modified", "repository", "file_type")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two batches of one source, the first of them sent twice, compacted."""
    path, docs = store.scratch_dir(spark), parts(spark, sf_dir).select("id", "repository", "size_i")
    for _ in range(2):
        store.append(docs, f"{path}/log", "parts", 1)
    store.append(docs.filter(F.col("id").cast("long") % 3 == 0).withColumn("size_i", F.col("size_i") + 100), f"{path}/log", "parts", 2)
    rows = store.read_log(spark, f"{path}/log").groupBy("id").agg(F.count(F.lit(1)).alias("versions"))
    store.compact(spark, f"{path}/log", f"{path}/compact")
    return store.current(spark, f"{path}/compact").join(rows, "id").select("id", "repository", "size_i", "versions")


def restreamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files streamed from two folders and once more with a new checkpoint: rows by sequence number."""
    path = store.scratch_dir(spark)
    store.write_json_arrays(orders(spark, sf_dir), f"{path}/a")
    store.write_json_arrays(parts(spark, sf_dir).select("id", "repository", "file_type"), f"{path}/b")
    for folder, mark in (("a", "1"), ("b", "2"), ("b", "2"), ("a", "3")):
        stream_json(spark, f"{path}/{folder}", f"{path}/log", f"{path}/checkpoint{mark}", None).awaitTermination()
    return store.read_log(spark, f"{path}/log").groupBy("_version_").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_row_").alias("n_rows")).withColumnRenamed("_version_", "seq")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and positions of a field of two values."""
    p = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type"))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.inline(analysis.multi(F.array("p_name", "p_type"), analysis.general)))


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = engine(corpus(spark, sf_dir)).search(SearchRequest(q="that", group_by="repository")).matches
    return hits.groupBy("repository").agg(F.count(F.lit(1)).alias("n"))


def group_ngroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(talks(spark, sf_dir), facets=()).search(SearchRequest(group_by="repository")).stats


def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(q="that", rows=10, page=3)
    pages = F.ceil(F.col("num_found") / request.rows)
    return engine(corpus(spark, sf_dir)).search(request).stats.select(F.explode(present.page_links(request.page, pages)).alias("page"))


def result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of a page of results."""
    cards = engine(corpus(spark, sf_dir)).search(SearchRequest(q="that from")).cards
    return cards.select("id", "title", "source", F.get("snippets", F.lit(0)).alias("best"), F.size("snippets").cast("long").alias("n"), F.col("href").isNull().alias("unlinked"), "meta")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = web(spark, sf_dir)
    path = F.regexp_replace("url", r"^\w+://[^/]*", "")
    return p.select("id", present.basename(path).alias("basename"), present.display_title(F.lit(None), F.col("title"), path, F.col("id")).alias("display_title"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = web(spark, sf_dir)
    return p.select("id", present.repository_href(F.when(F.col("id").cast("long") % 2 == 0, F.col("url")), F.lit("https://host/repo/"), F.concat(F.lit("/dir/file "), F.col("id"))).alias("href"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(corpus(spark, sf_dir)).search(SearchRequest(q="that from")).highlighting
    return found.select("id", "field", F.posexplode("snippets").alias("rank", "snippet"))


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir).withColumn("age_d", F.datediff(F.lit("2000-01-01").cast("date"), F.col("last_modified")).cast("double"))
    return engine(docs).search(SearchRequest(bf="recip(age_d,0.001,1,1)", rows=20)).docs.select("id", F.round("score", 6).alias("score"))


def boosted_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(orders(spark, sf_dir)).search(SearchRequest(bf="recip(ms(NOW/DAY,last_modified),1e-9,1e3,1)", rows=20)).docs.select("id", F.round("score", 6).alias("score"))


def listed(source, **request) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(source(spark, sf_dir)).search(SearchRequest(**request)).docs.select("id")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result list shows of each page, and of one standing in a group of its own path."""
    p = web(spark, sf_dir)
    path, author = F.regexp_replace("url", r"^\w+://[^/]*", ""), F.when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit("author "), F.col("id")))
    body, none = F.col("content"), F.lit(None).cast("string")
    return p.select(
        "id", present.meta_line(author, F.lit(None).cast("timestamp")).alias("meta"), present.fallback_snippet(none, none, body).alias("snippet"),
        present.fallback_snippet(none, F.when(F.col("id").cast("long") % 2 == 0, "scanned"), body, 200).alias("group_snippet"),
        present.file_href(path, "/srv/root/").alias("file"), present.action_href(path, F.when(F.col("id").cast("long") % 2 == 0, path), F.col("url")).alias("action"),
    )


BODY = "regexp_replace(html, '(?s)<[^>]*>', ' ', 'g')"
PATH = "regexp_replace(url, '^\\w+://[^/]*', '')"
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
MULTIFIELD = f"""WITH f AS (
  SELECT page_id::VARCHAR AS id, 'title' AS f, {TITLE} AS x FROM pages UNION ALL SELECT page_id::VARCHAR, 'content', {BODY} FROM pages),
w AS (SELECT id, f, lower(t) AS t FROM (SELECT id, f, unnest(list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}ー]+'), lambda x: x <> '')) AS t FROM f) WHERE lower(t) NOT IN ({STOPS})),
d AS (SELECT f.id, f.f, count(w.t) AS d FROM f LEFT JOIN w ON f.id = w.id AND f.f = w.f GROUP BY ALL),
a AS (SELECT f, avg(d) AS a, count(*) AS n FROM d GROUP BY f),
tf AS (SELECT id, f, t, count(*)::DOUBLE AS tf FROM w WHERE t IN ('that', 'from') GROUP BY ALL),
df AS (SELECT f, t, count(*) AS df FROM tf GROUP BY ALL),
best AS (
  SELECT tf.id, tf.t, max(CASE tf.f WHEN 'title' THEN 5 ELSE 1 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * d / a))) AS s
  FROM tf JOIN df ON tf.f = df.f AND tf.t = df.t JOIN d ON tf.id = d.id AND tf.f = d.f JOIN a ON tf.f = a.f GROUP BY tf.id, tf.t)
SELECT id, round(sum(s), 6) AS score FROM best GROUP BY id ORDER BY sum(s) DESC, id LIMIT 10"""
CODE = r"""WITH t AS (SELECT unnest(string_split_regex(trim(p_name), '\s+')) AS t FROM part),
p AS (SELECT t, regexp_extract_all(t, '\p{Lu}*\p{Ll}+|\p{Lu}+|\p{N}+') AS parts FROM t WHERE t <> ''),
x AS (SELECT unnest(list_distinct(list_concat([lower(t)], list_transform(parts, lambda x: lower(x)), CASE WHEN len(parts) > 0 THEN [lower(array_to_string(list_filter(parts, lambda x: NOT regexp_matches(x, '^\p{N}')), ''))] ELSE [] END))) AS term FROM p)
SELECT term, count(*) AS n FROM x WHERE term <> '' GROUP BY 1"""
def escape_sql(text: str) -> str:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{plain}', '{code}')"
    return text


#: Texts as words and what stands between them, with running lengths for offsets; passages by the stride that a word ends in.
WORDS = "[\\p{L}\\p{M}\\p{N}ー]+"
SNIPPETS = f"""WITH page AS ({scored(PAIR, "m_a + m_b >= 1", TOP10)}),
raw AS (SELECT id, text, regexp_extract_all(text, '{WORDS}') AS w, regexp_split_to_array(text, '{WORDS}') AS g FROM page JOIN documents ON doc_id::VARCHAR = id),
cut AS (SELECT id, text, g[1] AS lead, unnest(w) AS w, unnest(g[2:]) AS g, generate_subscripts(w, 1) AS i FROM raw),
placed AS (SELECT *, lower(w) AS t, length(lead) + coalesce(sum(length(w) + length(g)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cut),
begun AS (SELECT id, (s + length(w)) // 150 AS p, min(s) AS s FROM placed WHERE t NOT IN ({STOPS}) GROUP BY ALL),
passages AS (
  SELECT id, p, CASE WHEN row_number() OVER x = 1 THEN 0 ELSE s END AS begin, coalesce(lead(s) OVER x, 1000000000000) AS stop FROM begun WINDOW x AS (PARTITION BY id ORDER BY p)),
pieces AS (
  SELECT a.id, p, count(DISTINCT t) FILTER (WHERE t IN ('that', 'from')) AS kinds, count(*) FILTER (WHERE t IN ('that', 'from')) AS marks,
         CASE WHEN begin = 0 THEN {escape_sql("any_value(lead)")} ELSE '' END ||
         string_agg((CASE WHEN t IN ('that', 'from') THEN '<mark>' || w || '</mark>' ELSE w END) || {escape_sql("g")}, '' ORDER BY i) AS x
  FROM placed a JOIN passages b ON a.id = b.id AND s >= begin AND s < stop GROUP BY a.id, p, begin)
SELECT id, 'content' AS field, (row_number() OVER y - 1)::INT AS rank, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS snippet FROM pieces WHERE marks > 0
WINDOW y AS (PARTITION BY id ORDER BY kinds DESC, marks DESC, p) QUALIFY row_number() OVER y <= 3"""
#: Every line has eight places: get, two words of the name, the size, =, the type, brand and its number; whole identifiers stand
#: at the first of their parts.
CODE_POSITIONS = """WITH p AS (SELECT p_partkey::VARCHAR AS id, string_split(p_name, ' ') AS w, p_size::VARCHAR AS s, lower(p_type) AS y, string_split(lower(p_brand), '#') AS b FROM part)
SELECT id, unnest(['get', w[1], w[2], s, 'get' || w[1] || w[2] || s, 'get' || w[1] || w[2], '=', y, b[1], b[2], y || '_' || b[1] || '#' || b[2], y || b[1]]) AS term,
  unnest([0, 1, 2, 3, 0, 0, 4, 5, 6, 7, 5, 5]) AS pos FROM p"""
CODE_PHRASE = """WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE 'red' IN string_split(p_name, ' ')) AS a, count(*) FILTER (WHERE 'widget' IN string_split(p_name, ' ')) AS b FROM part)
SELECT p_partkey::VARCHAR AS id, round(1.5 * (ln(1 + (n - a + 0.5) / (a + 0.5)) + ln(1 + (n - b + 0.5) / (b + 0.5))) / 2.2, 6) AS score FROM part CROSS JOIN d WHERE p_name = 'red widget'"""
#: An identifier is found whole, or as its parts in a row; here both mean the same lines.
CODE_IDENTIFIER = """WITH d AS (SELECT count(*) AS n, count(*) FILTER (WHERE 'hot' IN string_split(p_name, ' ')) AS a, count(*) FILTER (WHERE 'gear' IN string_split(p_name, ' ')) AS b, count(*) FILTER (WHERE p_size = 3 OR p_brand = 'Brand#3') AS c FROM part)
SELECT p_partkey::VARCHAR AS id, round(1.5 * (ln(1 + 0.5 / (n + 0.5)) + ln(1 + (n - a + 0.5) / (a + 0.5)) + ln(1 + (n - b + 0.5) / (b + 0.5)) + ln(1 + (n - c + 0.5) / (c + 0.5))) / 2.2, 6) AS score
FROM part CROSS JOIN d WHERE p_name = 'hot gear' AND p_size = 3"""
CARDS = f"""SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 3 = 0 THEN 'author ' || page_id ELSE '' END AS meta, left({BODY}, 300) AS snippet,
  CASE WHEN page_id % 2 = 0 THEN 'scanned' ELSE left({BODY}, 200) END AS group_snippet,
  CASE WHEN {PATH} <> '' THEN 'file://' || replace(replace(replace(replace({PATH}, '#', '%23'), '?', '%3F'), '=', '%3D'), '&', '%26') END AS file, CASE WHEN page_id % 2 = 0 THEN NULL ELSE url END AS action FROM pages"""

POSITIONS = f"""WITH v AS (SELECT p_partkey::VARCHAR AS id, 0 AS k, p_name AS x FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, p_type FROM part),
l AS (SELECT id, k, list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}ー]+'), lambda x: x <> '') AS l FROM v),
w AS (SELECT id, k, lower(t) AS term, i - 1 AS pos FROM (SELECT id, k, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l) WHERE lower(t) NOT IN ({STOPS})),
e AS (SELECT id, max(pos) + 1 AS n FROM w WHERE k = 0 GROUP BY id)
SELECT w.id, term, (pos + CASE WHEN k = 1 THEN coalesce(n, 0) + 100 ELSE 0 END)::INT AS pos FROM w LEFT JOIN e ON w.id = e.id"""
ORDERS = "SELECT o_orderkey::VARCHAR AS id, o_orderdate::TIMESTAMP AS last_modified, o_orderstatus AS repository, o_orderpriority AS file_type FROM orders"
BY_TAG = "SELECT facet, value, n FROM (SELECT 'repository' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL UNION ALL SELECT 'file_type', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"

#: A clause in parentheses that does not match adds nothing to the score.
GRAMMAR = scored(FOUR, "(m_a = 1 AND m_b = 1) OR (m_c = 1 AND m_d = 0)", "")
for one, both in (("tf_a.f > 0", "tf_a.f > 0 AND tf_b.f > 0"), ("tf_b.f > 0", "tf_b.f > 0 AND tf_a.f > 0"), ("tf_c.f > 0", "tf_c.f > 0 AND tf_d.f IS NULL"), ("tf_d.f > 0", "FALSE")):
    GRAMMAR = GRAMMAR.replace(f"CASE WHEN {one} THEN", f"CASE WHEN {both} THEN")

FACET_TAIL = "QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 20"
GENERAL = f"SELECT lower(t) AS term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}ー]+'), lambda x: x <> '')) AS t FROM documents) WHERE lower(t) NOT IN ({STOPS}) GROUP BY 1"

GROUP_TOPN = f"""WITH hits AS (SELECT h.id, h.score, d.source FROM ({scored({'a': is_('that')}, 'm_a = 1', '').replace('round(s, 6) AS score', 's AS score')}) h JOIN documents d ON d.doc_id::VARCHAR = h.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY source) AS c FROM hits),
page AS (SELECT source FROM ranked WHERE r = 1 ORDER BY score DESC, id LIMIT 5)
SELECT source AS key, c AS count, greatest(c - 10, 0) AS overflow, r::INT AS rank, id, round(score, 6) AS score FROM ranked WHERE r <= 10 AND source IN (SELECT source FROM page)"""
#: The documents of ``index_terms`` and of ``index_after_upsert`` after their batches.
THIRDS = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'that this' ELSE text END AS text FROM documents)"
BATCHES = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'that ' || text ELSE text END AS text, lang, source FROM documents UNION ALL SELECT doc_id + 10000000, text, lang, source FROM documents WHERE doc_id % 5 = 0)"
UPSERTED = scored(PAIR, "m_a + m_b >= 1", "").replace("FROM documents", f"FROM {BATCHES}")

#: key -> (query, SQL); None where SQL does not express the operator.
CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "search_topk": (top(corpus, q="that from", lang="en"), scored(PAIR, "lang = 'en' AND m_a + m_b >= 1", TOP10)),
    "search_or": (matches(corpus, q="that from"), scored(PAIR, "m_a + m_b >= 1", "")),
    "search_and": (matches(corpus, q="that from", op="AND"), scored(PAIR, "m_a + m_b = 2", "")),
    "search_not": (matches(corpus, q="that -from"), f"SELECT id, score FROM ({scored({'a': is_('that'), 'b': is_('from')}, 'm_a = 1 AND m_b = 0', '')})"),
    "search_mm_pct": (matches(corpus, q="that from this are", mm="75%"), scored(FOUR, "m_a + m_b + m_c + m_d >= 3", "")),
    "search_mm_conditional": (matches(corpus, q="that from this", mm="2<75%"), scored(TRIO, "m_a + m_b + m_c >= 2", "")),
    "search_phrase": (matches(corpus, q="that from", phrase=True), phrase_sql(["that", "from"], 0)),
    "search_proximity": (matches(corpus, q="that from", proximity="5"), phrase_sql(["that", "from"], 5)),
    "search_proximity3": (matches(corpus, q="from this that", proximity="8"), phrase_sql(["from", "this", "that"], 8)),
    "search_proximity_repeat": (matches(corpus, q="that this that", proximity="12"), phrase_sql(["that", "this", "that"], 12)),
    "search_phrase3": (matches(corpus, q='"anea eriner thanea"'), phrase_sql(["anea", "eriner", "thanea"], 0)),
    "search_fuzzy2": (matches(corpus, q="htat~2"), fuzzy_sql("htat", 2)),
    "search_fuzzy_swap": (matches(corpus, q="heatre", fuzzy="1"), fuzzy_sql("heatre", 1)),
    "search_text_range": (matches(corpus, q="content:{thatin TO thats]"), scored({"a": "t > 'thatin' AND t <= 'thats'"}, "m_a = 1", "")),
    "search_whole_string": (
        matches(makers, q="Brand#2 ECONOMY"),
        "SELECT p_partkey::VARCHAR AS id, round(2 / 2.2 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score FROM (SELECT *, count(*) OVER () AS n, count(*) FILTER (WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY') OVER () AS df FROM part) WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'",
    ),
    "code_phrase": (matches(sources, q='"red widget"'), CODE_PHRASE),
    "code_identifier": (matches(sources, q="getHotGear3"), CODE_IDENTIFIER),
    "analyze_code_positions": (code_positions, CODE_POSITIONS),
    "search_exact_terms": (matches(corpus, q="that from", exact=True), scored(PAIR, "m_a + m_b >= 1", "")),
    "search_fuzzy1": (
        matches(corpus, q="that", fuzzy="1"),
        fuzzy_sql("that", 1),
    ),
    "search_prefix": (matches(corpus, q="thatn*"), scored({"a": "starts_with(t, 'thatn')"}, "m_a = 1", "")),
    "search_wildcard": (matches(corpus, q="th?t"), scored({"a": "regexp_full_match(t, 'th.t')"}, "m_a = 1", "")),
    "search_regex": (matches(corpus, q="/tha[nt]/"), scored({"a": "regexp_full_match(t, 'tha[nt]')"}, "m_a = 1", "")),
    "search_constant": (matches(corpus, q="that^=2 from^3"), scored(PAIR, "m_a + m_b >= 1", "").replace("CASE WHEN tf_a.f > 0 THEN ln", "CASE WHEN tf_a.f > 0 THEN 2 + 0 * ln").replace("CASE WHEN tf_b.f > 0 THEN ln", "CASE WHEN tf_b.f > 0 THEN 3 * ln")),
    "match_all_page": (listed(corpus, page=2, rows=20), "SELECT doc_id::VARCHAR AS id FROM documents ORDER BY doc_id::VARCHAR LIMIT 20 OFFSET 20"),
    "search_boost_date": (
        boosted_by_date,
        "SELECT o_orderkey::VARCHAR AS id, round(1 + 1e3 / (1e-9 * epoch_ms(current_date::TIMESTAMP) - 1e-9 * epoch_ms(o_orderdate::TIMESTAMP) + 1), 6) AS score FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 20",
    ),
    "search_boost_recency": (boosted, "SELECT o_orderkey::VARCHAR AS id, round(1 + 1 / (0.001 * date_diff('day', o_orderdate::DATE, DATE '2000-01-01') + 1), 6) AS score FROM orders ORDER BY 1 / (0.001 * date_diff('day', o_orderdate::DATE, DATE '2000-01-01') + 1) DESC, o_orderkey::VARCHAR LIMIT 20"),
    "search_multifield": (top(web, q="that the from"), MULTIFIELD),
    "search_dismax": (top(web, q="that the from", parser="dismax"), MULTIFIELD),
    "search_lucene": (top(web, q="that the from", parser="lucene"), MULTIFIELD.replace("WHERE t IN", "WHERE f = 'content' AND t IN")),
    "search_boosted_term": (matches(corpus, q="that^2 from"), scored(PAIR, "m_a + m_b >= 1", "").replace("CASE WHEN tf_a.f > 0 THEN ln", "CASE WHEN tf_a.f > 0 THEN 2 * ln")),
    "search_grammar": (matches(corpus, q="(that && fro\\m) || (this && !are)"), GRAMMAR),
    "index_and": (indexed(corpus, q="that from", op="AND"), scored(PAIR, "m_a + m_b = 2", "")),
    "index_not": (indexed(corpus, q="that -from"), f"SELECT id, score FROM ({scored({'a': is_('that'), 'b': is_('from')}, 'm_a = 1 AND m_b = 0', '')})"),
    "index_proximity": (indexed(corpus, q="that from", proximity="5"), phrase_sql(["that", "from"], 5)),
    "index_fuzzy1": (
        indexed(corpus, q="that", fuzzy="1", lookup=("neighbours",)),
        fuzzy_sql("that", 1),
    ),
    "index_fuzzy2": (indexed(corpus, q="htat~2", lookup=("neighbours",)), fuzzy_sql("htat", 2)),
    "index_prefix": (indexed(corpus, q="thatn*"), scored({"a": "starts_with(t, 'thatn')"}, "m_a = 1", "")),
    "index_infix": (indexed(corpus, q="*hatn*", lookup=("grams",)), scored({"a": "contains(t, 'hatn')"}, "m_a = 1", "")),
    "index_regex": (indexed(corpus, q="/tha[nt]/"), scored({"a": "regexp_full_match(t, 'tha[nt]')"}, "m_a = 1", "")),
    "index_proximity3": (indexed(corpus, q="from this that", proximity="8"), phrase_sql(["from", "this", "that"], 8)),
    "index_filter": (indexed(corpus, q="that -from", lang="en", fq="content:this AND -content:are"), scored(FOUR, "lang = 'en' AND m_a = 1 AND m_b = 0 AND m_c = 1 AND m_d = 0", "").replace("CASE WHEN tf_b.f > 0 THEN", "CASE WHEN FALSE THEN").replace("CASE WHEN tf_c.f > 0 THEN", "CASE WHEN FALSE THEN").replace("CASE WHEN tf_d.f > 0 THEN", "CASE WHEN FALSE THEN")),
    "index_facet": (
        indexed(corpus, "facets", ("facet", "value", "n"), q="that", repository=("src1", "src2"), lang="en"),
        f"WITH {TOKENS} SELECT facet, value, n FROM (SELECT 'repository' AS facet, source AS value, count(*) AS n FROM lens WHERE lang = 'en' AND id IN (SELECT id FROM words WHERE t = 'that') AND source IS NOT NULL GROUP BY ALL) {FACET_TAIL}",
    ),
    "index_group": (index_groups, GROUP_TOPN),
    "index_page": (indexed(corpus, "docs", ("id", "text", "language", "score"), q="that from", rows=10, page=2), f"SELECT id, text, lang AS language, score FROM ({scored(PAIR, 'm_a + m_b >= 1', TOP10 + ' OFFSET 10')}) JOIN documents ON doc_id::VARCHAR = id"),
    "index_after_upsert": (index_upserts, UPSERTED),
    "index_terms": (
        index_terms,
        f"WITH {TOKENS.replace('FROM documents', 'FROM ' + THIRDS, 1)} SELECT t AS term, count(DISTINCT id) AS df, count(*) AS cf FROM words GROUP BY 1",
    ),
    "index_wildcard": (indexed(corpus, q="th?t"), scored({"a": "regexp_full_match(t, 'th.t')"}, "m_a = 1", "")),
    "filter_lang": (matches(corpus, lang="fr"), "SELECT doc_id::VARCHAR AS id, 1.0 AS score FROM documents WHERE lang = 'fr'"),
    "filter_source_in": (matches(corpus, repository=("src1", "src2")), "SELECT doc_id::VARCHAR AS id, 1.0 AS score FROM documents WHERE source IN ('src1', 'src2')"),
    "filter_date_range": (
        matches(orders, date_from="1995-01-01", date_to="1995-03-31"),
        "SELECT o_orderkey::VARCHAR AS id, 1.0 AS score FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31 23:59:59'",
    ),
    "filter_date_open": (matches(orders, date_from="1998-01-01"), "SELECT o_orderkey::VARCHAR AS id, 1.0 AS score FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"),
    "filter_raw_expr": (
        matches(parts, fq="size_i:[10 TO 20} AND -repository:Brand#1* AND (price_d:[1000 TO *] OR size_i:15)"),
        "SELECT p_partkey::VARCHAR AS id, 1.0 AS score FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand NOT LIKE 'Brand#1%' AND (p_retailprice >= 1000 OR p_size = 15)",
    ),
    "filter_escaped": (matches(parts, fq="repository:Brand\\#1? AND -file_type:*\\ TIN"), "SELECT p_partkey::VARCHAR AS id, 1.0 AS score FROM part WHERE p_brand LIKE 'Brand#1_' AND p_type NOT LIKE '% TIN'"),
    "filter_date_math": (
        matches(orders, fq="last_modified:[NOW-30YEARS/YEAR TO NOW/DAY}"),
        "SELECT o_orderkey::VARCHAR AS id, 1.0 AS score FROM orders WHERE o_orderdate >= date_trunc('year', current_date - INTERVAL 30 YEAR) AND o_orderdate < current_date",
    ),
    "facet_tagged": (facet(orders, fq="{!tag=repository}repository:F", file_type=("1-URGENT", "5-LOW")), f"{BY_TAG} {FACET_TAIL}"),
    "facet_source": (facet(corpus, q="that"), f"WITH {TOKENS} SELECT facet, value, n FROM (SELECT 'repository' AS facet, source AS value, count(*) AS n FROM lens WHERE id IN (SELECT id FROM words WHERE t = 'that') AND source IS NOT NULL GROUP BY ALL) {FACET_TAIL}"),
    "facet_multiselect": (
        facet(orders, repository=("F",), file_type=("1-URGENT", "5-LOW")),
        f"{BY_TAG} {FACET_TAIL}",
    ),
    "facet_part": (facet(parts), f"SELECT facet, value, n FROM (SELECT 'repository' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'file_type', p_type, count(*) FROM part GROUP BY ALL) WHERE value IS NOT NULL {FACET_TAIL}"),
    "group_topn": (
        groups(corpus, q="that", group_by="repository", rows=5),
        GROUP_TOPN,
    ),
    "group_counts": (group_counts, f"WITH {TOKENS} SELECT source AS repository, count(*) AS n FROM lens WHERE id IN (SELECT id FROM words WHERE t = 'that') GROUP BY ALL"),
    "group_ngroups": (group_ngroups, "SELECT count(DISTINCT conv_id) AS num_found, count(*) AS matches FROM conversations"),
    "sort_date_desc": (listed(orders, sort="last_modified desc", rows=50), "SELECT o_orderkey::VARCHAR AS id FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey::VARCHAR LIMIT 50"),
    "sort_title_asc": (listed(parts, sort="title asc", rows=50), "SELECT p_partkey::VARCHAR AS id FROM part ORDER BY p_name ASC NULLS LAST, p_partkey::VARCHAR LIMIT 50"),
    "page_3": (listed(parts, sort="size_i desc, price_d asc", rows=25, page=3), "SELECT p_partkey::VARCHAR AS id FROM part ORDER BY p_size DESC NULLS LAST, p_retailprice ASC NULLS FIRST, p_partkey::VARCHAR LIMIT 25 OFFSET 50"),
    "page_window": (page_window, f"WITH {TOKENS}, h AS (SELECT ceil(count(DISTINCT id) / 10.0)::BIGINT AS p FROM words WHERE t = 'that') SELECT unnest(range(1, least(p, 5) + 1)) AS page FROM h"),
    "analyze_general": (analyze(analysis.general, "text", "documents", "doc_id"), GENERAL),
    "analyze_fold": (
        analyze(lambda c: analysis.ocr(c), "text", "documents", "doc_id"),
        f"WITH w AS (SELECT lower(unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}ー]+'), lambda x: x <> ''))) AS t FROM documents), both_ AS (SELECT unnest(list_distinct([t, translate(t, '{analysis.ACCENTED}', '{analysis.PLAIN}')])) AS term FROM w) SELECT term, count(*) AS n FROM both_ WHERE term NOT IN ({STOPS}) GROUP BY 1",
    ),
    "analyze_code": (analyze(analysis.code, "p_name", "part", "p_partkey"), CODE),
    "analyze_positions": (positions, POSITIONS),
    "analyze_synonym": (matches(corpus, q="charge that"), scored({"a": "t IN ('payment', 'billing', 'charge')", "b": is_("that")}, "m_a + m_b >= 1", "")),
    "corpus_stats": (corpus_stats, f"WITH {TOKENS} SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_words, round(avg(dl), 6) AS mean_words FROM lens"),
    "doc_frequency": (doc_frequency, f"WITH {TOKENS} SELECT t AS term, count(DISTINCT id) AS df, count(*) AS cf FROM words GROUP BY 1"),
    "highlight_snippets": (snippets, SNIPPETS),
    "result_list": (result_list, f"SELECT id, id AS title, 'text' AS source, max(snippet) FILTER (WHERE rank = 0) AS best, count(*) AS n, TRUE AS unlinked, '' AS meta FROM ({SNIPPETS}) GROUP BY id"),
    "display_title": (titles, f"SELECT page_id::VARCHAR AS id, string_split({PATH}, '/')[-1] AS basename, coalesce(nullif({TITLE}, ''), nullif(string_split({PATH}, '/')[-1], ''), nullif({PATH}, ''), page_id::VARCHAR) AS display_title FROM pages"),
    "result_cards": (cards, CARDS),
    "repository_href": (links, "SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 2 = 0 AND url <> '' THEN url ELSE 'https://host/repo/dir/file%20' || page_id END AS href FROM pages"),
    "json_sink": (json_sink, "SELECT doc_id::VARCHAR AS id, text, lang AS language, source AS repository FROM documents"),
    "json_arrays": (json_arrays, ORDERS),
    "stream_ingest": (streamed, ORDERS),
    "stream_restart": (restreamed, "SELECT seq, n, n AS n_rows FROM (SELECT unnest([0, 1, 2]) AS seq, unnest([o, p, o]) AS n FROM (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM part) AS p))"),
    "log_compact": (compacted, "SELECT p_partkey::VARCHAR AS id, p_brand AS repository, (CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END)::INT AS size_i, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS versions FROM part"),
    "upsert_latest": (upsert, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["search_topk"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql is not None}
