"""Index mode: whole requests from written tables, lookups of terms, segments, masks and merging."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.engine import SearchEngine
from docsieve.functions import highlight
from docsieve.operators import InvertedIndex, commit, merge
from docsieve.operators import inverted
from docsieve.parser import Leaf
from docsieve.request import SearchRequest
from docsieve.sources.manifest import published
from docsieve.sources.store import index_postings

WORDS = ["login", "logins", "lgoin", "page", "error", "user", "billing", "search", "the", "of", "検索", "naïve"]
COLUMNS = "id string, title array<string>, content array<string>, source_code_content string, author string, language string, repository string, file_type string, last_modified timestamp_ntz, size_i int"


def rows(seed=9, n=40):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(WORDS) for _ in range(r.randint(0, k)))
    out = []
    for k in range(n):
        title = r.choice([None, [], [some(3)], [some(2), some(2)]])
        out.append((str(k), title, r.choice([None, [some(12)], [some(20)]]), r.choice([None, "getUserName2 == x", "user_login(page)"]), r.choice(["Ann Lee", "Ann", None]), r.choice(["en", "ja", None]), r.choice(["a", "b", None]), r.choice(["py", "md"]), dt.datetime(2024, 1, 1 + k % 28), k % 5))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    InvertedIndex.build(docs).write(path)
    return InvertedIndex.read(spark, path)


REQUESTS = [
    {}, {"q": "login"}, {"q": "login -error"}, {"q": "-login"}, {"q": '-"login page" page'}, {"q": "login page error", "mm": "2"}, {"q": "login page", "op": "AND"}, {"q": '"login page"~4 lgoin~1'}, {"q": "log*"}, {"q": "*gin"}, {"q": "/log.*/"}, {"q": "lo?in^2 user"},
    {"q": "Ann Lee"}, {"q": "Ann -Lee"}, {"q": "author:Ann user"}, {"q": "title:* login"}, {"q": "content:{login TO user}"}, {"q": "検索"}, {"q": '"get user"'}, {"q": "getUserName2", "parser": "dismax"}, {"q": "naive naïve", "parser": "lucene"}, {"q": "the"},
    {"q": "login", "lang": "en"}, {"q": "login", "repository": ("a",), "file_type": ("py",)}, {"q": "page", "fq": "content:user AND -title:login"}, {"q": "page", "fq": "{!tag=repository}content:user"}, {"lang": "ja", "repository": ("a", "b"), "sort": "size_i desc, last_modified asc"},
    {"q": "page", "fq": "size_i:[1 TO 3}", "bf": "sum(size_i,1)", "date_from": "2024-01-05"}, {"q": "page", "group_by": "repository", "lang": "en"}, {"fq": "content:(user OR page)", "group_by": "author"},
]


@pytest.mark.parametrize("request_", REQUESTS, ids=str)
def test_answers_are_those_of_the_scan(docs, index, request_):
    request = SearchRequest(**request_)
    plain = lambda df, *c: sorted(map(str, df.select(*(F.round("score", 9).alias("score") if x == "score" else x for x in c)).collect()))
    if set(request_) <= {"q", "mm", "op", "parser"}:
        assert plain(index.engine().ranked(request), "id", "score") == plain(SearchEngine(docs).ranked(request), "id", "score")
        return
    scan, found = SearchEngine(docs).search(request), index.engine().search(request)
    assert plain(found.matches, "id", "score") == plain(scan.matches, "id", "score")
    assert plain(found.facets, "facet", "value", "n") == plain(scan.facets, "facet", "value", "n")
    assert plain(found.stats, "num_found") == plain(scan.stats, "num_found")
    if request.group_by:
        flat = lambda df: df.select("key", "count", F.inline("docs"))
        assert plain(flat(found.groups), "key", "count", "rank", "id", "score") == plain(flat(scan.groups), "key", "count", "rank", "id", "score")
    else:
        assert [r.id for r in found.docs.collect()] == [r.id for r in scan.docs.collect()]


def test_answer_of_an_index(docs, index):
    want, found = SearchEngine(docs).answer({"q": "login page", "rows": "3"}), index.engine().answer({"q": "login page", "rows": "3"})
    assert [{k: v for k, v in d.items() if k != "score"} for d in found["docs"]] == [{k: v for k, v in d.items() if k != "score"} for d in want["docs"]]
    assert found["highlighting"] == want["highlighting"] and found["num_found"] == want["num_found"] and index.engine().answer({"fq": "nothing:x"})["error"]


def test_scans_of_an_index_are_narrow(index):
    docs = index.engine().search(SearchRequest(q="login page")).docs
    docs.collect()
    plan = docs._sc._jvm.PythonSQLUtils.explainString(docs._jdf.queryExecution(), "formatted")
    assert "In(term, [login,page])" in plan and "field#" in plan and "dynamicpruningexpression(__bucket" in plan


def test_lookups_find_all_terms_of_a_clause(spark, index):
    engine, name = index.engine(), "content"
    words = [r.term for r in engine.vocabulary(name).collect()]
    for text, edits in (("login", 1), ("lgoin", 2), ("pag", 1), ("e", 2)):
        found = {r.term for r in engine.candidates(Leaf("fuzzy", text, name, edits), name).collect()}
        assert {w for w in words if highlight.osa(w, text) <= edits} <= found < set(words)
    pushed = engine.candidates(Leaf("wildcard", "log*", name), name)
    plan = pushed._sc._jvm.PythonSQLUtils.explainString(pushed._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(term,log)" in plan and "LessThan(term,loh)" in plan and {r.term for r in pushed.collect()} == {"login", "logins"}
    assert {r.term for r in engine.candidates(Leaf("wildcard", "*ogi*ins", name), name).collect()} == {"logins"} and {r.term for r in engine.candidates(Leaf("wildcard", "*ogi*", name), name).collect()} == {"login", "logins"}


def test_deletions_and_literals(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(120)]
    left = {x.t: set(x.d) for x in spark.createDataFrame([(w,) for w in set(words)], "t string").select("t", inverted.deletions(F.col("t")).alias("d")).collect()}
    for a in words[:30]:
        for b in words:
            if (d := highlight.osa(a, b)) <= 2:
                assert inverted.word_deletions(a, d) & left[b], (a, b)
    assert inverted.literals(Leaf("regex", "log[in]+x")) == ("log", ["log", "x"]) and inverted.literals(Leaf("regex", "ab?c"))[0] == "a" and inverted.literals(Leaf("regex", "a|b")) == ("", [])
    assert inverted.literals(Leaf("wildcard", "A*b?c")) == ("a", ["\x02a", "b", "c\x03"]) and inverted.after("ab") == "ac" and inverted.after("a\U0010ffff") == "b" and inverted.after("퟿") == ""


def test_postings_of_a_row_stay_in_it(spark):
    docs = spark.createDataFrame([("1", ["a b a"]), ("2", None), ("3", []), ("4", ["b", "b"])], "id string, content array<string>")
    found = index_postings(docs, "content")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # The stop word "a" has no postings.
    assert sorted((r.term, r.id, r.tf, r.positions) for r in found.collect()) == [("b", "1", 1, [1]), ("b", "4", 2, [0, 101])]


def test_a_frequent_term_is_spread(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("common word")).alias("content")).repartition(4)
    spread = inverted.ordered("postings", InvertedIndex.build(docs).postings)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_search_after_batches_is_that_of_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    first, second, third = rows(1, 30), [(str(k), *r[1:]) for k, r in zip([3, 7, 100, 3], rows(2, 4), strict=True)], [("7", None, ["login page"], None, None, "en", "a", "md", None, 1), ("200", *rows(4, 1)[0][1:])]
    current = {}
    for n, batch in enumerate((first, second, third)):
        commit(spark.createDataFrame(batch, COLUMNS).coalesce(1), path)
        current |= {r[0]: r for r in batch}  # the last of the rows of one id counts
        whole = SearchEngine(spark.createDataFrame([*current.values()], COLUMNS))
        for q in ("login page", "user~1 -error", "Ann Lee"):
            want = {(r.id, round(r.score, 9)) for r in whole.ranked(SearchRequest(q=q)).collect()}
            assert {(r.id, round(r.score, 9)) for r in InvertedIndex.read(spark, path).ranked(SearchRequest(q=q)).collect()} == want, (n, q)
        if n == 1:
            assert [r.name for r in published(spark, path)] == ["0", "1"] and merge(spark, path) == 2 and [r.name for r in published(spark, path)] == ["2"]
    index = InvertedIndex.read(spark, path)
    kept = {(r.field, r.term): (r.df, r.cf) for r in index.tables["vocabulary"].groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0").collect()}
    counted = {(r.field, r.term): (r.df, r.cf) for r in inverted.counted_terms(InvertedIndex.build(whole.docs).postings).collect()}
    assert kept == counted
    assert index.engine().search(SearchRequest(q="page", rows=5)).docs.count() == whole.search(SearchRequest(q="page", rows=5)).docs.count()


def test_versions_decide_within_a_batch(spark, tmp_path):
    batch = [("1", ["old"], 5), ("1", ["new"], 9), ("1", ["older"], 2), ("2", ["a1"], None), ("2", ["b1"], None)]
    commit(spark.createDataFrame(batch, "id string, content array<string>, _version_ long").coalesce(1), str(tmp_path / "i"))
    assert {r.id: r.content for r in InvertedIndex.read(spark, str(tmp_path / "i")).stored.collect()} == {"1": ["new"], "2": ["b1"]}


def test_an_unpublished_segment_is_not_seen(spark, tmp_path):
    path, docs = str(tmp_path / "i"), spark.createDataFrame([("1", ["one"])], "id string, content array<string>")
    commit(docs, path)
    InvertedIndex.build(docs.withColumn("id", F.lit("2"))).write(path, 1)  # as a commit that failed before its end
    assert [r.id for r in InvertedIndex.read(spark, path).stored.collect()] == ["1"]
    assert commit(docs.withColumn("id", F.lit("3")), path) == 1 and sorted(r.id for r in InvertedIndex.read(spark, path).stored.collect()) == ["1", "3"]
    assert schema.FACETS == ("repository", "file_type")
