import datetime as dt
import itertools
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docsieve import schema
from docsieve.engine import SearchEngine
from docsieve.errors import SearchError
from docsieve.functions import analysis, highlight, present
from docsieve.operators import InvertedIndex
from docsieve.parser import parse
from docsieve.plans import terms
from docsieve.plans.boost import boost_function
from docsieve.plans.compile import sloppy_frequency
from docsieve.request import SearchRequest
from docsieve.sources import store
from docsieve.sources.manifest import publish, published
from docsieve.streaming.ingest import stream_json

ROWS = [
    ("1", ["Login form"], ["The login page shows an error"], "getUserName2", "en", "repo", "py", "src/App.py", "Ann", dt.datetime(2024, 1, 31, 23, 59, 59)),
    ("2", ["Fehler"], ["an error in the login <b>&"], None, "en", "repo", "md", "a/b.md", "Bob", dt.datetime(2024, 1, 31, 23, 59, 59, 500000)),
    ("3", None, ["billing and user management"], "class XmlReader", "ja", None, "py", "C:\\dir\\file.txt", None, None),
    ("4", [], ["検索エンジン"], None, "ja", "other", None, None, "Ann", dt.datetime(2023, 5, 1)),
]
NAMES = ["id", "title", "content", "source_code_content", "language", "repository", "file_type", "file_path", "author", "last_modified"]


@pytest.fixture(scope="module")
def engine(spark):
    types = schema.struct()
    return SearchEngine(spark.createDataFrame(ROWS, ", ".join(f"{n} {types[n].dataType.simpleString()}" for n in NAMES)))


def ids(engine, **request):
    return sorted(r.id for r in engine.search(SearchRequest(**request)).matches.collect())


def test_queries(engine):
    assert ids(engine) == ["1", "2", "3", "4"]
    assert ids(engine, q="login error") == ["1", "2"]
    assert ids(engine, q='"login page"') == ["1"] and ids(engine, q="error login", proximity="5") == ["1", "2"] and ids(engine, q="error login", proximity="3") == ["2"]
    assert ids(engine, q="lgoin", fuzzy="1") == ["1", "2"] and ids(engine, q="log*") == ["1", "2"]
    assert ids(engine, q="payment") == ["3"], "synonyms"
    assert ids(engine, q="user") == ["1", "3"], "identifier parts"
    assert ids(engine, q="login -fehler") == ["1"] and ids(engine, q="login the", op="AND") == ["1", "2"]
    assert ids(engine, q="検索") == ["4"] and ids(engine, q="author:Ann") == ["1", "4"]
    assert ids(engine, q="src/App.py") == ["1"] and ids(engine, q="login", parser="lucene") == ["1", "2"]


def test_filters(engine):
    assert ids(engine, date_to="2024-01-31") == ["1", "4"] and ids(engine, date_from="2024-01-01") == ["1", "2"]
    assert ids(engine, lang="ja") == ["3", "4"] and ids(engine, repository=("repo", 'x" OR "')) == ["1", "2"]
    assert ids(engine, fq="repository:* AND -file_type:py") == ["2", "4"]
    with pytest.raises(SearchError):
        ids(engine, q="nofield:x")


def test_facets_groups_and_answer(engine):
    found = engine.search(SearchRequest(repository=("repo",), debug=True))
    facets = {(r.facet, r.value): r.n for r in found.facets.collect()}
    assert facets["repository", "other"] == 1 and facets["file_type", "py"] == 1
    grouped = engine.search(SearchRequest(group_by="repository"))
    assert {(r.key, r["count"]) for r in grouped.groups.collect()} == {("repo", 2), (None, 1), ("other", 1)}
    assert grouped.stats.first().num_found == 3
    answer = engine.search(SearchRequest(q="login", rows=1)).to_dict()
    assert answer["num_found"] == 2 and answer["total_pages"] == 2 and len(answer["docs"]) == 1
    marks = engine.search(SearchRequest(q="login")).to_dict()["highlighting"]
    assert "<mark>login</mark> &lt;b&gt;&amp;" in marks["2"]["content"][0]


def test_answers_have_one_structure(engine):
    good, idle, bad = engine.answer({"q": "login", "debug": "1"}), engine.browse({"q": " "}), engine.answer({"q": "(login"})
    assert engine.answer({})["num_found"] == 4 and engine.browse({"lang": "ja"})["num_found"] == 2, "without arguments all documents are answered, but not browsed"
    assert set(idle) == set(bad) <= set(good) and (idle["error"], good["error"], idle["docs"], bad["num_found"]) == (None, None, [], 0)
    assert "parenthesis" in bad["error"] and "rows" in engine.answer({"q": "login", "rows": "ten"})["error"]
    shares = good["debug"]["explain"]
    assert set(shares) == {"1", "2"} and set(shares["1"]) == {"title:term:login", "content:term:login"} and set(shares["2"]) == {"content:term:login"}
    score = {d["id"]: d["score"] for d in good["docs"]}
    assert all(abs(max(shares[i].values()) - score[i]) < 1e-9 for i in score)
    assert engine.ping()
    with pytest.raises(SearchError, match="clauses"):
        ids(engine, q=" ".join(f"w{k}" for k in range(1025)))


def test_filters_reach_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(str(k), f"text {k}", "en" if k % 2 else "fr", dt.datetime(2024, 1, k + 1)) for k in range(9)], "id string, t string, language string, last_modified timestamp_ntz")
    docs.select("id", F.array("t").alias("content"), "language", "last_modified").write.parquet(path := str(tmp_path / "d"))
    found = SearchEngine(spark.read.parquet(path)).search(SearchRequest(lang="fr", date_from="2024-01-03")).matches
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(language,fr)" in plan and "GreaterThanOrEqual(last_modified" in plan
    assert sorted(r.id for r in found.collect()) == ["2", "4", "6", "8"]


def test_index_is_written_and_read(spark, engine, tmp_path):
    index = InvertedIndex.build(engine.docs)
    index.write(str(tmp_path / "index"))
    kept = InvertedIndex.read(spark, str(tmp_path / "index"))
    for q in ("login -fehler", '"login page" lgoin~1', "author:Ann user", "*:*"):
        want = {(r.id, round(r.score, 9)) for r in engine.ranked(SearchRequest(q=q)).collect()}
        assert want and {(r.id, round(r.score, 9)) for r in kept.ranked(SearchRequest(q=q)).collect()} == want, q


def adds_up(node):
    """The value of an explanation, worked out from its parts."""
    close = lambda x: abs(x - node["value"]) < 1e-9
    values = [adds_up(p) for p in node["parts"]]
    if node["what"] == "sum":
        assert values and close(sum(values) * node["boost"])
    elif node["what"] == "best":
        assert values and close(max(values) * node["boost"])
    elif "idf" in node:
        assert close(node["weight"] * node["idf"] * node["tf"]) and abs(node["tf"] - node["frequency"] / (node["frequency"] + node["norm"])) < 1e-9
        assert "length" not in node or abs(node["norm"] - 1.2 * (0.25 + 0.75 * node["length"] / node["average"])) < 1e-9
    return node["value"]


@pytest.mark.parametrize("args", [{"q": "login error user"}, {"q": '"login page"~3 user^2'}, {"q": "login^=3 (error OR page)^2 -fehler"}, {"q": "lgoin~1 log*", "bf": "sum(1,2)"}, {"q": "Ann user"}], ids=str)
def test_explanations_add_up(engine, args):
    answer = engine.answer(args | {"debug": "1"})
    assert answer["docs"] and answer["error"] is None and "Scan" in answer["debug"]["plan"]
    for doc in answer["docs"]:
        assert abs(adds_up(answer["debug"]["explanation"][doc["id"]]) - doc["score"]) < 1e-9 and "explanation" not in doc


BAD = [
    {"date_from": "notadate"}, {"date_to": "2024-02-31"}, {"fq": "last_modified:[zzz TO *]"}, {"fq": "last_modified:[NOW-3PARSECS TO *]"}, {"bf": "recip(1"}, {"bf": "recip(1,2,3)"}, {"bf": "ms(title)"},
    {"bf": "1 2"}, {"bf": "pow(last_modified,2)"}, {"bf": "nothing(1)"}, {"bf": "price_d"}, {"fq": "size_i:3"}, {"sort": "price_d desc"}, {"sort": "title sideways"}, {"group_by": "size_i"}, {"group_by": "title"},
    {"q": "tags:x"}, {"q": "nofield:x"}, {"q": "/log(/"}, {"q": "a^"}, {"mm": "many", "q": "a b"}, {"rows": "ten"}, {"parser": "none"}, {"op": "XOR"},
]


@pytest.mark.parametrize("args", BAD, ids=str)
def test_bad_requests_are_answered(engine, args):
    found = engine.answer(args)
    assert found["error"] and set(found) == {"docs", "groups", "grouped", "num_found", "facets", "highlighting", "debug", "error"} and found["num_found"] == 0


def texts(spark, rows, field="content"):
    """An engine over documents of one field, with ids from 0."""
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(rows)], "id string, t string")
    return SearchEngine(docs.select("id", (F.array("t") if schema.field(field).many else F.col("t")).alias(field)))


@pytest.mark.parametrize(
    ("q", "found"),
    [
        ('"a1 b1 c1"~1', ["0", "1", "2"]),  # the span of all terms, not the sum of their gaps
        ('"a1 b1 c1"~0', ["1"]),
        ('"c1 b1 a1"~3', ["3"]), ('"c1 b1 a1"~4', ["1", "3"]), ('"c1 b1 a1"~5', ["0", "1", "2", "3"]),
        ('"login login"~1', ["5"]),  # one place serves one term
        ('"login login"~9', ["5", "6"]),
        ('"login x1 login"~3', ["6"]),
        ("ab~1", ["0", "1", "2", "3", "7"]), ("abcd~2", ["8"]), ("badc~1", ["8"]), ("ba~0", ["7"]), ("zz~2", ["0", "1", "2", "3", "6", "7"]),
        ("content:{a1 TO c1}", ["0", "1", "2", "3", "7", "8"]), ("content:{x1 TO x1}", []), ("content:[x1 TO x1]", ["0", "2", "6"]), ("content:{login TO x1]", ["0", "2", "4", "5", "6"]),
        ("b?dc", ["8"]), ("/(a1|ba)/", ["0", "1", "2", "3", "7"]),
    ],
)
def test_phrases_fuzzy_terms_and_ranges(spark, q, found):
    rows = ["a1 x1 b1 c1", "a1 b1 c1", "a1 b1 x1 c1", "c1 a1 b1", "login once", "login login once", "login x1 y1 y2 y3 login", "ba", "badc", None, ""]
    assert ids(texts(spark, rows), q=q) == found


def brute_span(text, query, slop):
    """Sum over places of the first term, by trying all choices of places."""
    words, total = text.split(), 0.0
    at = [[i for i, w in enumerate(words) if w == q] for q in query]
    for p in at[0]:
        spans = [max(x) - min(x) for c in itertools.product([p], *at[1:]) if len(set(c)) == len(c) for x in [[i - k for k, i in enumerate(c)]]]
        if spans and min(spans) <= slop:
            total += 1 / (1 + min(spans))
    return total


def test_sloppy_phrases_by_trying_all_places(spark):
    rng = random.Random(6)
    rows = [" ".join(rng.choice("pqrs") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string")
    for query in ("p q", "p q r", "p p", "p q p", "s r q p", "p p p q"):
        for slop in (1, 3, 8):
            wanted = analysis.slots(analysis.query_pieces("general", query))
            found = docs.select("id", sloppy_frequency(analysis.general(F.col("t")), wanted, slop).alias("f")).collect()
            assert {r.id: round(r.f, 9) for r in found} == {k: round(brute_span(t, query.split(), slop), 9) for k, t in enumerate(rows)}, (query, slop)


def test_distance(spark):
    rng = random.Random(7)
    pairs = [("ca", "abc"), ("", "ab"), ("ab", ""), ("ñandu", "nañdu")] + [tuple("".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(150)]
    for word in {b for _, b in pairs}:
        rows = spark.createDataFrame([(a,) for a, b in pairs if b == word], "t string").select("t", terms.osa(F.col("t"), word).alias("d"), terms.near(F.col("t"), word, 2).alias("n")).collect()
        assert all(r.d == highlight.osa(r.t, word) and r.n == (r.d <= 2) for r in rows)
    assert highlight.osa("ca", "abc") == 3 and highlight.osa("badc", "abcd") == 2


@pytest.mark.parametrize(
    ("q", "found"),
    [
        ('"get user"', ["0", "2"]), ('"user name"', ["0", "2"]), ("getUserName2", ["0", "2"]), ("getusername2", ["0"]), ('"getUserName2 value"', ["0"]), ('"name 2 value"', ["0"]), ('"get name"', []),
        ('"getusername"', ["0", "1"]), ('"get user_id"~3', ["3"]), ("xml", ["4"]), ('"read xml file"', ["4"]), ("source_code_content:==", ["1"]),
    ],
)
def test_identifiers(spark, q, found):
    rows = ["getUserName2 value", "GETUSERNAME == 3", "get user name-2", "getId user_id", "readXmlFile()", None]
    assert ids(texts(spark, rows, "source_code_content"), q=q) == found


def test_a_value_can_be_the_whole_query(spark):
    docs = spark.createDataFrame([("1", "Ann Lee", ["x"]), ("2", "Lee", ["Ann"]), ("3", "Ann", None)], "id string, author string, content array<string>")
    engine = SearchEngine(docs)
    assert ids(engine, q="Ann Lee") == ["1", "2", "3"] and ids(engine, q="Ann Lee", op="AND") == ["1", "2"] and ids(engine, q='"Ann Lee"') == ["1"]


def test_many_named_terms_are_tested_one_by_one(spark, monkeypatch):
    engine = texts(spark, ["abc abd", "zbx", "abc", None])
    want = {(r.id, r.score) for r in engine.ranked(SearchRequest(q="ab*  abx~1")).collect()}
    monkeypatch.setattr(schema, "MAX_CLAUSES", 2)
    assert len(want) == 3 and {(r.id, r.score) for r in engine.ranked(SearchRequest(q="ab* abx~1")).collect()} == want


def test_boost_functions(spark):
    docs = spark.createDataFrame([("1", dt.datetime(2024, 3, 1, 12), 4.0, None), ("2", None, -1.5, 3)], "id string, last_modified timestamp_ntz, price_d double, size_i int")
    value = lambda text: [r.v for r in docs.orderBy("id").select(boost_function(text, set(docs.columns)).alias("v")).collect()]
    assert value("sum(price_d, size_i,-1)") == [3.0, 0.5] and value("ms(2024-03-02,last_modified)") == [43_200_000.0, 0.0]
    assert value("ms(2024-03-02T00:00:00Z-1DAY/DAY+6HOURS,last_modified)") == [-21_600_000.0, 0.0]
    assert value("recip(ms(NOW/DAY,last_modified),0,6,2)") == [3.0, 3.0] and value("recip(1,0,1,0)") == [0.0, 0.0]
    assert value("max(product(2,field(price_d)), abs(-3), pow(2,1))") == [8.0, 3.0] and value("min(log(100),sqrt(9),5e-1)") == [0.5, 0.5]


# Highlighting


def mark(q, text, kind="general", **more):
    return highlight.snippets([text], kind, highlight.positive(parse(q)), **more)


def test_marks():
    assert mark("検索", "新しい検索エンジン") == ["新しい<mark>検</mark><mark>索</mark>エンジン"]
    assert mark("user", "call getUserName2 now", "code") == ["call get<mark>User</mark>Name2 now"] and mark("getusername2", "getUserName2", "code") == ["<mark>getUserName2</mark>"]
    assert mark("lgoin~1", "a login page") == ["a <mark>login</mark> page"] and mark("log*", "Login logs") == ["<mark>Login</mark> <mark>logs</mark>"] and mark("/l.g/", "log lag lug") == ["<mark>log</mark> <mark>lag</mark> <mark>lug</mark>"]
    assert mark("duong", "Đường tìm", "ocr") == ["<mark>Đường</mark> tìm"] and mark("payment", "the billing") == ["the <mark>billing</mark>"]
    assert mark('"login page"', "login form, login page, page") == ["login form, <mark>login</mark> <mark>page</mark>, page"] and mark('"page login"~4', "login page") == ["<mark>login</mark> <mark>page</mark>"]
    assert mark("login -page", "login page") == ["<mark>login</mark> page"] and mark("the", "the page") == [] and mark("other:x^2 (page)", "page") == ["<mark>page</mark>"]
    assert mark("login", "1 < login & 'so'") == ["1 &lt; <mark>login</mark> &amp; &#x27;so&#x27;"] and mark("login", "blogin logins") == [] and mark("login", "") == []
    assert mark("[b TO c}", "a b c") == ["a <mark>b</mark> c"]


def test_passages():
    text = "x " * 100 + "the Login, of " + "y z " * 60 + "login page login " + "w " * 100 + "login"
    got = mark("login page", text)
    assert len(got) == 3 and got[0].count("<mark>") == 3 and all(len(x.replace("<mark>", "").replace("</mark>", "")) <= 150 for x in got)
    assert got[1].startswith("x x") and "the <mark>Login</mark>, of y z" in got[1] and got[2].endswith("<mark>login</mark>")
    assert mark("login", "x" * 448 + " login") == ["<mark>login</mark>"] and len(mark("a1", "a1 " * 2000, count=3)) == 3
    assert highlight.snippets(["a login", "b"], "general", highlight.positive(parse("b login"))) == ["a <mark>login</mark>", "<mark>b</mark>"]


def test_offsets_agree_with_the_index(spark):
    samples = ["The Login of Users, Đường 検索エンジン foo_bar 3.14 İx", "getUserName2 XMLFile a-b__c 12ab34 == ÉcoleÀ1", "  ", "readXmlFile(x1,y2)\t\nnext_line"]
    for kind, chain in (("general", analysis.general), ("ocr", analysis.ocr), ("code", analysis.code)):
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(samples)], "k int, t string").select("k", F.inline(chain(F.col("t")))).collect()
        for k, text in enumerate(samples):
            assert {(r.term, r.pos) for r in rows if r.k == k} == {(s.term, s.pos) for s in highlight.spots(kind, text)}, (kind, text)


def test_cards(engine):
    cards = {r.id: r for r in engine.search(SearchRequest(q="login user")).cards.collect()}
    assert cards["1"].title == "<mark>Login</mark> form" and cards["1"].snippets == ["get<mark>User</mark>Name2"] and cards["1"].source == "code" and cards["1"].meta == "Ann 2024-01-31 23:59:59"
    assert cards["2"].snippets == ["an error in the <mark>login</mark> &lt;b&gt;&amp;"] and cards["2"].source == "text" and cards["2"].title == "Fehler"
    plain = {r.id: r for r in engine.search(SearchRequest(lang="ja")).cards.collect()}
    assert plain["3"].title == "file.txt" and plain["3"].snippets == ["class XmlReader"] and plain["4"].title == "4" and plain["4"].snippets == ["検索エンジン"]
    grouped = {r.id: r for r in engine.search(SearchRequest(q="login", group_by="file_path")).cards.collect()}
    assert grouped["1"].group == "src/App.py" and grouped["1"].href is None and grouped["1"].snippets == ["The <mark>login</mark> page shows an error"] and grouped["1"].meta == ""


def test_synonym_rules():
    rules = analysis.parse_synonyms("# a comment\nauth, Login\n\ncar, automobile => vehicle, car\n")
    assert rules == (("auth", "login"), {"car": ("vehicle", "car"), "automobile": ("vehicle", "car")})
    assert analysis.synonym_table(rules) == {"auth": ("auth", "login"), "login": ("auth", "login"), "car": ("vehicle", "car"), "automobile": ("vehicle", "car")}


def test_sorts(engine):
    order = lambda s: [r.id for r in engine.search(SearchRequest(sort=s)).docs.collect()]
    assert order("last_modified desc")[-1] == "3" and order("title asc")[:2] == ["2", "1"]


def test_analyzers(spark):
    def terms(chain, text):
        return [(r.term, r.pos) for r in spark.range(1).select(F.explode(chain(F.lit(text))).alias("t")).select("t.*").collect()]

    assert terms(analysis.general, "The Login of Users") == [("login", 1), ("users", 3)]
    assert terms(analysis.general, "検索エンジン") == [("検", 0), ("索", 1), ("エンジン", 2)]
    assert sorted(terms(analysis.ocr, "Đường tìm")) == sorted([("đường", 0), ("duong", 0), ("tìm", 1), ("tim", 1)])
    assert set(terms(analysis.code, "getUserName2 x-1-2")) == {("getusername2", 0), ("get", 0), ("user", 1), ("name", 2), ("2", 3), ("getusername", 0), ("x-1-2", 4), ("x", 4), ("1", 5), ("12", 5), ("2", 6)}
    assert [(t.terms, t.pos) for t in analysis.query_tokens("code", "getUser the")] == [(("getuser",), 0), (("get",), 0), (("user",), 1), (("the",), 2)]
    assert terms(analysis.code, "the") == [("the", 0)]
    for text in ("The Login of Users", "検索エンジン", "a b"):
        assert [(t.terms[0], t.pos) for t in analysis.query_tokens("general", text)] == [x for x in terms(analysis.general, text)]


def test_presentation(spark):
    row = spark.range(1).select(
        present.basename(F.lit("C:\\dir\\file.txt")).alias("a"), present.basename(F.lit("/a/b.py")).alias("b"),
        present.repository_href(F.lit(None).cast("string"), F.lit("http://h/r/"), F.lit("/d/é ~x.py")).alias("c"), present.format_number(F.lit("1234567")).alias("d"),
        present.field_title(F.lit("file_type")).alias("e"), present.repository_href(F.lit(None).cast("string"), F.lit("http://h/r"), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == ("file.txt", "b.py", "http://h/r/d/%C3%A9%20~x.py", "1,234,567", "File Type", "http://h/r")


def test_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('[{"id": "1", "title": ["old"]}, {"id": "2"}]')
    for _ in range(2):
        stream_json(spark, str(source), str(tmp_path / "log"), str(tmp_path / "mark"), None).awaitTermination()
        (source / "b.json").write_text('[{"id": "1", "title": ["new"]}]')
    log = str(tmp_path / "log")
    assert {r.id: r.title for r in store.current(spark, log).collect()} == {"1": ["new"], "2": None}
    # A new checkpoint starts to count anew, and a second source counts for itself; nothing of theirs takes another's place.
    for mark, text in (("other", '[{"id": "1", "title": ["a"]}, {"id": "1", "title": ["b"]}, {"id": "1", "title": ["a"]}]'), ("third", '[{"id": "3"}]')):
        (tmp_path / mark).mkdir()
        (tmp_path / mark / "c.json").write_text(text)
        for _ in range(2):
            stream_json(spark, str(tmp_path / mark), log, str(tmp_path / f"mark-{mark}"), None).awaitTermination()
    assert sorted((r._version_, r.id) for r in store.read_log(spark, log).collect()) == [(0, "1"), (0, "2"), (1, "1"), (2, "1"), (2, "1"), (2, "1"), (3, "3")]
    assert {r.id: r.title for r in store.current(spark, log).collect()} == {"1": ["a"], "2": None, "3": None}, "the last row of a batch counts"


def test_log(spark, tmp_path):
    log, docs = str(tmp_path / "log"), spark.createDataFrame([("1", 1), ("2", 2)], "id string, size_i int")
    with pytest.raises(SearchError):
        store.read_log(spark, log)
    assert [store.append(docs, log, "a", 5), store.append(docs, log, "b", 5), store.append(docs, log, "a", 5), store.append(docs, log, "a", 4)] == [0, 1, 0, 0]
    stale = published(spark, log)
    assert store.append(docs.withColumn("size_i", F.col("size_i") + 10), log) == 2
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        publish(spark, log, [("x", "late", 1)], stale)  # made from a list that is no longer the newest
    docs.write.parquet(f"{log}/batches/batch=lost")  # written and never published
    assert store.read_log(spark, log).count() == 6 and {(r.id, r.size_i) for r in store.current(spark, log).collect()} == {("1", 11), ("2", 12)}
    store.compact(spark, log, small := str(tmp_path / "small"))
    assert {(r.id, r.size_i) for r in store.current(spark, small).collect()} == {("1", 11), ("2", 12)} and store.read_log(spark, small).count() == 2
    assert store.append(docs, small, "a", 5) < store.append(docs, small, "a", 6), "what sources have sent before is known after compaction"
    ties = spark.createDataFrame([("1", 3, "x"), ("1", 3, "y"), ("2", 1, None)], "id string, _version_ long, t string")
    assert sorted((r.id, r.t) for r in store.upsert_latest(ties.repartition(3)).collect()) == [("1", "y"), ("2", None)]
