import pytest

from docsieve.errors import SearchError, UnsupportedQuery
from docsieve.parser import parse
from docsieve.request import SearchRequest, add_facet, page_window, remove_param, required, rewrite, set_param, toggle_facet


@pytest.mark.parametrize(
    ("q", "more", "out"),
    [
        ("", {"phrase": True}, "*:*"),
        ("login error", {}, "login error"),
        ("login error", {"proximity": "5", "phrase": True, "fuzzy": "1"}, '"login error"~5'),
        ('"login error"', {"proximity": "5"}, '"login error"~5'),
        ("login -error", {"exact": True}, '"login" -error'),
        ("login -error", {"fuzzy": "1"}, "login~1 -error"),
        ("login error", {"exact": True, "fuzzy": "1"}, '"login" "error"'),
        ("login error", {"phrase": True, "exact": True}, '"login error"'),
        ("login", {"fuzzy": "x"}, "login"),
        ("login", {"proximity": "x"}, "login"),
    ],
)
def test_rewrite(q, more, out):
    assert rewrite(SearchRequest(q=q, **more)) == out


@pytest.mark.parametrize(("spec", "n", "out"), [("3", 5, 3), ("3", 2, 2), ("75%", 4, 3), ("75%", 3, 2), ("-1", 4, 3), ("2<75%", 2, 2), ("2<75%", 4, 3), ("1", 3, 1), ("-25%", 4, 3)])
def test_required(spec, n, out):
    assert required(n, spec) == out


def test_from_args():
    r = SearchRequest.from_args({"q": " a ", "rows": "500", "page": "0", "repository": ["x", " ", "y"], "hl": "0"})
    assert (r.q, r.rows, r.page, r.repository, r.hl, r.start) == ("a", 100, 1, ("x", "y"), False, 0)
    with pytest.raises(ValueError, match="rows"):
        SearchRequest.from_args({"rows": "ten"})
    with pytest.raises(SearchError):
        SearchRequest(parser="other")


def test_urls():
    assert toggle_facet("/s?lang=en&page=4", "language", "en") == "/s?page=1"
    assert toggle_facet("/s?repository=a", "repository", "b") == "/s?repository=a&repository=b&page=1"
    assert set_param("/s?page=1", "page", "2") == "/s?page=2"
    assert remove_param("/s?q=a&repository=b&repository=c", "repository") == "/s?q=a" and remove_param("/s?q=", "none") == "/s?q="
    assert add_facet("/s?q=a&page=7", "file_type", "py") == "/s?q=a&page=1&file_type=py"
    assert page_window(1, 9) == [1, 2, 3] and page_window(9, 9) == [7, 8, 9]


def test_parse():
    occurs = [o for o, _ in parse("a AND b OR -c +d").parts]
    assert occurs[-2:] == ["not", "must"]
    assert parse("size_i:[1 TO 5}").parts[0][1].closed == (True, False)
    with pytest.raises(UnsupportedQuery):
        parse("{!join from=a to=b}x")
    with pytest.raises(SearchError):
        parse("(a OR b")
