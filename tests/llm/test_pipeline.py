"""Each stage of the pipeline, and all in a row, against brute force on a small table."""

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from docsieve.llm import toxicity
from tests.llm.test_operators import ROWS, low, prose, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = dict(ROWS)[9]


def naive_score(text, model):
    """The lexicon's score without an automaton: every place of every entry and phrase, one by one."""
    text = text or ""
    folded = toxicity.fold(text)

    def places(entry, whole):
        at = [k for k in range(len(folded)) if folded.startswith(entry, k)]
        return [(k, k + len(entry)) for k in at if (k == 0 or not text[k - 1].isalnum()) and (not whole or k + len(entry) == len(text) or not text[k + len(entry)].isalnum())]

    spared = [p for x in model.exceptions for p in places(toxicity.fold(x), True)]
    hits = [(a, b, w) for x, w in model.weights.items() for a, b in places(x.removesuffix("~"), not x.endswith("~"))]
    total = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in spared))
    z = model.bias + model.slope * total / np.log2(8 + text.count(" ") + text.count("\n"))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def line_deduped(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: i is not None and len(o := held.get(key(x), ())) >= 3 and max(o) != i
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


def without_copies(rows):
    def print_of(t):
        w = words(low(t or ""))
        h = [xxhash.xxh64_intdigest(x, 42) for x in [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fp = np.array([print_of(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp) <= 3
    root = np.array([10**9 if i is None else i for i, _ in rows])
    while (new := np.array([root[n].min() for n in near])).tolist() != root.tolist():
        root = new
    return [(i, t) for (i, t), r in zip(rows, root.tolist(), strict=True) if i is None or i == r]


def without_leaks(rows, items):
    def grams(t):
        w = words(low(t or ""))
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    return [(i, t) for i, t in rows if i is None or not any(grams(u) and len(grams(t) & grams(u)) >= 0.8 * len(grams(u)) for _, u in items)]


ITEMS = [(1, PASSAGE), (2, "one"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with the cases of ROWS, rows without an id, a repeated row, and labelled toxic ones; a table too many."""
    rows = [*ROWS, ROWS[3], (None, "nobody's text"), (None, None)]
    rows += [(1000 + k, prose(12) + (" you idiot, scum " if k % 3 == 0 else " clown fish ") + prose(12)) for k in range(240)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), "more") for i, t in rows], SCHEMA + ", key string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def kept(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_every_stage_and_the_whole(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    expected = [(i, t) for i, t in rows if naive_score(t, model) < 0.5]
    assert kept(corpus_pipeline.drop_toxic(spark, docs, folder)) == sorted(expected, key=str) and 60 < len(rows) - len(expected) < 100
    for stage, plain in ((corpus_pipeline.drop_repeated_lines, line_deduped), (corpus_pipeline.drop_near_copies, without_copies), (corpus_pipeline.drop_leaks, lambda r: without_leaks(r, ITEMS))):
        before, expected = expected, plain(expected)
        assert kept(stage(spark, frame(spark, before), folder)) == sorted(expected, key=str) and expected != before
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in expected)
    pieces = corpus_pipeline.run(spark, folder).toPandas()
    assert sorted((str(i if i == i and i is not None else None).removesuffix(".0"), int(n)) for i, n in zip(pieces.doc_id, pieces.doc_tokens, strict=True)) == sorted((i, n) for i, n in lengths for _ in range(-(-n // 4096)))
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096 and pieces.length.sum() == sum(n for _, n in lengths)


def test_empty_tables(spark, tables):
    none = frame(spark, [(1, "x")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables[0]).count() == 0
