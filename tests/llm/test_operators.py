"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsieve.llm import classifier, components, decontamination, filters, lines, packing, rules, sharding, simhash, substrings, tokens, toxicity
from docsieve.llm.common import held_out

SCHEMA = "doc_id long, text string, key string, count long, h long, part int, shard int"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
LINE = "This very common line stands in Many documents"


def prose(n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def table():
    long = prose(4000) + " onhe. Is" * 90
    passage = prose(60)
    texts = [None, "", " \n\t", "one", "a b", "aaaa" * 80, long, long + " end", long, passage, prose(20) + passage + prose(9), passage + "\n" + passage]
    texts += [prose(rng.randint(3, 120)) for _ in range(30)]
    texts += [f"{prose(8)}\n  {LINE.upper() if k % 2 else LINE}\t\n{prose(5)}" for k in range(6)] + [f"{LINE}\n{LINE}\nx"]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows


ROWS = table()


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for r in tokens.count_tokens(docs, path).collect():
        t = dict(ROWS)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
    odd = ["a" * 77, "x<|endoftext|>y  z", "a \n b", " lead", "trail ", "a b", "don't I'll", "\x1c\x85 1²"]
    odd += ["".join(rng.choice(some) for _ in range(n)) for some in ("ab", "abcdefghijklmnopqrstuvwxyz", "aé漢", "a", " ") for n in (3_000, 50_000)]
    import pyarrow as pa

    assert tokens.token_counter(path)(pa.array(odd)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in odd]


def test_line_dedup(docs):
    keys = {}
    for i, t in ROWS:
        for x in (t or "").split("\n"):
            if len(k := low(x.strip(" \t\n\x0b\f\r"))) >= 20:
                keys.setdefault(k, set()).add(i)
    for bits in (1 << 16, 8):  # filters that screen, and crowded ones that let all pass
        found = lines.dedup_lines(docs, bits=bits)
        assert {"kept_text", "n_lines", "n_dropped", *docs.columns} == set(found.columns)
        for r in found.collect():
            parts = (dict(ROWS)[r.doc_id] or "").split("\n")
            kept = [x for x in parts if len(o := keys.get(low(x.strip(" \t\n\x0b\f\r")), ())) < 3 or max(o) == r.doc_id]
            assert (r.n_lines, r.n_dropped, r.kept_text) == (len(parts), len(parts) - len(kept), "\n".join(kept))


def test_twice_seen_hashes(spark):
    hashes = spark.range(50_000).selectExpr("xxhash64(if(id % 5 = 0, id % 700, id)) AS h").repartition(7)
    want = {r.h for r in hashes.groupBy("h").count().filter("count > 1").collect()}
    found = [r.h for r in lines.twice_seen(hashes, 1 << 20).collect()]
    assert want <= set(found) and len(found) == len(set(found)) < len(want) + 1000
    assert set(r.h for r in lines.twice_seen(hashes, 8).collect()) >= want and not lines.twice_seen(hashes.limit(0), 1 << 10).collect()


def test_filters_count_over_all_tasks(spark):
    # A hash that no task holds often, one that one task does, one that is there twice, and many once.
    rows = [(7, 1)] * 40 + [(8, 30)] + [(9, 1)] * 2 + [(k, 1) for k in range(100, 3100)]
    hashes = spark.createDataFrame(rows, "k long, n long").selectExpr("xxhash64(k) AS h", "n").repartition(20)
    twice, many = filters.twice_filter(hashes, 1 << 20, 16)
    h = {r.k: r.h for r in spark.createDataFrame([(k,) for k in (7, 8, 9, *range(100, 3100))], "k long").selectExpr("k", "xxhash64(k) AS h").collect()}
    at = lines.positions(np.array(list(h.values())), 1 << 20)
    again = dict(zip(h, lines.has_bits(twice, at[0]) & lines.has_bits(twice, at[1]), strict=True))
    often = dict(zip(h, filters.frequent_bits(many, *at), strict=True))
    assert again[7] and again[8] and again[9] and sum(again.values()) < 60 and often[7] and often[8] and not often[9] and sum(often.values()) < 10


def test_anchor_that_is_rare_in_a_slice_but_frequent_in_all(spark, monkeypatch):
    gen = random.Random(8)
    passage = "".join(gen.choice("abcdefgh") for _ in range(95))
    rows = [(k, "".join(gen.choice("mnopqrst") for _ in range(400)) + passage + "".join(gen.choice("uvwxyz") for _ in range(400))) for k in range(60)]
    rows += [(100, rows[3][1]), (101, passage + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(62)  # one text a slice
    named = docs.select("doc_id", "text")
    for fill in (0.5, 0.0):
        sizes = [r["count"] for r in substrings.contexts(named, 100, 1 << 22, 16, fill).filter("bytes is not null").groupBy("h").count().collect()]
        wide = [r["count"] for r in substrings.contexts(named, 100, 1 << 22, 1000, fill).filter("bytes is not null").groupBy("h").count().collect()]
        assert max(wide) >= 60 and sorted(sizes)[-8:] != sorted(wide)[-8:] and len(sizes) > len(wide)  # cut into blocks of offsets
        found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs, bits=1 << 22, max_fill=fill).collect()}
        assert found[100] == len(rows[3][1]) and sum(v for k, v in found.items() if k < 100) == 0


def test_substrings(docs, monkeypatch):
    def expected():
        seen, out = set(), {}
        for i, t in ROWS:
            raw = (t or "").encode()
            gone = np.zeros(len(raw), bool)
            for k in range(len(raw) - 99):
                if raw[k : k + 100] in seen:
                    gone[k : k + 100] = True
                seen.add(raw[k : k + 100])
            out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
        return out

    want = expected()
    # Nearly all anchors cut into blocks of offsets, and nearly none; the filter screens, and is crowded.
    for frequent, fill in ((2, 0.5), (16, 0.5), (2, 0.0), (16, 0.0)):
        found = substrings.remove_repeats(docs, bits=1 << 18, frequent=frequent, max_fill=fill)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()} == want


def test_crowded_bucket_is_compared_by_offset(monkeypatch):
    core = bytes(rng.randrange(256) for _ in range(90))
    data = [bytes(rng.randrange(256) for _ in range(39)) + core + bytes([k % 3] * 39) for k in range(40)]
    args = np.zeros(40, np.int64), np.arange(40), np.full(40, 68), np.full(40, 68, np.int32), data, 100
    plain = [x.tolist() for x in substrings.repeats(*args)]
    monkeypatch.setattr(substrings, "BATCH_ROWS", 4)
    assert [x.tolist() for x in substrings.repeats(*args)] == plain and plain[0]


def test_windows_of_one_bucket_are_equal():
    gen = np.random.default_rng(4)
    text = np.r_[gen.integers(97, 99, 3000), np.tile([97, 98, 99], 300), gen.integers(97, 123, 500)].astype(np.uint8)
    text = np.r_[text, text[100:900], text[2900:3600], np.zeros(140, np.uint8)].astype(np.uint8)
    starts = np.sort(gen.choice(len(text) - 240, 4000, replace=False))
    for block in (1 << 16, 64):
        substrings.BLOCK, was = block, substrings.BLOCK
        ids = substrings.window_ids(text, starts, 100)
        substrings.BLOCK = was
        assert len(set(ids.tolist())) == len({(i, text[k : k + 100].tobytes()) for i, k in zip(ids.tolist(), starts.tolist(), strict=True)}) == len({text[k : k + 100].tobytes() for k in starts})


def test_simhash(spark, docs):
    rows = [*ROWS, (None, "one"), (900, "one")]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(frame(spark, rows)).collect()}

    def print_of(t):
        w = words(low(t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fp = np.array([print_of(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp) <= 3
    ids = np.array([10**9 if i is None else i for i, _ in rows])
    root = ids.copy()
    while (new := np.array([root[n].min() for n in near])).tolist() != root.tolist():
        root = new
    assert got == {(i, int(f.view(np.int64))): int(r) for (i, _), f, r in zip(rows, fp, root, strict=True)}


def test_anchors_meet():
    gen = np.random.default_rng(3)
    x = gen.integers(0, 1 << 63, 200, dtype=np.uint64)
    y = x ^ np.bitwise_or.reduce([np.uint64(1) << gen.integers(0, 64, 200).astype(np.uint64) for _ in range(3)])
    for forms in (0, 2, 5, 10):
        at, to, home = simhash.anchors(np.r_[x, y], 3, forms)
        all_of, home_of = [set() for _ in range(400)], {}
        for i, t, h in zip(at.tolist(), to.tolist(), home.tolist(), strict=True):
            all_of[i].add(t)
            if h:
                assert home_of.setdefault(i, t) == t
        assert all(home_of[k] in all_of[k + 200] or home_of[k + 200] in all_of[k] for k in range(200))


def test_crowded_anchor(spark):
    base = rng.getrandbits(60)
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(a)} | {base})
    distinct = spark.createDataFrame([(x,) for x in fps], "fp long")
    for forms, block in ((0, 50), (3, 20_000)):
        edges = simhash.links(distinct, 3, forms, block=block)
        assert {r.root for r in components.components(edges).collect()} == {min(fps)}
    assert [simhash.forms_for(n) for n in (10**6, 2 * 10**7, 10**9, 10**10)] == [0, 1, 5, 7]


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}


def test_decontamination(spark, docs):
    items = [(1, dict(ROWS)[9]), (2, "one"), (3, None), (4, ""), (5, " ".join(words(dict(ROWS)[9])[:40]) + " w x y z"), (6, prose(30)), (7, "A B")]
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def grams(t):
        w = words(low(t or ""))
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    want = {}
    for i, t in ROWS:
        for j, u in items:
            both = grams(t) & grams(u)
            if both and len(both) >= 0.8 * len(grams(u)):
                want[i, j] = len(both)
    assert got == want and len(want) > 4


def test_shingles_are_screened_before_they_are_shuffled(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, dict(ROWS)[9]), (2, prose(40)), (2, dict(ROWS)[9])], "item_id long, text string")
    want = decontamination.leaks(docs, items).collect()
    monkeypatch.setattr(decontamination, "bounded", lambda side: side)  # as with more sketch rows than are broadcast
    found = decontamination.leaks(docs, items)
    assert sorted(found.collect()) == sorted(want)
    keys, others = (spark.range(a, b).select(F.xxhash64("id").alias("h")) for a, b in ((0, 3000), (3000, 40_000)))
    test = decontamination.among(keys)
    assert keys.filter(test).count() == 3000 and others.filter(test).count() < 2000 and "Exchange" not in others.filter(test)._jdf.queryExecution().optimizedPlan().toString()
    assert keys.filter(decontamination.among(keys, 64)).count() == 3000 and others.filter(decontamination.among(keys.limit(0))).count() == 0


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], np.uint32) for i, t in ROWS}
    rows = packing.pack(docs, path, keep_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    for i, own in rows.sort_values("start").groupby("doc_id"):
        assert b"".join(map(bytes, own.ids)) == ids[i].tobytes() and (own.doc_tokens == len(ids[i])).all()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows.itertuples())
    for _, own in rows.groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
    assert set(rows.doc_id) == set(ids)


def test_short_documents_are_packed_closely(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'one' AS text")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert rows.sequence_id.nunique() == 3 and rows.length.sum() == 10_000  # two tokens each
    gen = np.random.default_rng(3)
    sizes, n = np.unique(np.clip(gen.lognormal(3, 0.8, 100_000), 1, 4096).astype(int), return_counts=True)
    classes, at = np.unique([packing.length_class(int(x)) for x in sizes], return_inverse=True)
    made = sum(p.times for p in packing.patterns(classes, np.bincount(at, weights=n).astype(np.int64), 4096))
    assert made * 4096 <= 1.01 * (sizes @ n) + 4096


def test_length_classes():
    rounded = [packing.length_class(x) for x in range(1, 4097)]
    assert rounded[:255] == list(range(1, 256)) and rounded[4095] == 4096 and rounded == sorted(rounded)
    assert all(x <= c < x * (1 + 1 / packing.FINE) for x, c in zip(range(1, 4097), rounded, strict=True)) and len(set(rounded)) < 800


def test_cutting_stock_is_tight():
    gen = np.random.default_rng(1)
    sizes, demand = np.unique(np.clip(gen.lognormal(4, 1, 60).astype(int), 1, 512), return_counts=True)
    demand = demand * 997
    plan = packing.patterns(sizes, demand, 512)
    assert (sum(p.counts * p.times for p in plan) == demand).all() and all(p.counts @ sizes <= 512 for p in plan)
    assert sum(p.times for p in plan) <= 1.01 * np.ceil((sizes * demand).sum() / 512) + 2
    assert packing.patterns(np.array([], int), np.array([], int), 512) == []


def test_columns_are_priced_to_the_gap():
    gen = np.random.default_rng(2)
    for pieces in (gen.integers(700, 2700, 200_000), np.clip(gen.lognormal(6.8, 0.25, 200_000), 1, 4096)):
        sizes, demand = np.unique(np.ceil(pieces / 8).astype(int), return_counts=True)
        made = sum(p.times for p in packing.patterns(sizes, demand, 512))
        assert made <= 1.0001 * (sizes @ demand) / 512 + len(sizes)  # under one sequence a column is rounded


def test_sharding(docs):
    rows = sharding.shard_by_bytes(docs, 5).toPandas().sort_values("doc_id")
    assert len(rows) == len(ROWS) and (rows.shard.diff().dropna() >= 0).all()
    texts = dict(ROWS)
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode())) for r in rows.itertuples())
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in rows.groupby("shard"))
    # Each row lies where the middle of its bytes does.
    total, before = int(rows["size"].sum()), rows["size"].cumsum() - rows["size"]
    assert rows.shard.tolist() == [min(4, (2 * int(b) + int(n)) * 5 // (2 * total)) for b, n in zip(before, rows["size"], strict=True)]
    cuts = [total * k / 5 for k in range(1, 5)]
    ends = rows.groupby("shard")["size"].sum().cumsum().reindex(range(5)).ffill()
    assert all(abs(ends[k] - c) <= rows["size"].max() / 2 for k, c in enumerate(cuts))


def test_counts_for_rules(docs):
    for r in rules.features(docs, "doc_id").collect():
        t = dict(ROWS)[r.doc_id] or ""
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        full = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again))


def test_verdicts_are_those_of_the_rules(spark):
    """``kept`` from the conditional expression, and from reading the ordered rules row by row."""
    texts, labels = labelled(spark)
    learned = rules.learn(texts, labels)
    assert learned and learned == rules.learn(texts.repartition(7), labels)
    measured = {r.doc_id: r.asDict() for r in rules.features(texts, "doc_id").collect()}
    for r in rules.quality_rules(texts, labels).collect():
        row, spoke = measured[r.doc_id], None
        for k, rule in enumerate(learned):
            values = [row[t.name] if t.name in row else row[rules.SHARES[t.name][0]] / row[rules.SHARES[t.name][1]] if row[rules.SHARES[t.name][1]] else 0.0 for t in rule]
            if all((v >= t.threshold) == t.above for v, t in zip(values, rule, strict=True)):
                spoke = k
                break
        base = row["n_words"] < 10 or 100 * row["n_repeat_words"] > 20 * row["n_words"]
        assert (r.base_failed, r.kept, r.rule) == (base, not base and spoke is None, spoke)


def labelled(spark):
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        t = prose(30)
        rows.append((k, t + (" you 1d10t and ѕcum" if k % 8 == 0 else " you idiot, scum") if bad else t + (" clown fish" if k % 3 == 0 else ""), int(not k % 5 == 1), int(bad)))
    rows = [(k, t if q else " ".join(w + "***" for w in t.split()), q, b) for k, t, q, b in rows]
    docs = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, q, b) for k, _, q, b in rows], "doc_id long, quality int, toxic int")


def test_learned(spark, docs):
    texts, labels = labelled(spark)
    for found, column in ((toxicity.toxicity(texts, labels), "toxic"), (classifier.quality(texts, labels), "quality")):
        rows = found.join(labels, "doc_id").filter("held_out").collect()
        assert len(rows) > 40 and np.mean([r.predicted == r[column] for r in rows]) > 0.97
        assert all(0 <= r.score <= 1 for r in rows)
    judged = rules.quality_rules(texts, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged if not r.base_failed]) > 0.97
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 300_000)], "doc_id long, text string")
    for op in (toxicity.toxicity, classifier.quality, rules.quality_rules):
        assert op(odd, labels).count() == 4
        assert op(odd.limit(0), labels.limit(0)).count() == 0
    assert classifier.quality(odd, labels.limit(0)).first().score == 0.5


def test_long_words_are_pooled_whole():
    import pyarrow as pa

    head, pool = "a1" * 20, classifier.Pooler({}).pool
    assert "".join(classifier.forms(head + "Ab-.")) == "x9" * 20 + "Xx-." and classifier.forms("Don't!!") == ["Xx'x!"]
    form = slice(classifier.DIM, 2 * classifier.DIM)
    same, other = (pool(pa.array([head + tail]))[0] for tail in ("b2-C.,c" * 40, "B!?b.-d" * 40))
    assert np.abs(same[form] - other[form]).max() > 0.1
    vectors = [classifier.index_vector(classifier.FORM + u) for w in ("ab", "ab", head) for u in classifier.forms(w)]
    assert np.allclose(pool(pa.array(["ab ab " + head]))[0][form], np.mean(vectors, axis=0), atol=1e-5)
    words = {"ab": np.ones(classifier.DIM, np.float32), "cd": np.full(classifier.DIM, 4, np.float32)}
    assert np.allclose(classifier.Pooler(words).pool(pa.array(["ab ab cd xy", None]))[:, 0], [6 / 4, 0])


def test_empty_and_odd_tables(spark):
    none = frame(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = frame(spark, [(None, "some text here for nobody"), (None, None), (3, "twin"), (3, "twin"), (4, "x" * 5000)])
    items = spark.createDataFrame([(1, "twin"), (None, "twin")], "item_id long, text string")
    for rows, n in ((none, 0), (odd, 5)):
        assert sharding.shard_by_bytes(rows).count() == n and packing.pack(rows, path).count() == n
        assert lines.dedup_lines(rows, bits=1 << 16).count() == n and simhash.near_groups(rows).count() == n
        assert substrings.remove_repeats(rows, bits=1 << 16).count() == n and tokens.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")).count() == n
        assert decontamination.leaks(rows, items).count() == (n > 0)


def test_fold_is_the_driver_rule(spark):
    rows = spark.range(200)
    for r in rows.select("id", held_out(rows.id).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0)
