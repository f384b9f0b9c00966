"""Whitening, the Merkle manifest and token files against brute force, on small tables with nulls, ties, odd vectors and repeated rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docsieve.llm import binary, merkle, whitening

VECTORS = "vec_id long, embedding array<float>, label int, code string, dim int, n long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, branch string, rank long, n long, path string"


# Whitening


def vectors(rows=400, dim=12, seed=1):
    r = np.random.default_rng(seed)
    mix = r.standard_normal((dim, dim)) * (1 + np.arange(dim))
    out = [(k, (r.standard_normal(dim) @ mix).astype(np.float32).tolist()) for k in range(rows)]
    hot = out[0][1]
    out += [(rows + k, hot) for k in range(rows // 2)] + [(None, out[1][1]), (7, out[2][1])]  # copies, a null and a repeated id
    odd = [None, [], [1.0] * (dim - 1) + [None], [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [1.0] * (dim + 1), [1e30] * dim]
    return out + [(10_000 + k, v) for k, v in enumerate(odd)], {10_000 + k for k in range(len(odd))}


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS).repartition(5)


def test_whitening(spark):
    rows, odd = vectors()
    found = whitening.whiten(vector_frame(spark, rows)).collect()
    kept = [(i, v) for i, v in rows if i not in odd]
    grid = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(grid)), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes.T[::-1]
    want = {}
    for (i, _), x in zip(kept, grid, strict=True):
        want.setdefault(i, []).append((sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), (np.array(x) - sums / n)))
    sign = {}
    assert len(found) == len(kept) * 12 and {r.n for r in found} == {n}
    for r in found:
        k = r.component - 1
        assert any(r.deviation == d for d, _ in want[r.vec_id])
        value = [float(z @ axes[k] / np.sqrt(e[k])) for d, z in want[r.vec_id] if d == r.deviation][0]
        if abs(value) > 1e-6:
            assert sign.setdefault(k, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
        assert math.isclose(abs(value), abs(r.whitened), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.explained, e[k] / e.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_of_few_and_no_vectors(spark):
    few = whitening.whiten(vector_frame(spark, [(k, [float(k % 3), 1.0, 2.0 * (k % 3), 5.0]) for k in range(9)])).collect()
    assert {r.component for r in few} == {1} and len(few) == 9 and all(math.isclose(r.explained, 1.0) for r in few)
    assert not whitening.whiten(vector_frame(spark, [(k, [1.0, 2.0]) for k in range(5)])).collect()  # no variance at all
    assert not whitening.whiten(vector_frame(spark, [(1, None), (2, [math.nan])])).collect()
    assert whitening.whiten(vector_frame(spark, [(1, [1.0])]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_codes_and_exact_deviations():
    rows = np.array([[1, -2], [40_000, 0], [1 << 40, -(1 << 61)], [-32_767, 32_767]], np.int64)
    codes = whitening.encoded(rows)
    assert [c[0] for c in codes] == [2, 4, 8, 2] and (whitening.decoded(codes, 2) == rows).all()
    n, sums = 5, rows.sum(axis=0).tolist()
    assert whitening.deviations(rows[:2], n, [3, 4]) == [sum((n * x - s) ** 2 for x, s in zip(r, (3, 4), strict=True)) for r in rows[:2].tolist()]
    assert whitening.deviations(rows, n, sums)[2] is None  # beyond 64 bits


@pytest.mark.parametrize("values", [[5.0] * 4 + [1.0] * 6, [3.0], [9.0, 9.0 + 1e-9, 9.0 - 1e-9, 1.0], list(1e4 * (1 + 1e-7 * np.arange(30))), [0.0] * 3, list(np.arange(40.0) // 2)])
def test_spectrum(values):
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(e) == min(16, sum(x > 1e-9 for x in values))
    assert np.allclose(e, want[: len(e)], rtol=1e-12) and np.allclose(v @ v.T, np.eye(len(e)), atol=1e-12) and np.allclose(v @ a, e[:, None] * v, atol=1e-9 * (1 + max(values)))
    for shift in (0.3, 4.7, 1e4 + 1e-4):
        f = whitening.Factor(a, shift, 1e-300)
        assert f.positive == (np.linalg.eigvalsh(a) > shift).sum() and np.allclose((a - shift * np.eye(len(a))) @ f.solve(np.ones(len(a))), 1)


# Merkle manifest


def prose_docs(seed=3):
    r = random.Random(seed)
    rows = [(k, r.choice([None, "", "one\ntwo", "x" * 50, "é\n\n日本"]) if r.random() < 0.5 else f"text {r.random()}\nline", r.choice(["en", None]), r.choice(["b", "a", "ä", "", None, "hot", "hot", "hot", "hot"]), r.choice([None, 5, k])) for k in range(120)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, None, None, None, None), (5, "again\n", "en", "hot", 1), (5, "again\n", "en", "hot", 1), (2**60 + 1, "big", "en", "hot", 3), (1, "alone\n", "fr", "zz", 2)]
    return rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Root and, for each leaf, its steps as (siblings before, siblings after)."""
    proofs, where, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at - at % 3 : at - at % 3 + 3]
            proofs[k].append((run[: at % 3], run[at % 3 + 1 :]))
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        where = [at // 3 for at in where]
    return level[0], proofs


def brute_manifest(rows):
    def leaf(i, t, lang, source, n):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, t)))

    by = {}
    for i, t, lang, source, n in rows:
        cut = t.replace("\n", "") if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by.setdefault(source, []).append((i, leaf(i, t, lang, source, n), leaf(i, cut, lang, source, n)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in by[s]])
    root, tops = brute_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, own, shown), steps in zip(by[s], trees[s][1], strict=True):
            folded = shown
            for before, after in steps + top:
                folded = h(*before, folded, *after)
            out.append((i, own, trees[s][0], root, h(*(x for b, a in steps + top for x in b + a)), folded, folded == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest(spark, depth):
    rows = prose_docs()
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS).repartition(6)
    found = merkle.manifest(docs, merkle.without_newlines(), depth).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_manifest(rows)))
    assert {r.verified for r in found} == {True, False}
    assert all(r.verified for r in merkle.manifest(docs, depth=depth).collect())


def test_manifest_of_one_row_and_none(spark):
    docs = spark.createDataFrame([(4, None, None, None, None, "x", 1, 2, "y")], DOCS)
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:4", "-", "-", "-", "-") and row.proof_sha256 == h() and row.verified
    assert not merkle.manifest(docs.limit(0)).collect()


# Token files


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = [None, "", " \n", "One two. Three, <|endoftext|> four", "word " * 3000, "Ünïcödé 日本 text"] + [" ".join(r.choice(["alpha", "beta,", "Gamma.", "x1"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = [(k * 7 % 65, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (2**60, "big")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "b", 1, 2, "p") for i, t in rows], DOCS).repartition(4)
    folder = str(tmp_path / "ids")
    files = binary.write_ids(docs, path, folder).collect()
    found = binary.read_ids(spark, folder, keep_ids=True, span=7).collect()
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, len((x[1] or "").encode()), zlib.crc32((x[1] or "").encode())))
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows]
    want, start = [], 0
    for i, data in ids:
        want.append((i, start, len(data) // 4, zlib.crc32(data), data))
        start += len(data) // 4
    assert sorted(found, key=lambda x: x.start) == want
    assert sum(f.n_tokens for f in files) == start and {f.width for f in files} == {2}
    # The files are flat numbers: all ids in a row are the files one after the other.
    flat = np.concatenate([np.fromfile(f"{folder}/{f['name']}.ids", "<u2") for f in sorted(files)])
    assert flat.astype("<u4").tobytes() == b"".join(d for _, d in ids)
    assert sorted(map(tuple, binary.token_files(docs, path).collect()), key=lambda x: x[1]) == [w[:4] for w in want]


def test_token_files_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert not binary.token_files(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
