import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from scrivora.operators import index as ix
from scrivora.operators import search as se
from scrivora.operators.factors import Factors, gram_matrix, latent_neighbours, power_factors, residuals
from scrivora.operators.skew import hot_keys, join_salted
from scrivora.plans import queries
from scrivora.session import materialize

DOCS = [(1, "Cats chase mice."), (2, "The cat sleeps; cats sleep."), (3, "Mice eat corn, corn, corn!"), (4, "?? 42 a")]


@pytest.fixture(scope="module")
def docs(table):
    # Extra columns with names the operators use themselves.
    return table([(i, f"t{i}", f"u{i}", t, "x", 1.0) for i, t in DOCS], "id long, title string, url string, text string, term string, weight double")


@pytest.fixture(scope="module")
def index(docs, table):
    return ix.TextIndex.build(docs, table([("the",)], "word string"))


def top(df):
    return [(r["id"], round(r["score"], 6)) for r in df.collect()]


def test_index(index):
    assert rows(index.terms.select("term", "df")) == [("cat", 2), ("chase", 1), ("corn", 1), ("eat", 1), ("mice", 2), ("sleep", 1)]
    got = {(r["id"], r["term"]): round(r["weight"], 6) for r in index.postings.collect()}
    assert got == {(1, "cat"): 0.408248, (1, "chase"): 0.816497, (1, "mice"): 0.408248, (2, "cat"): 0.447214, (2, "sleep"): 0.894427, (3, "mice"): 0.156174, (3, "eat"): 0.312348, (3, "corn"): 0.937043}
    assert tuple(index.stats().head())[:2] == (4, 6)


@pytest.mark.parametrize(
    "query, mode, expected",
    [
        ("cat mice", "raw", [(1, 0.57735), (2, 0.316228), (3, 0.110432), (4, 0.0)]),
        ("cats mice", "raw", [(1, 0.408248), (3, 0.156174), (2, 0.0), (4, 0.0)]),
        ("cats mice", "stemmed", [(1, 0.57735), (2, 0.316228), (3, 0.110432), (4, 0.0)]),
        ("cat corn corn", "raw", [(3, 0.909065), (2, 0.108465), (1, 0.099015), (4, 0.0)]),
        ("science", "raw", [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]),
    ],
)
def test_search(index, query, mode, expected):
    assert top(se.search(index, query, mode=mode)) == expected
    assert sorted(top(se._top_by_joins(index, query, 10, mode, False))) == sorted(expected)


def test_search_limits_and_errors(index):
    assert top(se.search(index, "cat", limit=0)) == []
    assert len(top(se.search(index, "cat", limit=2))) == 2
    for bad in (dict(text=" "), dict(text="a", method=9), dict(text="a", method=3)):
        with pytest.raises(ValueError):
            se.search(index, **bad)


def test_batch(index, table):
    queries = table([(1, "cat mice", 2), (2, None, 5), (3, "corn", None), (4, " ", 1)], "query_id long, query string, row_limit int")
    got = [(r["query_id"], r["rank"], r["id"]) for r in se.top_documents_batch(index, queries).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 2, 2), (3, 1, 3)]


def test_mean_normalized(spark, table):
    got = se.mean_normalized(table([(1, 5.0), (1, 3.0), (1, 1.0), (2, 0.0)], "query_id int, score double"))
    assert rows(got.select("query_id", "relative_score")) == [(1, 0.333333), (1, 1.0), (1, 1.666667), (2, None)]


def test_mean_normalized_published_scores(table):
    # Two queries' best five scores without and with idf, each divided by their mean.
    scores = [(2, s) for s in (99.0, 86.0, 84.0, 73.0, 72.0)] + [(4, s) for s in (0.8091, 0.8004, 0.4201, 0.2770, 0.2167)]
    got = rows(se.mean_normalized(table(scores, "query_id int, score double")))
    assert [r for _, _, r in got if r is not None][:5] == [round(s / 82.8, 6) for s in (72.0, 73.0, 84.0, 86.0, 99.0)]
    assert sum(r for q, _, r in got if q == 4) == pytest.approx(5.0, abs=1e-5)


def test_document_and_cards(index):
    assert tuple(index.document(3).head())[:4] == (0.0, "t3", "u3", 3)
    assert index.document(99).count() == 0
    assert ix.cards(se.search(index, "corn", limit=1)).head()["score"] == "0.9370"


def test_empty_and_null_texts(spark, table):
    schema = "id long, title string, url string, text string"
    empty = ix.TextIndex.build(table([], schema))
    assert tuple(empty.stats().head())[:2] == (0, 0) and top(se.search(empty, "cat")) == []
    nulls = ix.TextIndex.build(table([(1, None, None, None), (2, None, None, ""), (3, None, None, "word " * 20_000)], schema))
    assert top(se.search(nulls, "word")) == [(3, 1.0), (1, 0.0), (2, 0.0)]


def test_save_load(index, spark, tmp_path):
    again = ix.TextIndex.load_or_build(spark, str(tmp_path / "i"), index.documents)
    assert [i for i, s in top(se.search(again, "cat")) if s] == [1, 2]
    assert ix.TextIndex.load_or_build(spark, str(tmp_path / "i"), index.documents.limit(0)).stats().head()[0] == 4


def test_relative_and_raw(docs):
    relative = ix.relative_frequencies(docs)
    assert {round(r[0], 9) for r in relative.groupBy("id").agg(F.sum("tf")).select("sum(tf)").collect()} == {1.0}
    raw = ix.TextIndex.build(docs, weighting="tf")
    assert top(se.top_documents(raw, "corn corn cat", raw=True))[0] == (3, 6.0)


def dense(index):
    cells = index.postings.collect()
    terms = sorted({r["term"] for r in cells})
    ids = sorted({r["id"] for r in cells})
    a = np.zeros((len(terms), len(ids)))
    for r in cells:
        a[terms.index(r["term"]), ids.index(r["id"])] = r["weight"]
    return a, terms, ids


def test_factors(index, docs, spark, tmp_path):
    a, terms, ids = dense(index)
    factors = Factors.fit(index.postings, k=3)
    assert np.allclose(factors.sigma, np.linalg.svd(a, compute_uv=False)[:3], atol=1e-8)
    u, v = gathered(factors, terms, ids)
    assert np.allclose(u.T @ u, np.eye(factors.rank), atol=1e-8) and np.allclose(u @ v.T, a, atol=1e-8)
    # At full rank the low-rank matrix is the matrix, and both latent methods agree.
    got = {(r["id"], r["term"]): r["weight"] for r in factors.low_rank_matrix(docs.select("id")).collect()}
    assert all(abs(got[ids[j], terms[i]] - a[i, j]) < 1e-5 for i, j in zip(*np.nonzero(a > 1e-6)))
    best = rows(factors.strongest_terms(docs.select("id"), limit=1).select("id", "term"))
    assert best[1:] == [(2, "sleep"), (3, "corn")]
    assert top(factors.search(index, "cat mice")) == top(factors.search(index, "cat mice", k=9))
    assert top(factors.search(index, "zzz")) == [(1, 0), (2, 0), (3, 0), (4, 0)] and top(factors.search(index, "zzz", k=2)) == []
    factors.save(str(tmp_path / "f"))
    assert np.allclose(Factors.load(spark, str(tmp_path / "f")).sigma, factors.sigma)


def gathered(factors, terms, ids):
    at, place = {t: i for i, t in enumerate(terms)}, {d: j for j, d in enumerate(ids)}
    u, v = np.zeros((len(terms), factors.rank)), np.zeros((len(ids), factors.rank))
    for r in factors.terms.collect():
        u[at[r["term"]]] = r["u"]
    for r in factors.documents.collect():
        v[place[r["id"]]] = r["v"]
    return u, v


def test_ranks_are_cut_from_one_factorisation(index, spark, tmp_path):
    path = str(tmp_path / "ranks")
    index.save(path)
    Factors.load_or_build(index.postings, path, 2, (1, 3))
    assert sorted(x for x in os.listdir(path) if x.startswith("svd")) == ["svd_k=1", "svd_k=3"]
    assert Factors.load_or_build(index.postings.limit(0), path, 1, (1, 3)).rank == 1
    assert all(len(r["v"]) == 1 for r in spark.read.parquet(f"{path}/svd_k=1/documents").collect())


def reference_matrix(table, n_docs, n_terms, seed):
    rng = np.random.default_rng(seed)
    # A slowly falling spectrum, the hard case.
    a = np.where(rng.random((n_terms, n_docs)) < 0.05, rng.random((n_terms, n_docs)), 0)
    i, j = np.nonzero(a)
    return a, table([(int(d), f"t{t}", float(a[t, d])) for t, d in zip(i, j)], "id long, term string, weight double")


@pytest.mark.parametrize("oversampling", [4, 40, 500])
def test_factors_converge(table, oversampling):
    a, postings = reference_matrix(table, 150, 220, 1)
    exact = np.linalg.svd(a, compute_uv=False)[:8]
    factors = Factors.fit(postings, k=8, oversampling=oversampling)
    assert np.abs(factors.sigma / exact - 1).max() < 1e-10
    assert all(left < 1e-6 and right < 1e-6 for _, left, right in residuals(factors, postings))


def test_factors_of_a_matrix_of_low_rank(table):
    """Five different columns, each many times, and values that fall by a thousand: fewer triplets than asked for."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.standard_normal((30, 5)))[0], np.linalg.qr(rng.standard_normal((40, 5)))[0]
    sigma = np.array([100.0, 50.0, 7.0, 1.0, 0.1])
    a = (u * sigma) @ v.T
    postings = table([(j, f"t{i}", float(a[i, j])) for i in range(30) for j in range(40)], "id long, term string, weight double")
    assert np.allclose(Factors.fit(postings, k=9).sigma[:5], sigma, rtol=1e-7) and len(Factors.fit(postings, k=9).sigma) < 9
    assert np.allclose(Factors.fit(postings, k=2, oversampling=1).sigma, sigma[:2], rtol=1e-9)


def test_factors_say_when_they_do_not_converge(table):
    with pytest.raises(ValueError, match="convergence"):
        Factors.fit(reference_matrix(table, 150, 220, 1)[1], k=8, oversampling=2, most_products=2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_factors_of_the_test_data(spark):
    """Values, residuals and the ten best rows of both latent searches against a dense decomposition."""
    full = queries._index(spark, "/root/testdata/sf0.01")
    full.postings = materialize(full.postings, "postings")
    cells = full.postings.toPandas()
    terms, ids = sorted(set(cells["term"])), sorted(set(cells["id"]))
    a = np.zeros((len(terms), len(ids)))
    at = {t: i for i, t in enumerate(terms)}
    np.add.at(a, ([at[t] for t in cells["term"]], np.searchsorted(ids, cells["id"])), cells["weight"])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    factors = Factors.fit(full.postings, 25)
    assert np.abs(factors.sigma / s[:25] - 1).max() < 1e-6
    assert max(max(x[1:]) for x in residuals(factors, full.postings)) < 1e-6
    asked = {r["term"]: r["weight"] for r in se.query_vectors(se.one_query(full, queries.PLAIN), full.terms).collect()}
    q = np.zeros(len(terms))
    for t, w in asked.items():
        q[at[t]] = w
    every = sorted(r["id"] for r in full.documents.select("id").collect())
    for k, method in ((25, None), (10, 10)):
        fold, docs = u[:, :k].T @ q, s[:k, None] * vt[:k]
        score = dict(zip(ids, np.round(fold @ docs / np.linalg.norm(fold) / np.linalg.norm(docs, axis=0), 6)))
        expected = sorted(((float(score.get(d, 0.0)), d) for d in every), key=lambda x: (-x[0], x[1]))[:10]
        assert [(r["score"], r["id"]) for r in factors.search(full, queries.PLAIN, k=method).collect()] == expected


def test_power_factors(index, table):
    a, *_ = dense(index)
    exact = np.linalg.svd(a, compute_uv=False)
    found = power_factors(index.postings, 3, iterations=30)
    assert np.allclose([s for s, _, _ in found], exact[:3], atol=5e-2)
    a = np.array([[4.0, 0.5], [0.5, 1.0]])
    postings = table([(j, f"t{i}", float(a[i, j])) for i in range(2) for j in range(2)], "id long, term string, weight double")
    assert np.allclose([s for s, _, _ in power_factors(postings, 2, iterations=8)], np.linalg.svd(a, compute_uv=False), atol=1e-5)
    assert len(power_factors(postings.where("term = 't0'"), 2, iterations=5)) == 1


def test_gram_matrix(index):
    a, _, ids = dense(index)
    got = {(r["i"], r["j"]): r["value"] for r in gram_matrix(index.postings, index.documents.where("id < 4")).collect()}
    g = a.T @ a
    assert all(abs(got.get((x, y), 0.0) - g[i, j]) < 1e-9 for i, x in enumerate(ids) for j, y in enumerate(ids))


def test_salted_join(table):
    many = table([(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "id long, term string")
    counts = many.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "term", "n", 100)
    assert [tuple(r) for r in hot.collect()] == [("hot", 6)] and hot_keys(counts, "term", "n", 1000) is None
    other = table([("hot", 1), ("hot", 2), ("k3", 3), ("zzz", 4)], "term string, x int")
    assert rows(join_salted(many, other, "term", hot)) == rows(join_salted(many, other, "term", None))


def test_batch_with_a_hot_query(index, table):
    asked = table([(i, "Mice  cat" if i % 2 else "cat mice", 1 + i % 2) for i in range(60)] + [(99, "corn", 1)], "query_id long, query string, row_limit int")
    got = se.top_documents_batch(index, asked, hot_rows=10)
    assert got.where("query_id < 60 and rank = 1 and id = 1").count() == 60 and got.where("rank = 2").count() == 30
    assert rows(got) == rows(se.top_documents_batch(index, asked))


def test_order_of_results(index):
    factors = Factors.fit(index.postings, k=3)
    for found in (factors.search(index, "mice corn"), factors.search(index, "mice corn", limit=5000), se.top_documents(index, "mice corn", limit=5000)):
        got = top(found)
        assert got == sorted(got, key=lambda r: (-r[1], r[0])) and len(got) == 4


def test_factors_of_nothing(index):
    with pytest.raises(ValueError):
        Factors.fit(index.postings.limit(0))


def test_latent_neighbours(spark, table):
    vectors = table([(1, [1.0, 0.0, 9.0]), (1, [1.0, 0.0, 9.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [0.0, 0.0, 1.0])], "doc_pos long, docs_ser array<double>")
    assert [tuple(r) for r in latent_neighbours(vectors, [1.0, 0.0, 0.0], 2, 9).collect()] == [(1, 1.0), (2, 0.0), (6, 0.0)]


def test_strongest_terms_do_not_write_the_matrix(spark, table, monkeypatch):
    """The list is that of the whole matrix, ties and small entries included, from few rows of each block."""
    rng = np.random.default_rng(3)
    u = rng.standard_normal((3000, 3)) * 10.0 ** rng.integers(-12, 1, (3000, 1))
    v = rng.standard_normal((30, 3)) * 10.0 ** rng.integers(-3, 1, (30, 1))
    u[:40] = u[40]
    u /= np.linalg.norm(u, axis=0)
    v[0] = 0
    terms = materialize(table([(f"t{i:04}", [float(x) for x in r]) for i, r in enumerate(u)], "term string, u array<double>"), "terms")
    documents = materialize(table([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>"), "documents")
    found = Factors(np.ones(3), terms, documents)
    whole = found.low_rank_matrix(documents.where("id < 20")).toPandas()
    expected = {}
    for i, some in whole.groupby("id"):
        some = sorted(zip(some["term"], some["weight"]), key=lambda r: (-abs(r[1]), r[0]))[:20]
        expected |= {(i, t): w for t, w in some}
    from scrivora.operators import factors as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    got = {(r["id"], r["term"]): r["weight"] for r in found.strongest_terms(documents.where("id < 20")).collect()}
    assert got == expected and len({i for i, _ in got}) == 19
    assert written[-1].count() < len(whole) / 10


def test_factors_multiply_few_columns(table, monkeypatch):
    """A product takes as many columns as there are wanted values, not the oversampled block; values that occur often are all found."""
    from scrivora.operators.blocks import BlockedMatrix

    a, postings = reference_matrix(table, 150, 220, 1)
    widths, multiply = [], BlockedMatrix.multiply
    monkeypatch.setattr(BlockedMatrix, "multiply", lambda self, state, width, *more: widths.append(width) or multiply(self, state, width, *more))
    assert np.allclose(Factors.fit(postings, k=8, oversampling=40).sigma, np.linalg.svd(a, compute_uv=False)[:8], rtol=1e-10)
    assert max(widths) == 8 and sum(widths) < 240
    same = table([(j, f"t{j}", 2.0 if j < 6 else 1.0) for j in range(40)], "id long, term string, weight double")
    assert np.allclose(Factors.fit(same, k=8).sigma, [2.0] * 6 + [1.0] * 2, rtol=1e-10)


def test_residuals_send_sums_not_postings(table, monkeypatch):
    """Residuals of any vectors, also where documents or terms have no postings or no vector, from one sum per bucket and term."""
    from scrivora.operators import factors as module

    a, postings = reference_matrix(table, 150, 220, 1)
    rng = np.random.default_rng(4)
    u, v, sigma = rng.standard_normal((221, 3)), rng.standard_normal((151, 3)), np.array([3.0, 2.0, 1.0])
    a, u[5], v[7] = np.pad(a, ((0, 1), (0, 1))), 0, 0
    terms = table([(f"t{i}", [float(x) for x in r]) for i, r in enumerate(u) if i != 5], "term string, u array<double>")
    documents = table([(i, [float(x) for x in r]) for i, r in enumerate(v) if i != 7], "id long, v array<double>")
    written = []
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append((name, materialize(df, name))) or written[-1][1])
    monkeypatch.setattr(module, "release", lambda *tables: None)
    got = residuals(Factors(sigma, terms, documents), postings)
    left, right = np.linalg.norm(a @ v - u * sigma**2, axis=0) / sigma**2, np.linalg.norm(a.T @ u - v, axis=0) / sigma
    assert [i for i, _, _ in got] == [0, 1, 2]
    assert np.allclose([x[1:] for x in got], np.stack([left, right], axis=1), rtol=1e-12)
    sums = dict(written)["residuals"]
    assert sums.where("term is not null").groupBy("term").count().agg(F.max("count")).head()[0] <= sums.where("term is null").count()
    assert sums.count() < postings.count()


def test_products_of_columns_are_made_by_task(table):
    """Not by one expression for each pair of columns."""
    x = np.random.default_rng(5).standard_normal((300, 25))
    vectors, scale = table([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, v array<double>"), [float(i + 1) for i in range(25)]
    found = queries._products(vectors, "v", scale)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sum(") == 1
    got = {(r["i"], r["j"]): r["product"] for r in found.collect()}
    expected = (x / scale).T @ (x / scale)
    assert len(got) == 625 and max(abs(got[i, j] - expected[i, j]) for i in range(25) for j in range(25)) < 1e-6


def test_tokens_are_counted_without_a_shuffle(table):
    texts = [(1, "Cat cat, the-MICE x yy zzz1 É catéabc"), (2, None), (3, ""), (4, "  \n\t9999 ab"), (2, "again again"), (1, "cat")]
    articles = table(texts, "id long, text string")
    counts = ix.token_counts(articles)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert rows(counts.groupBy("id", "token").agg(F.sum("n"))) == rows(ix.tokens(articles).groupBy("id", "token").count())
