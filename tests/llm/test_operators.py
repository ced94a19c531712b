"""Training-data operators against brute force on small tables, with the defined edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivora.llm.contamination import LeakSearch, least_matches
from scrivora.llm.distinctiveness import term_distinctiveness
from scrivora.llm.format_duplicates import FormatDuplicates
from scrivora.llm.language import LanguageIdentification, LanguageModels, _sums, paragraph_bits
from scrivora.llm.mixing import SourceMix, allot, sainte_lague
from scrivora.llm.residue import residue, template_residue
from scrivora.llm.similar_vectors import VectorIndex
from scrivora.llm.splitting import split, split_long
from scrivora.llm.term_frequency import mark_terms, term_frequencies

TEXTS = [
    (1, "Alpha beta beta, gamma!"), (2, "alpha BETA"), (3, None), (4, ""), (5, "?? é a1"), (6, "alpha delta " * 3000), (6, "alpha delta " * 3000), (None, "alpha omega x86"),
]
TEXT_SCHEMA = "id long, text string, term string, df long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(table, data=TEXTS):
    return table([(i, t, "clash", 7) for i, t in data], TEXT_SCHEMA)


def cut(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]{3,}", text or "")]


# Duplicates hidden by formatting

COPIES = [
    (5, "A Title", "Some text."), (3, "some TEXT", "a-title"), (9, None, "x"), (8, "", " X! "), (7, "x", None), (6, None, "..."), (4, "other", "Some text."), (5, "A Title", "Some text."), (None, "A title", "some text"),
]


@pytest.mark.parametrize("hot", [10_000, 2, None])
def test_format_duplicates(table, hot):
    df = table([(*r, b"k") for r in COPIES], "id long, title string, text string, key binary")
    found = FormatDuplicates(df, hot_rows=hot)
    assert rows(found.pairs()) == [(3, 5), (8, 9)]
    assert rows(found.groups()) == [(3, 3), (4, 1), (8, 2)]


def test_format_duplicates_hot_group(table):
    df = table([(i, "T", "same text" if i % 3 == 0 else f"text {i}") for i in range(600)], "id long, title string, text string")
    found = FormatDuplicates(df, hot_rows=50)
    assert found.any_hot
    assert rows(found.pairs()) == sorted(((0, i) for i in range(3, 600, 3)), key=repr)
    assert Counter(c for _, c in rows(found.groups())) == {1: 400, 200: 1}
    assert rows(FormatDuplicates(df.limit(0)).pairs()) == []


# Terms


def test_term_frequencies(table):
    occurrences, records = Counter(), Counter()
    for _, t in TEXTS:
        occurrences.update(cut(t))
        records.update(set(cut(t)))
    found = term_frequencies(texts(table))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in found.collect()} == {t: (n, records[t]) for t, n in occurrences.items()}
    marks = {r["term"]: r["mark"] for r in mark_terms(found, len(TEXTS)).collect()}
    assert marks["gamma"] == "rare" and marks["alpha"] == "common"
    assert rows(term_frequencies(texts(table).limit(0))) == []


@pytest.mark.parametrize("shared", [1 << 18, 0, 2])
@pytest.mark.parametrize("plain", [True, False])
def test_distinctiveness(table, shared, plain):
    data = [(i, " ".join(random.Random(i).choices(["aaa", "bbb", "ccc", "ddd", "eee", "rare" + str(i), "w" * 70], k=30))) for i in range(40)] + [(100, None), (101, "")]
    options = dict(k1=math.inf, b=0.0, smooth_idf=False) if plain else {}
    n = len(data)
    tf = {i: Counter(cut(t)) for i, t in data}
    df = Counter(t for c in tf.values() for t in c)
    average = sum(sum(c.values()) for c in tf.values()) / n
    expected = {}
    for i, c in tf.items():
        for t, f in c.items():
            gain = f if plain else f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
            expected[i, t] = round(gain * (math.log(n / df[t]) if plain else math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))), 6)
    got = {(r["id"], r["term"]): r["score"] for r in term_distinctiveness(texts(table, data), max_shared_terms=shared, **options).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 2e-6 for k in got)
    best = defaultdict(list)
    for (i, t), s in expected.items():
        if df[t] >= 2:
            best[i].append((-s, t))
    top = term_distinctiveness(texts(table, data), min_df=2, top_k=2, max_shared_terms=shared, **options)
    assert rows(top.select("id", "term")) == sorted(((i, t) for i, b in best.items() for _, t in sorted(b)[:2]), key=repr)


def test_distinctiveness_of_a_long_hot_term(table):
    data = [(i, "q" * 100 + f" own{i}") for i in range(60)] + [(99, "other words")]
    plain = term_distinctiveness(texts(table, data))
    assert rows(plain) == rows(term_distinctiveness(texts(table, data), hot_rows=10)) and plain.where("length(term) = 100").count() == 60


def test_distinctiveness_edges(table):
    assert rows(term_distinctiveness(texts(table).limit(0))) == []
    found = term_distinctiveness(texts(table), top_k=1)
    assert {r["id"] for r in found.collect()} == {1, 2, 6, None}


# Splitting


@pytest.mark.parametrize("seed", range(12))
def test_split_pieces(seed):
    rng = random.Random(seed)
    words = ["w" * rng.randint(1, 30) + rng.choice(["", "", ".", "!\n", "\n\n"]) for _ in range(400)]
    text = rng.choice([" ", "  ", "\t"]).join(words)
    pieces = split(text, 300, 40)
    assert all(e - b <= 300 and 0 <= r <= 40 for b, e, r, _ in pieces)
    assert "".join(text[b + r : e] for b, e, r, _ in pieces) == text
    assert all(kind != 3 for *_, kind in pieces)
    assert all(b >= before[0] and b + r == before[1] for before, (b, e, r, _) in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("text, forced", [("x" * 300, False), (" " * 1000, False), ("x" * 301 + " y", True), ("a " + "x" * 300 + " " + "y" * 300 + " b", False), ("x" * 299 + " " + "z" * 20, False), ("a. " * 50 + "x" * 700, True)])
def test_split_forced(text, forced):
    pieces = split(text, 300, 40)
    assert any(kind == 3 for *_, kind in pieces) == forced
    assert "".join(text[b + r : e] for b, e, r, _ in pieces) == text and all(e - b <= 300 for b, e, *_ in pieces)


def test_split_is_optimal():
    # A paragraph end near the middle wins over sentence ends nearer to the limit.
    text = "One two three. " * 9 + "\n" + "Four five six. " * 9
    (b, e, _, kind), *_ = split(text, 200, 0)
    assert kind == 0 and text[e - 1] == "\n"


@pytest.mark.parametrize("seed", range(25))
def test_split_is_least_cost_over_all_boundaries(seed):
    """The cost of what is returned is that of a plain search over all paragraph, sentence and word ends."""
    from scrivora.llm import splitting as sp

    rng = random.Random(seed)
    text = "".join("w" * rng.randint(1, 9) + rng.choice([" "] * rng.randint(3, 12) + [". ", "!\n"]) for _ in range(rng.randint(60, 260)))
    limit, overlap = 200, rng.choice([0, 30])
    places, kinds = sp.boundaries(text, limit, True)
    ideal = len(text) / max(1, -(-len(text) // (limit - overlap)))

    def piece(a, b):
        return sp.IMBALANCE * ((b - a) / ideal - 1) ** 2 + (sp.CRAMPED if a > 0 and b - a > limit - overlap else 0)

    best = {0: 0.0}
    for b, kind in list(zip(places.tolist(), kinds.tolist()))[1:]:
        best[b] = min(best[a] + piece(a, b) for a in best if b - a <= limit) + (sp.PENALTY[kind] if b < len(text) else 0)
    got = sum(piece(b + r, e) + (sp.PENALTY[k] if k >= 0 else 0) for b, e, r, k in split(text, limit, overlap))
    assert len(text) <= limit or got == pytest.approx(best[len(text)])


def test_split_long(table):
    df = table([(1, "short", 1), (2, None, 1), (3, "word " * 100_000, 1), (3, "word " * 1000, 1), (4, "", 1), (None, "x" * 5000, 1)], "id long, text string, piece int")
    got = split_long(df)
    assert {r[0] for r in got.select("id").distinct().collect()} == {3, None}
    assert got.where(F.length("piece") > 2000).count() == 0 and got.where("cut = 'forced'").select("id").distinct().head()[0] is None
    assert split_long(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_long(df, limit=10, overlap=10)


# Leaks


def test_leaks(table):
    rng = random.Random(1)
    vocabulary = [f"wört{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(9, 60)))) for i in range(40)] + [(40, None), (41, "")]
    items[7] = (7, items[3][1][:200] + " tail")
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        source = rng.choice(items[:40])[1].split()
        n = rng.choice([8, 11, 12, 13, 40])
        at = rng.randint(0, max(0, len(source) - n))
        words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper()))
    docs += [(200, None), (201, ""), (None, items[5][1]), (0, docs[0][1])]

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    expected = {(d, i) for d, t in docs for i, x in items if d is not None and grams(t) & grams(x)}
    search = LeakSearch(table([(*r, 1) for r in items], "item_id long, text string, doc_id int"))
    corpus = table([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    got = search.search(corpus)
    assert expected and {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected and got.count() == len(expected)
    assert search.search(corpus.limit(0)).count() == 0
    assert LeakSearch(table([], "item_id long, text string")).search(corpus).count() == 0


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("options", [{}, {"most_bits": 1 << 9}, {"hot_rows": 3}])
def test_leaks_with_changed_words(table, options):
    """Every eleventh word is another one: no passage of twelve words is left, but over half of the shingles are."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    opening = " ".join(rng.choices(vocabulary, k=14))
    items = [(i, (opening + " " if i % 3 == 0 else "") + " ".join(rng.choices(vocabulary, k=rng.choice([20, 50, 300])))) for i in range(30)]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 300))
        if d % 2:
            leaked = items[d // 2][1].split()
            leaked[10::11] = [f"x{d}{i}" for i in range(len(leaked[10::11]))]
            words[len(words) // 2 : len(words) // 2] = leaked
        docs.append((d, " ".join(words + (opening.split() if d % 5 == 0 else []))))
    search = LeakSearch(table(items, "item_id long, text string"), least=0.5, **options)
    assert (search.filter is None) == ("most_bits" in options)
    expected = {(d, i): len(shingles(t) & shingles(x)) / len(shingles(x)) for d, t in docs for i, x in items}
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in search.search(table(docs, "doc_id long, text string")).collect()}
    assert got.keys() == {k for k, c in expected.items() if c >= 0.5} and len(got) >= 30
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    parts = {r["part"]: r for r in search.partitions().collect()}
    assert {4, 5, 8} <= set(parts) and parts[8]["least_share"] < 0.5 <= parts[5]["least_share"]
    # The passages themselves are gone, but for the shared opening.
    exact = LeakSearch(table(items, "item_id long, text string"), **options).search(table(docs, "doc_id long, text string"))
    assert {r["item_id"] % 3 for r in exact.collect()} == {0}


def test_shared_openings_are_no_keys(table):
    opening = " ".join(f"o{i}" for i in range(11))
    items = table([(i, f"{opening} " + " ".join(f"t{i}x{j}" for j in range(20))) for i in range(200)], "item_id long, text string")
    search = LeakSearch(items)
    # Seven shingles of the opening and four that reach into each item's own words.
    assert search.index.groupBy("h").count().agg(F.max("count")).head()[0] == 1
    docs = table([(d, opening + (" t5x0" if d == 7 else f" d{d}") + " and more") for d in range(90)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in search.search(docs).collect()] == [(7, 5)]


def test_leaks_of_repeated_words(table):
    items = table([(1, "a " * 40), (2, "b c " * 20), (3, "one two three " * 4)], "item_id long, text string")
    docs = table([(1, "x " * 9 + "a " * 12), (2, "a " * 11), (3, "z b" + " c b" * 6), (4, "two three one " * 4)], "doc_id long, text string")
    assert rows(LeakSearch(items).search(docs).select("doc_id", "item_id")) == [(1, 1), (3, 2)]


def test_least_matches():
    assert least_matches(64, 0.5) == 32 and least_matches(10, 0.05) == 1 and least_matches(4, 1.0) == 4
    assert 10 <= least_matches(1000, 0.5) < 20 and least_matches(100_000, 0.01) == 1 and least_matches(1000, 1.0) == 64


# Mixing


def plain_sainte_lague(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        out[max(open_, key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    weights = [rng.choice([0, 1, 2, 3, rng.random() * 9]) for _ in range(rng.randint(1, 12))]
    caps = [rng.randint(0, 40) for _ in weights]
    seats = rng.randint(0, 150)
    assert sainte_lague(np.array(weights), seats, np.array(caps)).tolist() == plain_sainte_lague(weights, seats, caps)


@pytest.mark.parametrize("seed", range(30))
def test_allotment_is_exact(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([0, 1, 5, 63, 64, 65, rng.randint(0, 5000)]) for _ in range(rng.randint(1, 20))]
    rounds, wanted = rng.randint(1, 4), rng.choice([0, 1, sum(tokens), sum(tokens) + 1, rng.randint(0, 5 * sum(tokens) + 9)])
    quota, target = allot(np.array(tokens), wanted, rounds, 64)
    assert target.sum() == min(wanted, rounds * sum(tokens)) and (target >= 0).all() and (target <= rounds * np.array(tokens)).all()
    # Only what a member's last block lacks, and what is carried for it, sets a target apart from its blocks.
    assert np.abs(target - np.minimum(quota * 64, rounds * np.array(tokens))).sum() <= 64 * (len(tokens) + 1)


def mix(table, docs=None):
    rng = random.Random(3)
    docs = docs if docs is not None else [(i, "ab, " * rng.randint(0, 60), rng.choice(["big"] * 8 + ["mid", "mid", "tiny", None, "none"])) for i in range(1500)] + [(2000, None, "mid"), (2001, "", "tiny"), (None, "x y", "big")]
    targets = table([("big", 0.4, 1, 1), ("mid", 0.3, 4, 1), ("tiny", 0.25, 2, 1), ("gone", 0.05, 3, 1)], "source string, target_share double, max_repeats int, tokens int")
    return SourceMix(table([(*d, 1) for d in docs], "doc_id long, text string, source string, copies int"), targets, block_tokens=64)


def test_mix(table):
    m = mix(table)
    report = {r["source"]: r for r in m.report().collect()}
    assert {s: r["fate"] for s, r in report.items()} == {"big": "enough", "mid": "repeat", "tiny": "short", "gone": "short"}
    assert report["gone"]["selected"] == 0 and all(r["most_copies"] <= r["max_repeats"] for r in report.values())
    assert report["tiny"]["selected"] == 2 * report["tiny"]["have"]
    for s in ("big", "mid"):
        assert abs(report[s]["selected"] - report[s]["need"]) < 0.03 * m.total
    assert rows(m.selection()) == rows(mix(table).selection())
    assert m.selection().where("tokens = 0 or source is null").count() == 0


def test_mix_shards_and_empty(table, monkeypatch):
    from scrivora.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    m = mix(table)
    assert m.shards > 5
    assert m.quotas().where("source = 'mid'").count() > 5
    report = {r["source"]: r for r in m.report().collect()}
    assert abs(report["mid"]["selected"] - report["mid"]["need"]) < 0.05 * m.total
    empty = mix(table, [])
    assert {r["fate"] for r in empty.report().collect()} == {"enough"} and empty.selection().count() == 0


@pytest.mark.parametrize("need, repeats, fate, most", [(0.5, 3, "enough", 1), (0.50001, 3, "repeat", 2), (0.50001, 1, "short", 1), (0.50001, None, "short", 1), (0.50001, 0, "short", 1), (1.0, 2, "repeat", 2), (1.00001, 2, "short", 2)])
def test_fate_at_the_boundary(table, need, repeats, fate, most):
    # The source holds exactly half of all tokens.
    docs = table([(i, "a " * 50, "s" if i % 2 else "t") for i in range(40)], "doc_id long, text string, source string")
    report = SourceMix(docs, table([("s", need, repeats)], "source string, target_share double, max_repeats int"), block_tokens=64).report().head()
    assert (report["fate"], report["most_copies"]) == (fate, most)


# Vectors


def brute(data, k):
    unit = {p: np.array(v) / np.linalg.norm(v) for p, v in data.items()}
    out = {}
    for p, a in unit.items():
        best = sorted((-round(float(a @ b), 9), q) for q, b in unit.items() if q != p)
        out[p] = [(q, -s) for s, q in best[:k]]
    return out


def vector_table(table):
    rng = np.random.default_rng(5)
    data, dirty = {}, [(9000, None), (9001, [0.0] * 50), (9002, [float("nan")] + [1.0] * 49), (9003, [1.0] * 49), (None, [1.0] * 50), (9004, [float("inf")] * 50)]
    for i in range(700):
        data[i] = rng.standard_normal(50).tolist()
    for c in range(40):
        centre = rng.standard_normal(50)
        for j in range(6):
            data[1000 + c * 10 + j] = ((centre + 0.1 * rng.standard_normal(50)) * rng.uniform(0.01, 90)).tolist()
    for j in range(300):  # a group of copies that holds a quarter of all rows
        data[3000 + j * 2] = data[1000]
    listed = [(p, v) for p, v in data.items()]
    return data, table([(p, v, 1) for p, v in listed + listed[::9] + dirty], "doc_pos long, docs_ser array<double>, rep int")


def test_vectors(table):
    data, df = vector_table(table)
    index = VectorIndex(df)
    expected = brute(data, 5)
    got = defaultdict(list)
    for r in index.expand(index.neighbours(least=0.9, recall=1.0)).collect():
        got[r["pos"]].append((r["other"], r["cosine"]))
    want = {(p, q) for p, best in expected.items() for q, s in best if s >= 0.9}
    have = {(p, q) for p, best in got.items() for q, _ in best}
    assert len(want & have) >= 0.99 * len(want) and len(have - want) <= 0.01 * len(want)
    queries = table([(p,) for p in (0, 100, 500, 1000, 1003, 3000, 3100, 9000)], "pos long")
    found = defaultdict(set)
    for r in index.search(queries).collect():
        found[r["pos"]].add(r["other"])
    asked = [0, 100, 500, 1000, 1003, 3000, 3100]
    assert set(found) == set(asked)
    assert sum(len(found[p] & {q for q, _ in expected[p]}) for p in asked) >= 0.9 * 5 * len(asked)


def test_vectors_recall_of_all_neighbours(table):
    data, df = vector_table(table)
    expected = brute(data, 5)
    got = {(r["pos"], r["other"]) for r in VectorIndex(df).search(table([(p,) for p in data], "pos long")).collect()}
    want = {(p, q) for p, best in expected.items() for q, _ in best}
    assert len(want & got) >= 0.99 * len(want)


@pytest.mark.parametrize("cell", [512, 50, 5])
def test_recall_of_neighbours_at_any_number_of_cells(table, monkeypatch, cell):
    """Vectors without close neighbours, in 1, 16 and 160 cells, over one task a group and over a grid of tasks."""
    from scrivora.llm import similar_vectors as sv

    monkeypatch.setattr(sv, "CELL", cell)
    monkeypatch.setattr(sv, "GROUP_VECTORS", 200)
    monkeypatch.setattr(sv, "GROUP_QUERIES", 150)
    rng = np.random.default_rng(3)
    data = {i: (rng.standard_normal(50) + 2 * (i % 4 == 0)).tolist() for i in range(800)}
    index = VectorIndex(table(list(data.items()), "doc_pos long, docs_ser array<double>"))
    found = [(r["rep"], r["other"]) for r in index.neighbours().collect()]
    want = {(p, q) for p, best in brute(data, 5).items() for q, _ in best}
    assert len(found) == len(set(found)) <= 4000 and len(want & set(found)) >= 0.9 * len(want)


def test_search_over_a_grid(table, monkeypatch):
    from scrivora.llm import similar_vectors as sv

    data, df = vector_table(table)
    asked = table([(p,) for p in data], "pos long")
    whole = rows(VectorIndex(df).search(asked))
    monkeypatch.setattr(sv, "QUERY_BLOCK", 200)
    monkeypatch.setattr(sv, "GRID_VECTORS", 300)
    grid = rows(VectorIndex(df).search(asked))
    assert [r[:2] for r in grid] == [r[:2] for r in whole]


def test_vectors_empty(table):
    index = VectorIndex(table([], "doc_pos long, docs_ser array<double>"))
    assert index.expand(index.neighbours()).count() == 0
    assert index.search(table([(1,)], "pos long")).count() == 0
    few = VectorIndex(table([(1, [1.0] * 50), (2, [2.0] * 50)], "doc_pos long, docs_ser array<double>"))
    assert rows(few.expand(few.neighbours())) == [(1, 2, 1.0), (2, 1, 1.0)]


# Languages

SAMPLE = {
    "en": "the old bridge near the river was built by every village because another king of this valley had their tower",
    "de": "die alte brücke in der nähe von dem fluss wurde durch jede stadt gebaut weil ein anderer könig sein schloss hatte",
    "es": "el puente viejo cerca del río fue hecho por cada pueblo porque otro rey de este valle tenía su torre según la gente",
}


def language_tables(table):
    rng = random.Random(2)

    def text(lang, n=40):
        return " ".join(rng.choices(SAMPLE[lang].split(), k=n))

    articles, labels, truth = [], [], {}
    for i in range(90):
        lang = rng.choice(list(SAMPLE))
        parts = [text(lang), "", "kurz", text(lang)]
        if i % 9 == 0:
            lang2 = rng.choice([x for x in SAMPLE if x != lang])
            parts.append(text(lang2))
            truth[i, 4] = lang2
        truth[i, 0] = truth[i, 3] = lang
        articles.append((i, "\n".join(parts), 1))
        label = rng.choice([x for x in SAMPLE if x != lang]) if i % 10 == 3 else rng.choice([lang, lang.upper(), f"{lang}-XX"])
        labels.append((i, None if i % 10 == 5 else label))
    articles += [(500, None, 1), (501, "", 1), (502, "ACGT" * 100, 1), (503, "?!" * 90, 1), (0, articles[0][1], 1)]
    labels += labels[:5] + [(501, "und"), (999, "en")]
    return table(articles, "id long, text string, lang int"), table(labels, "id long, lang string"), truth, dict(labels)


def test_languages(table):
    articles, labels, truth, told = language_tables(table)
    found = LanguageIdentification(articles, labels, languages=tuple(SAMPLE))
    got = {(r["id"], r["para_no"]): (r["lang"], r["confidence"]) for r in found.paragraphs().collect()}
    assert {k: v[0] for k, v in got.items()} == truth and all(c > 0.5 for _, c in got.values())
    label = {i: (x or "").lower().split("-")[0] for i, x in told.items()}
    assert rows(found.mislabelled()) == sorted(((i, n, x) for (i, n), x in truth.items() if label.get(i) != x), key=repr)
    whole = {(r["id"], r["para_no"]): r["lang"] for r in found.texts().collect()}
    assert all(whole[i, -1] == truth[i, 0] for i in range(90)) and {k for k in whole if k[1] == 4} == {k for k in truth if k[1] == 4}


def test_languages_empty(table):
    articles, labels, *_ = language_tables(table)
    assert LanguageIdentification(articles.limit(0), labels.limit(0)).paragraphs().count() == 0
    assert LanguageIdentification(articles, labels.limit(0)).paragraphs().count() == 0


FOREIGN = {
    "nl": "de oude brug bij de rivier werd gebouwd door elk dorp omdat een andere koning van dit dal zijn toren had",
    "cs": "starý most u řeky byl postaven každou vesnicí protože jiný král tohoto údolí měl svou věž",
    "pt": "a ponte velha perto do rio foi construída por cada aldeia porque outro rei deste vale tinha a sua torre",
    "code": "def main args for i in range len args print args i if args startswith else sys exit import numpy as np return np zeros shape",
    "junk": "asdf jkl qwer uiop zxcv bnm ghjk fdsa lkjh poiu ytre wqas dfgh jklz xcvb nmqw erty",
}


def test_languages_of_no_model_are_rejected(table):
    articles, labels, *_ = language_tables(table)
    models = LanguageIdentification(articles, labels, languages=tuple(SAMPLE)).models
    rng = random.Random(9)
    known = [(i, " ".join(rng.sample(SAMPLE[lang].split(), 17)), lang) for i, lang in enumerate([*SAMPLE] * 10)]
    # Most of the words decide, though a third are another language's.
    mixed = [(100 + i, " ".join(rng.sample(SAMPLE[lang].split(), 14) + rng.sample(SAMPLE["en" if lang != "en" else "de"].split(), 6)), lang) for i, lang in enumerate([*SAMPLE] * 10)]
    foreign = [(200 + i, text, None) for i, text in enumerate(FOREIGN.values())]
    rows_ = known + mixed + foreign
    got = {r["id"]: r["lang"] for r in paragraph_bits(table([r[:2] for r in rows_], "id long, text string"), models).collect()}
    assert got == {i: lang for i, _, lang in rows_}


def test_confidence_is_calibrated():
    """On short pieces with words that two languages share, the confidence is near the share of right answers."""
    rng = random.Random(5)
    shared = [f"{a}{b}{c}" for a in "bdkt" for b in "aeo" for c in "nrs"]
    vocabulary = {x: rng.choices(shared, k=25) + [f"{p}{w}" for w in shared[:8]] for x, p in (("a", "z"), ("b", "w"))}
    bags = {x: Counter(rng.choices(v, k=3000)) for x, v in vocabulary.items()}
    models = LanguageModels(bags)
    rows_, truth = [], []
    for i in range(4000):
        rows_.append(" ".join(rng.choices(vocabulary["ab"[i % 2]], k=rng.choice([1, 2, 3]))))
        truth.append(i % 2)
    bits, truth = _sums(models, pa.array(rows_))[0], np.array(truth)
    models.calibrate_scale(bits[:2000], truth[:2000])
    for _, n, confidence, right in models.reliability(bits[2000:], truth[2000:]):
        assert n < 100 or abs(confidence - right) < 0.1


def test_kneser_ney_sums_to_one():
    models = LanguageModels({"a": Counter("abba baab abab aab b".split()), "b": Counter("cab bac".split())})
    # Of all one-letter continuations of a word, the alphabet of 256 signs shares one unit of probability.
    base = models.bits(["ab"])[0]
    assert np.isfinite(base).all() and (models.bits(["abba"])[0][0] < models.bits(["cccc"])[0][0])


# Residue


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("The tower of {{city}} was built.", ["placeholder"]),
        ("Dear [your name], the date is <%= date %>.", ["placeholder"]),
        ("Its height is ${height} and %width% wide.", ["placeholder"]),
        ("The tower (TITLE goes here) of the old town stands near its wide river.\nSo @@NAME@@ too, __author__ and ::page::, <<Region>>, {area_km2}, {{{x_y|}}}.", ["placeholder"]),
        ('In such templates a marker like "{{city}}" is later replaced by the value.', []),
        ("Use `{{city}}` here. The set {a, b} costs $41 or 13% [9].", []),
        ("```\n{{ code }}\n```\nThis is how it is done in code.", []),
        ("Name: undefined; City: Rome; undefined was undefined.", ["unfilled_value"]),
        ("Name: #REF!. Area: Rome. #REF! opened #REF!.", ["unfilled_value"]),
        ("At zero the ratio is undefined, and Rome published the null result.", []),
        ("Real words come first.\nLorem ipsum dolor sit amet consectetur adipiscing elit sed do.", ["filler"]),
        ("text text text text text text text text text", ["filler"]),
        ("Your text goes here. Your text goes here.", ["filler"]),
        ('Printers used the words "lorem ipsum dolor" as a sample line long before 1700.', []),
        ("Some Title\nError 404: Not Found. Go back.", ["error_page"]),
        ('The reply "404 Not Found" tells a client how the server understood the request.', []),
        ("Please enable JavaScript to view this page. [a] [b]", ["script_notice"]),
        ("Older pages asked readers to `please enable JavaScript`, a habit that has faded.", []),
        ("The survey found 404 mills; the error of the older map was 9 metres, and access was difficult.", []),
        ("A plain sentence about a river.", []),
        ("", []),
        # Prose that uses the words of messages.
        ("The old station went offline in 1950.", []),
        ("The gateway of the town was built in 1300. It is the oldest gateway.", []),
        ("The king gave permission to build the mill. It was large.", []),
        ("Cookies are baked with butter and sugar. They are sweet.", []),
        ("The church service was interrupted by the war.", []),
        ("The site was moved in 1300. The abbey was lost.", []),
        ("The play's script requires two actors.", []),
        ("JavaScript was created in 1995 and runs in every browser.", []),
        ("The connection between the two towns was lost in 1820.", []),
        ("The network of canals was down to two by 1900.", []),
        # Stand-ins in other wordings, and prose with their words.
        ("Insert your paragraph here.", ["filler"]),
        ("Content will be added soon.", ["filler"]),
        ("Replace this text with your own.", ["filler"]),
        ("Texto de prueba.", ["filler"]),
        ("Le contenu arrive bientôt.", ["filler"]),
        ("Contenuto in preparazione.", ["filler"]),
        ("To jest przykładowy akapit.", ["filler"]),
        ("Questo è un testo finto.", ["filler"]),
        ("Type something here.", ["filler"]),
        ("An dieser Stelle folgt der Inhalt.", ["filler"]),
        ("The text was written here by monks in 1200.", []),
        ("The title goes to the eldest son.", []),
        ("Hier ist der Text der Inschrift erhalten.", []),
        ("The body of the king is buried here.", []),
        ("Sample text was taken from the river bed.", []),
        ("El texto se conserva aquí.", []),
        ("Tutaj zachował się tekst napisu.", []),
        ("Copy of the entry is kept here.", []),
        ("The section is here two metres wide.", []),
        # Messages in other wordings.
        ("This site is experiencing technical difficulties.", ["error_page"]),
        ("Sorry, we can't display this content right now.", ["error_page"]),
        ("Die Verbindung zum Server wurde unterbrochen.", ["error_page"]),
        ("Une panne est survenue.", ["error_page"]),
        ("Nous rencontrons un problème technique. Veuillez réessayer.", ["error_page"]),
        ("El servidor no responde.", ["error_page"]),
        ("La pagina richiesta non esiste.", ["error_page"]),
        ("Serwer nie odpowiada.", ["error_page"]),
        ("Our servers are overloaded at the moment.", ["error_page"]),
        ("HTTP 418", ["error_page"]),
        ("You need to enable cookies to use this website.", ["script_notice"]),
        ("Attiva JavaScript nel browser.", ["script_notice"]),
        ("Bitte aktivieren Sie Cookies.", ["script_notice"]),
        # Code and tutorials in all languages, and places without a limit of length.
        ("The method __init__ is called when an object is made.", []),
        ("W szablonie znacznik {{miasto}} jest potem zastępowany nazwą.", []),
        ("In der Vorlage wird {{stadt}} durch den Namen ersetzt.", []),
        ("Dans un modèle la balise {{ville}} est remplacée par le nom.", []),
        ("En la plantilla {{ciudad}} se sustituye por el nombre.", []),
        ("Nel modello il segnaposto {{citta}} viene sostituito dal nome.", []),
        ("Code follows:\n    print({{name}})\nThat was all.", []),
        ('He said "' + "a very long quotation " * 15 + '{{x}}" and left.', []),
        ("{{the full official name of the town and its district council}}", ["placeholder"]),
        ("The tower of [insert the full and official name of the town as it stands in the register] is old.", ["placeholder"]),
        ("Wieża [wpisz nazwę] jest stara.", ["placeholder"]),
    ],
)
def test_residue(text, kinds):
    assert residue(text) == kinds


def test_template_residue(table):
    data = [(1, "The {{city}}."), (2, None), (3, ""), (1, "The {{city}}."), (None, "Error 404: Not Found."), (4, " ".join(("river", "tower", "valley", "old", "bridge")[i * i % 7 % 5] for i in range(200_000))), (5, "BŁĄD 404. NIE ZNALEZIONO STRONY.")]
    df = table([(*d, "k") for d in data], "doc_id long, text string, kind string")
    assert rows(template_residue(df)) == sorted([(1, "placeholder"), (1, "placeholder"), (None, "error_page"), (5, "error_page")], key=repr)
    assert template_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["{{a ", "__a ", "[insert ", "“a ", "<% a ", "%a", "a: ", "`a ", "(a b "])
def test_residue_is_linear(unit):
    import time

    began = time.perf_counter()
    residue(unit * 100_000)
    assert time.perf_counter() - began < 5


def test_batches_agree_with_single_texts(table):
    samples = [p for c in test_residue.pytestmark for p, _ in c.args[1]]
    got = defaultdict(list)
    for r in template_residue(table(list(enumerate(samples)), "doc_id long, text string")).collect():
        got[r["id"]].append(r["kind"])
    assert [sorted(got[i]) for i in range(len(samples))] == [sorted(residue(t)) for t in samples]
