import re

import duckdb
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from scrivora.functions import text as tx
from scrivora.functions import vectors as vec
from scrivora.functions.stem import STEP_2, STEP_3, STEP_4, stem_sql, stem_words

GOLDEN = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat gas:ga bbs:bbs feed:fe agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan "
    "falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper vision:vis mission:miss adoption:adopt "
    "cement:cement replacement:replac adjustment:adjust dependent:depend science:scienc technology:technologi health:health artificial:artifici intelligence:intellig climate:climat change:chang university:univers "
    "computers:comput running:run element:elem 2024:2024 x86:x86 yyy:yyi sayings:sai"
)
PAIRS = dict(p.split(":") for p in GOLDEN.split())


def test_stem_golden(spark, table):
    assert dict(stem_words(table([(w,) for w in PAIRS], "word string")).collect()) == PAIRS


def test_stem_condition_on_result_is_no_blow_up(spark, table):
    found = stem_words(table([("running",), ("ab",)], "word string")).where(F.col("stem").isNotNull() & (F.col("stem") != "zz"))
    assert rows(found) == [("ab", "ab"), ("running", "run")]


# A plain twin of the stemmer, letter by letter.
def _kinds(w):
    out = ""
    for c in w:
        out += "V" if c in "aeiou" or (c == "y" and out[-1:] == "C") else "C"
    return out


def _m(w):
    return len(re.findall("VC", _kinds(w)))


def _cvc(w):
    return _kinds(w)[-3:] == "CVC" and w[-1] not in "wxy"


def _plain_stem(w):
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and "V" in _kinds(w[:-1]):
        w = w[:-1]
    if w.endswith("eed") and _m(w[:-3]) > 0:
        w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "V" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "C" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "V" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        w = next((w[: -len(s)] + r for s, r in table if w.endswith(s) and _m(w[: -len(s)]) > 0), w)
    hit = next((s for s in STEP_4 if w.endswith(s) and _m(w[: -len(s)]) > 1), None)
    if hit:
        w = w[: -len(hit)]
    elif w.endswith("sion") or (w.endswith("tion") and _m(w[:-3]) > 1):
        w = w[:-3]
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"[abelsty0]{0,4}(sses|ies|eed|ed|ing|at|bl|y|ational|izer|ness|ful|ement|ion|tion|sion|ll|e|s|ous)?", fullmatch=True), min_size=200, max_size=400))
def test_stem_against_plain_twin(spark, table, words):
    words = sorted({w for w in words if w} | {"feed"})
    expected = {w: _plain_stem(w) for w in words}
    con = duckdb.connect()
    assert dict(con.sql(stem_sql(f"select unnest({words!r}) as word")).fetchall()) == expected
    assert dict(stem_words(table([(w,) for w in words], "word string")).collect()) == expected


def test_tokenize(spark, table):
    df = table([("èaux Naïve e-mail x86 2024 don't ABC_def a1",), (None,), ("",), ("?? 42 a",)], "text string")
    assert [r[0] for r in df.select(tx.tokenize(F.col("text"))).collect()] == [["aux", "mail", "x86", "2024", "don", "abc", "def"], [], [], []]


def test_tokenize_blanks(spark, table):
    df = table([("  Don't (stop) 42 Été-2!",), (None,), ("\t\n",)], "text string")
    assert [r[0] for r in df.select(tx.tokenize_blanks(F.col("text"))).collect()] == [["don't", "stop", "été"], [], []]


@pytest.mark.parametrize("size, end", [(149, ""), (150, ""), (151, "...")])
def test_snippet(spark, table, size, end):
    out = table([("x" * size,)], "text string").select(tx.snippet(F.col("text"))).head()[0]
    assert out == "x" * min(size, 150) + end


def test_cards_and_formats(spark, table):
    df = table([(None, 1.23456, 3661, "99999999999", 4)], "title string, score double, s int, n string, m int")
    got = df.select(tx.titled(F.col("title")), tx.fixed(F.col("score")), tx.clock(F.col("s")), tx.number_or_zero(F.col("n")), tx.method_name(F.col("m")), tx.snippet(F.lit(None).cast("string"))).head()
    assert tuple(got) == ("Untitled Document", "1.2346", "01:01:01", 0, "Low-Rank SVD", "No content available")


def test_rank_bucket(spark, table):
    df = table([(k,) for k in (1, 10, 11, 25, 26, 99)], "k int").select(tx.rank_bucket(F.col("k")).alias("b"), tx.index_name(F.col("k")).alias("n"))
    assert [r["b"] for r in df.collect()] == [10, 10, 25, 25, 50, 50]


def test_vectors(spark, table):
    df = table([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vec.dot(F.col("a"), F.col("b")), vec.norm(F.col("a")), vec.cosine(F.col("a"), F.col("b")), vec.truncated(F.col("b"), 1)).collect()
    assert [tuple(r) for r in got[:2]] == [(24.0, 5.0, 0.96, [4.0]), (0.0, 0.0, 0.0, [1.0])] and got[2][0] is None
