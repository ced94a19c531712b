"""Suffix stripping after Porter, in the engine's variant, as plain SQL expressions.

Every word carries a string of C and V for its consonants and vowels. A letter's kind depends on what stands to its left only, so
the string of a prefix is the prefix of the string; measures and other conditions on stems are then LIKE
patterns over prefixes. The same expressions run in Spark and, for comparison, in other SQL engines; only the fold
that makes the string is written per dialect.

Unlike the published algorithm, the plural s is dropped only after a vowel; eed without measure falls through to ed; the lists
of steps 2 to 4 go on after a failed condition, in list order; and ion after s needs no measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Suffixes with replacements, in order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_KIND = "case when c in ('a', 'e', 'i', 'o', 'u') then 'V' when c = 'y' and cv <> '' and right(cv, 1) = 'C' then 'V' else 'C' end"
FOLDS = {
    "spark": f"aggregate(filter(split(w, ''), x -> x <> ''), '', (cv, c) -> concat(cv, {_KIND}))",
    "duckdb": f"list_reduce(list_prepend('', string_split(w, '')), lambda cv, c: concat(cv, {_KIND}))",
}
_MORE_THAN = ("%VC%", "%VC%VC%")


def _cut(n: int, column: str = "w") -> str:
    return f"left({column}, length({column}) - {n})"


def _measure(n: int, more_than: int) -> str:
    """Whether the word without its last n letters has a measure of more than 0 or 1."""
    return f"{_cut(n, 'cv')} like '{_MORE_THAN[more_than]}'"


def _short(cv: str, w: str) -> str:
    """Whether a word ends consonant, vowel, consonant, the last not w, x or y."""
    return f"({cv} like '%CVC' and right({w}, 1) not in ('w', 'x', 'y'))"


def _replace(pairs, more_than: int) -> str:
    return " ".join(f"when w like '%{s}' and {_measure(len(s), more_than)} then concat({_cut(len(s))}, '{r}')" for s, r in pairs)


#: Each stage sets w from (w, cv); a stage named t leaves its result and whether a suffix fell for the next.
_PLURAL = f"case when w like '%sses' or w like '%ies' then {_cut(2)} when w like '%ss' then w when w like '%s' and {_cut(1, 'cv')} like '%V%' then {_cut(1)} else w end"
_FALLEN = (
    f"case when w like '%eed' and {_measure(3, 0)} then concat('+', {_cut(1)}) when w like '%ed' and {_cut(2, 'cv')} like '%V%' then {_cut(2)} "
    f"when w like '%ing' and {_cut(3, 'cv')} like '%V%' then {_cut(3)} else concat('+', w) end"
)
_MENDED = (
    "case when t like '+%' then substr(t, 2) when t like '%at' or t like '%bl' or t like '%iz' then concat(t, 'e') "
    "when length(t) > 1 and right(t, 1) = substr(t, length(t) - 1, 1) and right(left(cv, length(t)), 1) = 'C' and right(t, 1) not in ('l', 's', 'z') then left(t, length(t) - 1) "
    f"when left(cv, length(t)) like '%VC%' and left(cv, length(t)) not like '%VC%VC%' and {_short('left(cv, length(t))', 't')} then concat(t, 'e') else t end"
)
_FINAL_Y = f"case when w like '%y' and {_cut(1, 'cv')} like '%V%' then concat({_cut(1)}, 'i') else w end"
_SECOND = f"case {_replace(STEP_2, 0)} else w end"
_THIRD = f"case {_replace(STEP_3, 0)} else w end"
_FOURTH = f"case {_replace([(s, '') for s in STEP_4], 1)} when w like '%sion' or (w like '%tion' and {_measure(3, 1)}) then {_cut(3)} else w end"
_FINAL_E = f"case when w like '%e' and ({_measure(1, 1)} or ({_measure(1, 0)} and not {_short(_cut(1, 'cv'), _cut(1))})) then {_cut(1)} else w end"
_DOUBLE_L = f"case when w like '%ll' and cv like '%VC%VC%' then {_cut(1)} else w end"


def stages(dialect: str) -> list[dict[str, str]]:
    """Projections over (word, w, cv) to be applied one after the other; each gives w and cv anew."""
    fold, keep = FOLDS[dialect], "left(cv, length(w))"
    return [
        {"w": _PLURAL, "cv": "cv"}, {"w": "w", "cv": keep}, {"w": "w", "cv": "cv", "t": _FALLEN}, {"w": _MENDED, "cv": "cv"},
        {"w": "w", "cv": fold}, {"w": _FINAL_Y, "cv": "cv"}, {"w": "w", "cv": fold}, {"w": _SECOND, "cv": "cv"}, {"w": "w", "cv": fold}, {"w": _THIRD, "cv": "cv"},
        {"w": "w", "cv": fold}, {"w": _FOURTH, "cv": "cv"}, {"w": "w", "cv": keep}, {"w": _FINAL_E, "cv": "cv"}, {"w": "w", "cv": keep}, {"w": _DOUBLE_L, "cv": "cv"},
    ]


def stem_words(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) for a table of distinct lower-case ASCII words. Words of up to two letters stay as they are."""
    out = words.selectExpr(f"`{column}` as word", f"lower(`{column}`) as w").selectExpr("word", "w", f"{FOLDS['spark']} as cv")
    for stage in stages("spark"):
        out = out.selectExpr("word", *(f"{e} as {name}" for name, e in stage.items()))
    # The generator keeps conditions on the stem from being pushed into the stages, where each use of w would be written out.
    return out.selectExpr("word", "explode(array(case when length(word) <= 2 then lower(word) else w end)) as stem")


def stem_sql(source: str, dialect: str = "duckdb") -> str:
    """The same as a SQL query over ``source``, which gives a column ``word``."""
    sql = f"SELECT word, w, {FOLDS[dialect]} AS cv FROM (SELECT word, lower(word) AS w FROM ({source}))"
    for stage in stages(dialect):
        sql = f"SELECT word, {', '.join(f'{e} AS {name}' for name, e in stage.items())} FROM ({sql})"
    return f"SELECT word, CASE WHEN length(word) <= 2 THEN lower(word) ELSE w END AS stem FROM ({sql})"
