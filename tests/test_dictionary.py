import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import dictionary as D

CARD = "file string, sheet string, canonical string, dimension string, profile struct<n:long,magnitude:int,percent_like:boolean,whole:boolean>"


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def fit(p, q):
    score = 1.0 - min(abs(p[1] - q[1]) * 0.25, 0.6) - 0.25 * (p[2] != q[2]) - 0.1 * (p[3] != q[3])
    return not p[0] or not q[0] or max(score, 0.0) >= 0.7


def one_by_one(cards):
    groups = {}
    out = {}
    for file, sheet, name, dimension, profile in sorted(cards, key=lambda x: x[:4]):
        key = next((k for k, (lead, places) in groups.items() if (file, sheet) not in places and ratio(name, k) >= 92 and fit(profile, lead)), name)
        groups.setdefault(key, (profile, []))[1].append((file, sheet))
        out[file, sheet, name, dimension] = key
    return out


def changed(r, name, letters):
    x = list(name)
    for _ in range(r.randint(1, 3)):
        x.insert(r.randrange(len(x) + 1), r.choice(letters)) if r.random() < 0.5 or len(x) < 2 else x.pop(r.randrange(len(x)))
    return "".join(x)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_names_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab日") for _ in range(r.randint(1, 45))) for _ in range(25)] + ["", "x"]
    names = sorted({*base, *(changed(r, b or "q", "ab日") for b in base for _ in range(7))})
    want = {(a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(names) for b in names[i + 1 :] if ratio(a, b) >= 92}
    got = D.similar_names(spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string")).collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want) > 50


@pytest.mark.parametrize(("seed", "sheets"), [(3, 40), (4, 6)])
def test_groups_of_500_cards_equal_the_sequence(spark, seed, sheets):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefg 量") for _ in range(r.randint(6, 30))) for _ in range(12)]
    names = [*base, *(changed(r, b, "abcdefg 量") for b in base for _ in range(5)), "total", "totals"]
    profile = lambda: (r.choice([0, 5, 5]), r.choice([2, 3, 5]), r.random() < 0.2, r.random() < 0.7)
    cards = [(f"f{r.randrange(3)}", f"s{r.randrange(sheets)}", r.choice(names), str(r.randrange(3)), profile()) for _ in range(500)]
    cards = list({x[:4]: x for x in cards}.values())
    cards += [(f"g{i:03}", "s", "total", "total", (5, 3, False, True)) for i in range(170)]  # one name holds a third of all cards
    got = D.field_dictionary(spark.createDataFrame(cards, CARD).withColumns({"turn": F.lit(1), "key": F.lit("x"), "name": F.lit(2)}))
    want = one_by_one(cards)
    assert {(x.file, x.sheet, x.canonical, x.dimension): x.field for x in got.collect()} == want
    assert any(k[2] != v for k, v in want.items()) and len({*want.values()}) < len({k[2] for k in want})


def test_columns_of_one_sheet_stay_apart(spark):
    p = (9, 3, False, True)
    nights = [("a", "s", f"來臺旅客_停留夜數_合計欄位_{i}", "d", p) for i in range(1, 6)]
    cards = [*nights, ("b", "s", nights[0][2], "d", p), ("b", "t", "來臺旅客_停留夜數_合計欄位_9", "d", p), ("c", "s", nights[1][2], "d", (9, 7, True, True))]
    got = {(x.file, x.sheet, x.canonical): x.field for x in D.field_dictionary(spark.createDataFrame(cards, CARD)).collect()}
    assert all(got["a", "s", n[2]] == n[2] for n in nights)
    assert got["b", "s", nights[0][2]] == got["b", "t", "來臺旅客_停留夜數_合計欄位_9"] == nights[0][2] and got["c", "s", nights[1][2]] == nights[1][2]


def test_dictionary_of_odd_cards(spark):
    p = (1, 1, False, True)
    cards = [(None, None, None, None, p), (None, None, None, "x", p), ("f", "s", "", "d", p), ("f", "t", "", "d", None), ("f", "t", "n", "d", None), ("f", "t", "n", "d", None)]
    rows = D.field_dictionary(spark.createDataFrame(cards, CARD))
    got = [(x.canonical, x.field) for x in rows.collect()]
    assert sorted(got, key=str) == sorted([(None, None), (None, None), ("", ""), ("", ""), ("n", "n"), ("n", "n")], key=str)
    assert {(x.field, x.files, x.cards) for x in D.like_fields(rows).collect()} == {(None, 0, 2), ("", 1, 2), ("n", 1, 2)}
    assert D.field_dictionary(rows.drop("field").limit(0)).count() == 0
