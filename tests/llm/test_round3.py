import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle import connection, differences
from tabulon.llm import fingerprints, language_id, lexical_search, mixing, resampling
from tabulon.llm.common import Scratch, word_lists
from tabulon.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def corpus(seed, n):
    """Texts of a small vocabulary with copies, nulls, empty ones, one long one, clashing columns and rows repeated whole."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéÄß9Zß") for _ in range(r.randint(1, 6))) for _ in range(150)]
    line = lambda k: r.choice([" ", ", ", "\t", "—"]).join(r.choice(vocabulary) for _ in range(k))
    rows = [(i, line(r.randint(15, 60))) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(n // 3)]
    rows += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, " .!"), (None, line(30)), (None, rows[0][1]), rows[4], rows[4], (2 * n + 3, line(60_000))]
    return rows


def odd(spark, rows):
    names = {c: F.lit(1) for c in ("draw", "got", "block", "start", "score", "part", "turn", "closing", "n", "terms", "item", "rank", "words")}
    return spark.createDataFrame(rows, DOCS).withColumns(names)


def test_words_of_long_texts_are_whole():
    text = " ".join(f"Wörd{i}" for i in range(3000)).encode()
    assert [w for part in word_lists(text, 100) for w in part] == text.lower().split() and len(list(word_lists(text, 100))) > 100
    assert list(word_lists(b"")) == [] and [w for p in word_lists(b"x" * 5000, 10) for w in p] == [b"x" * 5000]


# Importance resampling
def brute_scores(rows, target, longest, buckets, seed):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    where = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(where(f) for _, t in rows for f in features(t))
    t = Counter(where(f) for x in target for f in features(x))
    sums = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sums[0] + buckets) / ((s[b] + 1) * (sums[1] + buckets))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain(where(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_scores_equal_brute_force(spark, longest):
    rows, target = corpus(1, 60), ["abc Äß", None, "", *(t for _, t in corpus(2, 20)[:20])]
    want = sorted(brute_scores(rows, target, longest, 97, 7), key=str)
    texts = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.scored(odd(spark, rows), texts, longest, 97, 7).select("doc_id", "draw.*").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_ranks_equal_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(resampling, "SCORE_ROWS", most)
    r = random.Random(3)
    rows = [(None if i % 50 == 0 else r.randrange(300), r.choice([5, 20, 30]), 1, 0, r.choice([9, 10, 10, 11, -4])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, words int, n_features int, weight int, score int")
    df = df.select("doc_id", F.struct(*(F.col(c).cast("long").alias(c) for c in ("words", "n_features", "weight", "score"))).alias("draw"), F.lit(1).alias("block"))
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    quota = len(able) * 40 // 100
    for part, k in ((40, quota), (100, len(able)), (0, 0)):
        out = resampling.ranked(df, part, 100).select("doc_id", "draw.*").collect()
        drawn = sorted((x.rank, x.score, x.doc_id) for x in out if x.rank is not None)
        assert drawn == [(i + 1, x[4], x[0]) for i, x in enumerate(able[:k])] and len(out) == len(rows)


def test_resampling_of_empty_tables_and_whole_rows(spark):
    rows = odd(spark, corpus(4, 40))
    none = rows.limit(0)
    assert resampling.draw_ranks(none, rows).count() == 0
    alone = resampling.draw_ranks(rows, none).collect()
    assert sum(r.rank is not None for r in alone) == sum(len(words(t)) >= 20 for _, t in corpus(4, 40)) // 10
    got = resampling.resampled(rows, rows, 50, 100)
    ranks = {(r.doc_id, r.rank) for r in resampling.ranked(Scratch(spark, "t").write(resampling.scored(rows, rows)), 50, 100).select("doc_id", "draw.rank").collect() if r.rank}
    assert {(r.doc_id, r.draw.rank) for r in got.collect()} == ranks and "text" in got.columns


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op9_embedding_dedup", "op10_url_filter", "op11_resampling", "op13_lexical_search"])
def test_query_equals_its_sql(spark, name):
    assert not differences(spark, connection(FOLDER), FOLDER, QUERIES[name], SQL[name])


def planted(folder, **tables):
    """A connection in which the tables, also written to the folder for the query, take the place of the given ones."""
    c = connection(FOLDER)
    for name, rows in tables.items():
        rows.to_parquet(f"{folder}/{name}.parquet", index=False)
        c.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def test_join_equals_its_sql_on_near_copies(spark, tmp_path):
    r = random.Random(12)
    rows, i = [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO"), (905, "one two three")], 0
    for _ in range(30):
        base = [r.choice("abcdefgh") + r.choice("ijklmnop") for _ in range(r.randrange(3, 400))]
        for _ in range(r.randrange(1, 6)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                own[r.randrange(len(own))] = "x"
            rows.append((i, " ".join(own)))
            i += 1
    c = planted(tmp_path, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert not differences(spark, c, str(tmp_path), QUERIES["op4_jaccard_join"], SQL["op4_jaccard_join"])
    assert c.execute(f"SELECT COUNT(*) FROM ({SQL['op4_jaccard_join']}) WHERE component_id <> doc_id").fetchone()[0] > 20


def test_near_vectors_equal_their_sql(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = []
    for g in range(40):
        base = r.standard_normal(32)
        for _ in range(int(r.integers(1, 8))):
            v = base + r.standard_normal(32) * r.choice([0, 0.05, 0.1, 0.14])
            rows.append((v.astype(np.float32).tolist(), int(g % 3)))
    rows += [(None, 1), ([0.0] * 32, 1), ([1.0] * 31, 1), (rows[0][0], None), (rows[0][0], rows[0][1]), ([float("nan")] + [1.0] * 31, 2)]
    frame = pd.DataFrame([(i, *x) for i, x in enumerate(rows)], columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})
    c = planted(tmp_path, embeddings=frame)
    assert not differences(spark, c, str(tmp_path), QUERIES["op9_embedding_dedup"], SQL["op9_embedding_dedup"])
    assert c.execute(f"SELECT SUM(n_links) FROM ({SQL['op9_embedding_dedup']})").fetchone()[0] > 100


def test_verdicts_equal_their_sql_on_linked_pages(spark, tmp_path):
    r = random.Random(6)
    hosts = ["a.org", "www.Example.org", "x.com", "y.net", "b.net", "c.info"]
    paths = ["", "/", "/es/1", "/en/12", "/fr/2", "/de/3", "/p/q", "/p/q?x=1"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    tag = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', '<link rel="stylesheet" href="{}">']
    rows = [(i, r.choice(urls) + r.choice(["", "#top"]), "<html>" + "".join(r.choice(tag).format(r.choice([*urls, "/p/q", "q", "?x=1", "//y.net/de/3", "#a"])) for _ in range(r.choice([0, 1, 1, 2])))) for i in range(40)]
    rows += [(100, None, None), (101, "no scheme", tag[0].format("http://x.com/de/3")), (102, "http://b.net/none", None), (103, "://", "")]
    rows += [(104, "http://z.net/a", tag[0].format("http://x.com/de/9")), (105, "http://z.net/b", tag[1].format("http://x.com/de/8")), (106, "http://z.net/b", tag[2].format("http://a.org/8"))]
    c = planted(tmp_path, pages=pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert not differences(spark, c, str(tmp_path), QUERIES["op10_url_filter"], SQL["op10_url_filter"])
    assert c.execute(f"SELECT COUNT(*) FROM ({SQL['op10_url_filter']}) WHERE rule IS NULL AND verdict = 'block'").fetchall() == [(1,)]


def test_taken_words_equal_a_walk_over_words(spark):
    r = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abc") for _ in range(r.randrange(0, 90))), r.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(200)], "doc_id long, text string, source string")
    got = {x.doc_id: x.taken for x in mixing.mix_documents(docs).collect()}
    at = docs.withColumn("h", F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text"))).orderBy(F.pmod("h", F.lit(mixing.BUCKETS)), "h", "doc_id").collect()
    names = ["a", "b", "c", "d", None]
    order = {s: [x.doc_id for x in at if x.source == s for _ in x.text.split()] for s in names}  # a source's words in seeded order
    size = [len(order[s]) for s in names]
    weight, want, capped = [1, 2, 3, 1, 2], [0.0] * 5, set()
    while True:  # shares, the excess over three times a source reshared
        left = sum(size) - sum(3 * size[i] for i in capped)
        want = [3 * size[i] if i in capped else left * weight[i] / sum(weight[j] for j in range(5) if j not in capped) for i in range(5)]
        over = {i for i in range(5) if want[i] > 3 * size[i]}
        if not over:
            break
        capped |= over
    blocks = [-(-n // mixing.BLOCK) for n in size]
    seats = [0] * 5
    for _ in range(round(sum(size) / mixing.BLOCK)):
        i = max((j for j in range(5) if seats[j] < 3 * blocks[j]), key=lambda j: (want[j] / (2 * seats[j] + 1), -j))
        seats[i] += 1
    taken = dict.fromkeys(got, 0)
    for s, n, quota in zip(names, blocks, seats):
        a, c = mixing._step(n, f"7:{s!r}")
        for place, doc in enumerate(order[s]):
            turn = (place // mixing.BLOCK * a + c) % n
            taken[doc] += sum(turn + k * n < quota for k in range(3))
    assert got == taken


def test_mixture_equals_plain_expectation_maximisation():
    r = np.random.default_rng(4)
    like = r.normal(-20, 6, (60, 4)).astype(np.float32)
    doc = np.repeat([0, 1, 3, 4], [1, 9, 20, 30])
    got, total = language_id.mixture(like, doc, 6)

    def fit(rows, pi):
        for _ in range(language_id.ROUNDS):
            share = [[pi[k] * math.exp(x[k] - max(x)) for k in range(4)] for x in rows]
            pi = [sum(s[k] / sum(s) for s in share) / len(rows) for k in range(4)]
        return pi, sum(math.log(sum(pi[k] * math.exp(x[k] - max(x)) for k in range(4))) + max(x) for x in rows)

    for d in (0, 1, 3, 4):
        rows = like[doc == d].astype(float).tolist()
        free, _ = fit(rows, [0.25] * 4)
        ranked = sorted(range(4), key=lambda k: -free[k])
        best = None
        for m in range(1, 5):  # nested sets, as far as the penalised likelihood grows
            start = [max(free[k], 1e-6) if k in ranked[:m] else 0.0 for k in range(4)]
            pi, ll = fit(rows, [x / sum(start) for x in start])
            worth = ll - 0.5 * (m - 1) * math.log(len(rows) + 1) - (m - 1)
            if best is None or worth > best[0] + 1e-9:
                best = worth, pi
        assert np.allclose(got[d], best[1], atol=1e-6) and total[d] == pytest.approx(best[0], rel=1e-6)
    assert not got[2].any() and not got[5].any()


# Fingerprints
def test_spans_and_extensions_equal_slices():
    r = random.Random(5)
    a = "".join(r.choice("ab") for _ in range(400)) + "𝄞é" * 5
    b = a[:150] + "x" + a[130:390]
    p, q = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for _ in range(2000):
        i, j, n = r.randrange(len(a)), r.randrange(len(b)), r.randrange(20)
        assert p.same(i, q, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert p.extension(i, q, j) == k
    assert p.extension(len(a), q, 0) == 0 and fingerprints.PrefixHashes("").n == 0


def test_fingerprints_tell_texts_apart_in_any_pieces(monkeypatch):
    r = random.Random(6)
    texts = ["", "a", "b", "ab", "ba", "a" * 16, "a" * 17, "a" * 1000, "ab" * 500, *("".join(r.choice("ab c") for _ in range(n)) for n in (5, 15, 16, 17, 31, 32, 33, 200, 4000))]
    marks = [fingerprints.fingerprint(t) for t in texts]
    assert len(set(marks)) == len(texts) and marks[0] == fingerprints.fingerprint(None)
    monkeypatch.setattr(fingerprints, "PIECE", 37)
    assert [fingerprints.fingerprint(t) for t in texts] == marks
    assert max(map(len, marks)) < 1100


def test_sampled_sums_are_the_prefix_array():
    r = random.Random(7)
    text = "".join(r.choice("abcdef ") for _ in range(3000))
    whole, sample = fingerprints.PrefixHashes(text), fingerprints.Sample(fingerprints.fingerprint(text))
    assert all(sample.sums[i] == (int(whole.sums[0][i]), int(whole.sums[1][i])) for i in sample.sums)
    assert {0, 3000, 256, 2816} <= set(sample.sums) and len(sample.places) > 8


def test_likeness_follows_common_extensions():
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    like = lambda a, b: fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b))
    for n in (3, 10, 16, 40, 300, 3000, 50_000):
        a, b = text(n), text(n)
        part = like(a, fingerprints.edited(a, b))
        same = fingerprints.PrefixHashes(a).extension(0, fingerprints.PrefixHashes(fingerprints.edited(a, b)), 0) / n
        assert like(a, a) == 1 and same - 0.12 <= part <= same + max(0.05, 2 / n) and like(a, b) <= max(0.35, 2 / n)
    a = text(5000)
    assert like(a, "zz" + a) > 0.85 and like(a, a[:2000] + "zzz" + a[2000:]) > 0.8 and like(a, a[2500:] + a[:2500]) > 0.35
    assert like("", "x") == 0 and like("", "") == 1 and like("a" * 500, "a" * 499) < 1 and like("a" * 500, "a" * 499 + "b") > 0.8


@pytest.mark.parametrize("size", [32 << 20, 2000])
def test_chain_equals_brute_force(spark, size):
    rows = corpus(9, 50)
    got = fingerprints.edit_chain(odd(spark, rows), size).collect()
    mark = fingerprints.fingerprint
    turn = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), turn[x[1] or ""]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        new = t[: len(t) - k] + nxt[:k]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), mark(t), mark(new), fingerprints.likeness(mark(t), mark(new)), fingerprints.likeness(mark(t), mark(nxt))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_chain_of_few_rows_and_of_one_hot_id(spark):
    one = fingerprints.edit_chain(spark.createDataFrame([(7, "abcdef")], DOCS)).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprints.edit_chain(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, f"text number {i} " * 9) for i in range(300)] + [(None, f"null {i} " * 20) for i in range(300)] + [(i, "x" * i) for i in range(100)]
    got = fingerprints.edit_chain(spark.createDataFrame(rows, DOCS), 4000).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    named = fingerprints.with_fingerprint(spark.createDataFrame(rows[:3], DOCS)).collect()
    assert [r.fingerprint for r in named] == [fingerprints.fingerprint(r.text) for r in named]


# Ranked lexical search
def brute_search(rows, items, k):
    docs = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out, wanted = [], {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    for item, terms in wanted.items():
        scores = []
        for i, c in docs:
            m, total = 10 + (90 * sum(c.values()) * n_all) // l_all, 0
            for t in terms & c.keys():
                total += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if total > 0:
                scores.append((-total, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "most", "k"), [(4096, 16 << 20, 10), (7, 300, 3)])
def test_search_equals_brute_force(spark, monkeypatch, block, most, k):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    rows, extra = corpus(10, 70), corpus(11, 25)
    r = random.Random(12)
    vocabulary = words(rows[-1][1])
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(20)]
    items += [(3, "extra " + extra[0][1]), (40, None), (41, " . "), (42, "nowhere"), (None, rows[0][1]), items[5], (43, rows[1][1].upper())]
    want = brute_search(rows, items, k)  # statistics cover all documents whatever slice an item is in
    got = lexical_search.search(odd(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)), k, most)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_empty_tables_and_large_numbers(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.where("doc_id = 2"), items).count() == 0
    n, tf, w = np.array([3 * 10**7]), np.array([5]), np.array([100])
    docs_, terms_ = 5 * 10**10, 10**13
    m = 10 + 90 * 3 * 10**7 * docs_ // terms_
    assert lexical_search.impacts(tf, n, w, docs_, terms_).tolist() == [100 * (5 * 10**9 // (5000 + 8 * m))]


def test_search_ties_go_to_the_smaller_id():
    s, ids, none = np.array([5, 7, 5, 5, 0, 7]), np.array([9, 4, 3, 0, 1, 2]), np.array([False, False, False, True, False, False])
    assert lexical_search.best(s, ids, none, 4).tolist() == [5, 1, 2, 0] and lexical_search.best(s, ids, none, 99).tolist() == [5, 1, 2, 0, 3]


# Decontamination: cells and slices
def test_cells_keep_recall_of_the_full_product(monkeypatch):
    from tabulon.llm import decontamination as D

    r = np.random.default_rng(4)
    themes = r.normal(size=(60, 48))
    target = D.unit((themes[r.integers(0, 60, 3000)] * 0.7 + r.normal(size=(3000, 48))).astype(np.float32))
    p = D.unit(np.concatenate([target[r.integers(0, 3000, 1500)] + r.normal(size=(1500, 48)) * 0.11, r.normal(size=(4000, 48))]).astype(np.float32))
    known = object.__new__(D.Benchmark)
    known.centres, cell = D.cells(target)
    order = np.argsort(cell, kind="stable")
    known.target, known.bounds = target[order].T.copy(), np.searchsorted(cell[order], np.arange(len(known.centres) + 1))
    monkeypatch.setattr(D, "ROWS", 700)
    monkeypatch.setattr(D, "COLUMNS", 13)
    found = set()
    for rows, columns, cosines in known.near(p, 0.7):
        pairs = set(zip(rows.tolist(), order[columns].tolist()))
        assert not pairs & found and np.allclose((p[rows] * target[order[columns]]).sum(1), cosines, atol=1e-5)
        found |= pairs
    want = set(zip(*(x.tolist() for x in np.nonzero(p @ target.T >= 0.7))))
    assert len(want) > 1000 and found <= want and len(found) >= 0.9 * len(want)
    opened = (p @ known.centres.T >= D.OPEN) @ np.diff(known.bounds)
    assert opened.sum() < 0.3 * len(p) * 3000
    assert len(D.cells(target[:500])[0]) == 1 and len(D.cells(target[:0])[0]) == 0


def test_many_slices_and_items_of_a_thousand_words(spark, monkeypatch):
    from tabulon.llm import decontamination as D

    monkeypatch.setattr(D, "SLICE", 7)
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20_000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(1000) for _ in range(12)] + [text(30) for _ in range(12)]
    docs, want = [], set()
    for i in range(72):
        t = text(400)
        if i % 2:
            j = i // 2 % 24
            gone = set(r.sample(range(len(items[j])), len(items[j]) // 10))
            copy = [r.choice(vocabulary) if k in gone else w for k, w in enumerate(items[j])]
            t, want = t[:50] + copy + t[50:], want | {(i, j)}
        docs.append((i, " ".join(t)))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = D.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    near = {(x.doc_id, x.item_id) for x in got if x.cosine > 0}
    monkeypatch.setattr(D, "DIRECT", 1 << 30)  # one cell: the full product
    whole = {(x.doc_id, x.item_id) for x in D.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect() if x.cosine > 0}
    assert near <= whole and len(near) >= 0.9 * len(whole) > 10
    assert np.prod((D.ROWS, D.COLUMNS)) * 4 <= 256 << 20


# Personal data
def test_long_stretches_are_decoded_in_pieces(monkeypatch):
    from tabulon.llm import pii

    r = random.Random(2)
    tagger = pii.Tagger(1)
    tagger.p = {k: (v * 3).astype(np.float32) for k, v in tagger.p.items()}
    texts = ["".join(r.choice("0123456789.,-@ab \n") for _ in range(n)) for n in (700, 64, 3000, 1500, 0, 5)]
    monkeypatch.setattr(pii, "SURE", 0.0)
    monkeypatch.setattr(pii, "_substance", lambda kind, found: True)
    none = [[] for _ in texts]
    whole = pii.added_spans(texts, none, tagger)
    monkeypatch.setattr(pii, "PIECE", 608)
    assert [sorted(x) for x in pii.added_spans(texts, none, tagger)] == [sorted(x) for x in whole] and sum(map(len, whole)) > 100
    assert list(pii.pieces_of(3, 10, 20)) == [(3, 10, 20, 10, 20)]
    cut = list(pii.pieces_of(3, 10, 2000))
    assert [c[3] for c in cut[1:]] == [c[4] for c in cut[:-1]] and all(b - a <= 608 for _, a, b, _, _ in cut) and cut[0][3] == 10 and cut[-1][4] == 2000


def test_texts_of_digits_alone_take_linear_time_and_bounded_memory():
    import resource
    import time

    from tabulon.llm import pii

    tagger = pii.Tagger()
    long = "7 8.9-" * 150_000
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    base = pii.base_spans(long)
    pii.added_spans([long, "4" * 300_000], [base, []], tagger)
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800_000  # kB
    assert pii.stretches("x" * 100 + "7" * 1000) == [(64, 1100)]


def test_what_may_be_a_kind_has_no_label():
    from tabulon.llm import pii

    text = "call 555 123 4567 or 10 . 0 . 0 . 1 or joe @ mail . org or 10.0.0.1 in 2024 at 9.50"
    y = pii.labels(text)
    free = {text[i] for i in np.flatnonzero(y < 0)}
    at = lambda x: y[text.index(x) : text.index(x) + len(x)]
    assert (at("555 123 4567") == -1).all() and (at("10 . 0 . 0 . 1") == -1).all() and (at("joe @ mail") == -1).all() and free
    assert at("10.0.0.1").tolist() == [3] + [4] * 7 and (at("2024") == 0).all() and (at("9.50") == 0).all() and (at("call ") == 0).all()


def test_windows_come_from_the_whole_text(spark):
    from tabulon.llm import pii

    text = " ".join(f"word {i}" for i in range(3000))
    rows = spark.createDataFrame([(text,)] * 3, "text string").mapInPandas(pii._labelled(500), "bucket long, h long, text string, tags array<int>").collect()
    places = [text.index(r.text) / len(text) for r in rows]
    assert len({r.bucket for r in rows}) >= 300 and min(places) < 0.05 and max(places) > 0.95 and all(len(r.tags) == pii.WINDOW for r in rows)


def test_spellings_that_training_never_made(spark):
    from tabulon.llm import pii

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tagger, r = pii.train_tagger(docs), random.Random(7)
    host = [x.text for x in docs.where("length(text) > 400").orderBy("doc_id").limit(60).collect()]
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    makers = [(0, lambda: "joe.smith{@}mail.org"), (1, lambda: "(.)".join(str(r.randint(1, 255)) for _ in range(4))), (1, lambda: " · ".join(str(r.randint(1, 255)) for _ in range(4))), (3, lambda: f"{digits(3)}_{digits(3)}_{digits(4)}"), (3, lambda: f"{digits(3)}~{digits(3)}~{digits(4)}")]
    for kind, made in makers:
        texts, want = [], []
        for h in host:
            x, before = made(), h[:150] + " "
            texts.append(f"{before}{x} {r.choice(host)[:100]}")
            want.append((len(before), kind, len(before) + len(x)))
        found = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
        assert sum(w in f for w, f in zip(want, found)) >= 0.7 * len(host), made()
    calm = [h[:200] + " " + pii.harmless(r) + " " + h[200:300] for h in host if not any(c.isdigit() or c == "@" for c in h[:300])]
    assert len(calm) > 20 and not any(pii.added_spans(calm, [pii.base_spans(t) for t in calm], tagger))
