import base64
import datetime as dt
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connection, differences
from tabulon.llm import decontamination, embedding_dedup, jaccard_join, language_id, mixing, pii, sharding, url_filter, warc
from tabulon.llm.common import Scratch
from tabulon.llm.components import connected_components
from tabulon.llm.embedding_dedup import near_vectors
from tabulon.llm.queries import QUERIES, SQL
from tabulon.llm.token_counts import SCHEMA, TokenRollup, bpe, maintained_counts, revised, signed

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n))


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    r = random.Random(1)
    long = words(r, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, long, "en", "a"), (5, long, "de", "b"), (6, "one two", None, "b"), (6, "one two", None, "b"), (None, "three four five", "en", "a"), (7, "…!?", "en", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({"n": F.lit("x"), "sid": F.lit(1), "size": F.lit(2), "b": F.lit(0), "rank": F.lit(9)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Token counts
def test_rollup_commits_once_and_takes_signed_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "s"), (3, None, None, None)], DOCS)
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    assert roll.totals().count() == 0
    assert roll.commit("b1", signed(docs, 1)) and not roll.commit("b1", signed(docs, 1))
    roll.commit("b2", signed(docs.where("doc_id = 2"), -1))
    roll.commit("b3", revised(spark.createDataFrame([("s", "en", "words-1", 2, 5)], "source string, lang string, tokenizer string, old_tokens long, new_tokens long")))
    want = {("s", "en", "words-1", 1, 5), ("s", "en", "bytes-1", 1, 3), (None, None, "words-1", 1, 0), (None, None, "bytes-1", 1, 0)}
    assert {tuple(r) for r in roll.totals().collect()} == want
    first = roll.compact()
    names = lambda: sorted(r.batch for r in roll.committed().collect())
    assert roll.live() == [first] and names() == ["b1", "b2", "b3"]
    assert not roll.commit("b1", signed(docs, 1)) and {tuple(r) for r in roll.totals().collect()} == want
    roll.commit("b4", signed(docs.where("doc_id = 2"), 1))
    roll.compact()
    assert names() == ["b1", "b2", "b3", "b4"] and not roll.commit("b2", signed(docs, 1))
    with pytest.raises(ValueError):
        roll.commit("compact-x", signed(docs, 1))


def test_rollup_survives_a_crash_between_compaction_and_deletion(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "s")], DOCS)
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    roll.insert("b1", docs)
    roll.delete("b2", docs.where("doc_id = 2"))
    want = {tuple(r) for r in roll.totals().collect()}
    monkeypatch.setattr(TokenRollup, "_clean", lambda self: None)
    roll.compact()
    assert (tmp_path / "r/deltas/b1/_SUCCESS").exists()
    again = TokenRollup(spark, f"file://{tmp_path}/r")
    assert {tuple(r) for r in again.totals().collect()} == want and not again.insert("b1", docs) and not again.delete("b2", docs)
    monkeypatch.undo()
    again.compact()
    assert not (tmp_path / "r/deltas/b1").exists() and {tuple(r) for r in again.totals().collect()} == want
    assert not (tmp_path / "r/ledger/b1").exists() and [(r.doc_id, r.copies) for r in again.ledger().collect()] == [(1, 1)]


def test_rollup_survives_a_crash_between_the_tables_of_a_compaction(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c", "en", "s")], DOCS)
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    roll.insert("b1", docs)
    roll.delete("b2", docs.where("doc_id = 2"))
    want = {tuple(r) for r in roll.totals().collect()}
    monkeypatch.setattr(TokenRollup, "_store", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        roll.compact()
    monkeypatch.undo()
    again = TokenRollup(spark, f"file://{tmp_path}/r")
    assert again.live() == ["b1", "b2"] and {tuple(r) for r in again.totals().collect()} == want and again.ledger().count() == 1
    name = again.compact()
    assert [x.name for x in (tmp_path / "r/ledger").iterdir()] == [name] and {tuple(r) for r in again.totals().collect()} == want
    again.revise("b3", docs.where("doc_id = 1").select("doc_id", F.xxhash64("text").alias("replaces"), F.lit("a b c").alias("text")))
    assert {r.tokens for r in again.totals().collect()} == {3, 5} and again.has("b1") and not again.has("b9")


def test_ledger_deletes_and_revises_single_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "x", "de", "t"), (None, "n 1", "en", "s"), (4, None, "en", "s")], DOCS)
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    roll.insert("load", docs)
    version = lambda i, old, new: docs.where(F.col("doc_id").eqNullSafe(F.lit(i)) & F.col("text").eqNullSafe(F.lit(old))).select("doc_id", F.xxhash64("text").alias("replaces"), F.lit(new).alias("text"))
    roll.revise("r1", version(1, "a b", "a b c d").unionByName(version(None, "n 1", "n")))
    assert not roll.revise("r1", version(1, "x", "y z"))
    roll.revise("r2", version(1, "a b", "gone already"))
    words_ = lambda: {tuple(r) for r in roll.totals().where("tokenizer = 'words-1'").drop("tokenizer").collect()}
    assert words_() == {("s", "en", 4, 9), ("t", "de", 1, 1)}
    roll.compact()
    roll.delete("d", spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long"))
    assert words_() == {("s", "en", 2, 1)}
    roll.insert("again", docs.where("doc_id = 4"))
    assert words_() == {("s", "en", 3, 1)} and sorted(r.copies for r in roll.ledger().collect()) == [1, 2]


def test_rollup_replaces_what_a_failed_try_left(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    spark.createDataFrame([("s", "en", "words-1", 9, 9)], SCHEMA).write.parquet(f"{folder}/deltas/b1")
    (tmp_path / "r/deltas/b1/_SUCCESS").unlink()
    roll = TokenRollup(spark, folder)
    roll.commit("b1", spark.createDataFrame([("s", "en", "words-1", 1, 2)], SCHEMA))
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "words-1", 1, 2)]


def test_token_counts_equal_sql(spark):
    assert not differences(spark, connection(FOLDER), FOLDER, QUERIES["op1_token_counts"], SQL["op1_token_counts"])


def test_token_counts_of_odd_rows(spark, odd_docs):
    gone = spark.createDataFrame([(6,), (6,), (99,), (None,)], "doc_id long")
    got = {tuple(r) for r in maintained_counts(odd_docs, gone).where("tokenizer = 'words-1'").collect()}
    assert (None, None, "words-1", 1, 0) in got and not any(x[0] == "b" and x[1] is None for x in got)
    assert maintained_counts(empty(spark), gone).count() == 0


def test_byte_pairs_count_as_the_vocabulary_does(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(k).decode()} {i}" for k, i in ranks.items()))
    pattern = r"\S+|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["abc ab", "", None, "xabcé"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in docs.select("doc_id", bpe(str(tmp_path / "v"), pattern)(F.col("text")).alias("n")).collect()}
    assert got == {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}


# WARC
def test_members_are_owned_by_the_range_of_their_start():
    r = random.Random(2)
    members = [warc.record(i, f"http://a/{i}", r.randbytes(r.randrange(5000)) + warc.MAGIC * 3) for i in range(30)]
    data = b"".join(members)
    starts = np.cumsum([0, *map(len, members)])[:-1].tolist()
    read = lambda at, n: data[at : at + n]
    for span in (777, 5000, len(data)):
        found = [o for s in range(0, len(data), span) for o, _ in warc.scan(read, s, min(len(data), s + span))]
        assert found == starts


def test_ranges_that_start_anywhere_find_all_members(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 97)
    r = random.Random(3)
    members = [warc.record(i, "u", r.randbytes(r.randrange(400))) for i in range(40)]
    data, starts = b"".join(members), np.cumsum([0, *map(len, members)])[:-1].tolist()
    for span in (50, 61, 333):
        assert [o for s in range(0, len(data), span) for o, _ in warc.scan(lambda at, n: data[at : at + n], s, min(len(data), s + span))] == starts


def test_lost_records_raise(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 50, None) for i in range(20)], "page_id long, url string, html string, refers_to long")
    files = warc.write_warc(pages.coalesce(1).select("page_id", "url", F.encode("html", "utf-8").alias("payload"), "refers_to"), f"file://{tmp_path}/a")
    records = warc.read_warc(spark, files)
    assert records.count() == 20
    warc.complete(records, files)
    path = files.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="records|digest"):
        warc.complete(warc.read_warc(spark, files), files)


def test_torn_members_are_left_out():
    data = warc.record(1, "u", b"x" * 100) + warc.record(2, "u", b"y" * 100)[:-30]
    assert len(list(warc.scan(lambda at, n: data[at : at + n], 0, len(data)))) == 1


def test_archives_equal_sql(spark):
    assert not differences(spark, connection(FOLDER), FOLDER, QUERIES["op2_warc"], SQL["op2_warc"])


def test_archive_round_trip(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nx: y", "é" * 70_000), (5, "http://d", "same"), (6, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for i, _, html in pages:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 5, 3, 6)] == [("revisit", 5), ("revisit", 5), ("response", None), ("revisit", 6), ("response", None)]
    files = warc.write_warc(df.select("page_id", "url", F.encode("html", "utf-8").alias("payload"), F.lit(None).cast("long").alias("refers_to")).where("payload IS NOT NULL"), Scratch(spark, "w").path("a"))
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, files, 1000).collect()} == {i: h for i, _, h in pages if h is not None}
    odd = spark.createDataFrame([(None, "u", "x"), (1, None, "x"), (1, "v", "x"), (1, "v", "y"), (2, "w", "y"), (2, "w", "y")], "page_id long, url string, html string")
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.archive_pages(odd).collect())
    assert found == [(0, "revisit", 1, 1), (1, "response", 0, 1), (1, "response", 0, 1), (1, "revisit", 2, 1), (2, "response", 0, 1), (2, "response", 0, 1)]
    assert warc.archive_pages(df.limit(0)).count() == 0


# Sharding
def test_longest_first():
    assert sharding.longest_first([5, 4, 3, 3, 3], list("abcde"), 2) == [0, 1, 1, 0, 1]


def test_shards_keep_groups_and_balance(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(sharding, "LAST", 60)
    monkeypatch.setattr(sharding, "BUCKET", 40)
    rows = [(i, words(random.Random(i % 300), 5 + i % 60), "en", "s") for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 4).toPandas()
    text = {r[0]: r[1] for r in rows}
    assert (got.text_crc32 == got.doc_id.map(lambda i: zlib.crc32(text[i].encode()))).all()
    assert got.assign(t=got.doc_id.map(text)).groupby("t").shard.nunique().max() == 1
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 0.03 * loads.sum()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard_documents(odd_docs, 3).count() == 9
    assert sharding.shard_documents(empty(spark), 3).count() == 0


def test_shards_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(i, words(random.Random(i % 50), 3 + i % 50 * 7), "en", "s") for i in range(150)] + [(900, None, "en", "s"), (901, "", "en", "s")]
    got = {x.doc_id: x.shard for x in sharding.shard_documents(spark.createDataFrame(r.sample(rows, len(rows)), DOCS), 5).collect()}
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(hashlib.sha1((t or "").encode()).hexdigest(), []).append((i, len((t or "").encode()) + 1))
    loads = [0] * 5
    for _, members in sorted(groups.items(), key=lambda g: (-sum(n for _, n in g[1]), g[0])):
        s = loads.index(min(loads))
        loads[s] += sum(n for _, n in members)
        assert all(got[i] == s for i, _ in members)


# Jaccard join
def tuple_sets(texts, width):
    """Shingles as tuples of words, by the contract's own words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in found]


def brute(texts, width, num, den):
    sets = tuple_sets(texts, width)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_texts(seed):
    r, texts = random.Random(seed), []
    shared = words(r, 60)
    for _ in range(12):
        base = words(r, r.choice([1, 2, 4, 9, 30, 120, 400])).split()
        for _ in range(r.choice([1, 3, 12, 40])):
            w = list(base)
            for _ in range(r.randrange(1 + max(1, len(w) // 25))):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w) + (" " + shared if r.random() < 0.3 else ""))
    return [*texts, "A b\x0bC\tÉ é", "a B c É É", "a\x1cb c", "x\u00a0y \u2003 z"]


@pytest.mark.parametrize(("width", "num", "den", "block", "bits"), [(3, 90, 100, 8, 64), (5, 8, 10, 8, 5), (5, 8, 10, 2048, 64), (2, 1, 2, 5, 64)])
def test_components_equal_brute_force(spark, monkeypatch, width, num, den, block, bits):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ID_BITS", bits)  # few bits: most sets share an identity and get new ones
    monkeypatch.setattr(jaccard_join, "FEW", 50 if block == 5 else 500_000)
    texts = near_texts(width)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {x.doc_id: x for x in jaccard_join.jaccard_components(docs, width, num, den).collect()}
    assert [got[i].component_id for i in range(len(texts))] == brute(texts, width, num, den)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in tuple_sets(texts, width)]


def test_frequent_elements_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOOK", 1)
    r = random.Random(9)
    base = words(r, 60).split()
    texts = [" ".join(base[:k] + [words(r, 1)] + base[k + 1 :]) for k in range(60)] + [words(r, 60) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, 5, 8, 10).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5, 8, 10)


def test_divide_skip_equals_counting():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(50)]
    lists = jaccard_join.Lists(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, t in ((i, t) for i in range(50) for t in (-2, 1, 3, 9, 20)):
        among = np.arange(50) != i
        found, shared = lists.search(i, t, among)
        want = {j: len(np.intersect1d(sets[i], sets[j])) for j in range(50) if j != i}
        assert dict(zip(found.tolist(), shared.tolist())) == {j: n for j, n in want.items() if n >= t}


def test_join_of_odd_rows(spark, odd_docs):
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd_docs).collect())
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [x[2] for x in got if x[0] in (4, 5)] == [4, 4] and [x[1:] for x in got if x[0] == 6] == [(1, 6), (1, 6)]
    clash = odd_docs.withColumns({"id": F.lit(1), "hash": F.lit(2), "comp": F.lit(3), "_id": F.lit(4), "HASH_": F.lit(5)})
    kept = jaccard_join.one_of_each(clash)
    assert kept.columns == clash.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0 and jaccard_join.one_of_each(empty(spark)).count() == 0


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    r = random.Random(2)
    a, b = words(r, 50), words(r, 50)
    docs = spark.createDataFrame([(1, a, "en", "s"), (1, b, "en", "s"), (2, a + " end", "en", "s"), (3, b, "en", "s"), (1, a + " more", "en", "s")], DOCS)
    got = [(x.doc_id, x.text.split()[0]) for x in jaccard_join.one_of_each(docs).collect()]
    assert sorted(got) == sorted([(1, a.split()[0]), (1, b.split()[0])])


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(80)}}


def test_components_of_nothing(spark):
    none = spark.createDataFrame([(None, 3), (7, 7)], "u long, v long")
    assert connected_components(none, Scratch(spark, "t")).count() == 0
    assert connected_components(none.limit(0), Scratch(spark, "t")).count() == 0


# Mixing
def test_targets_and_quotas():
    assert mixing.targets([10, 100, 100], [1, 1, 1]) == [Fraction(30), Fraction(90), Fraction(90)]
    want = [Fraction(x) for x in (53, 24, 23)]
    slow = [0, 0, 0]
    for _ in range(10):
        i = max(range(3), key=lambda i: want[i] / (2 * slow[i] + 1))
        slow[i] += 1
    assert mixing.sainte_lague(want, 10, [99] * 3) == slow


def test_mixture_meets_targets(spark, odd_docs):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, words(r, r.randrange(1, 200)), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(500)], DOCS)
    got = mixing.mix_documents(docs, by_shard=True).toPandas()
    by = got.groupby(["source_size", "target"]).taken.sum()  # two sources have equal weights, so equal targets
    assert len(by) == 4 and all(abs(n - t) <= 2 * mixing.BLOCK for (_, t), n in by.items())
    assert (got.taken <= 3 * got["size"]).all()
    assert (got.shard_words.map(sum) == got.taken).all()
    again = mixing.mix_documents(docs.repartition(7)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))
    kept = mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).toPandas()
    assert len(kept) == 4
    odd = mixing.mix_documents(odd_docs).toPandas()
    assert len(odd) == 9 and (odd.taken[odd["size"] == 0] == 0).all()
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_mixed_rows_meet_targets_with_whole_documents(spark):
    r = random.Random(8)
    rows = [(i, words(r, 4000 if i % 100 == 7 else r.randrange(1, 80)), "en", ["a", "a", "a", "b", "c", None][i % 6]) for i in range(600)]
    rows += [(1, "twice here", "en", "a"), (1, "twice here", "en", "a"), (1, "twice here", "en", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    sizes = {s: sum(len(x[1].split()) for x in rows if x[3] == s) for s in ("a", "b", "c", None)}
    want = dict(zip(sizes, mixing.targets(list(sizes.values()), [1, 2, 3, 1])))
    assert all(abs(x.n - want[x.source]) <= 80 for x in got) and len(got) == 4
    copies = mixing.mix_documents(docs).where("doc_id = 1 AND size = 2").groupBy("source_size").agg(F.count_distinct("copies")).collect()
    assert [x[1] for x in copies] == [1, 1]


def test_cuts_settle_however_many_large_documents_lie_on_them(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * (200 if r.random() < 0.3 else r.randrange(0, 3))), "en", ["a", "b", "c", "d", None][i % 5]) for i in range(3000)]
    sizes = {s: [len(x[1].split()) for x in rows if x[3] == s] for s in ("a", "b", "c", "d", None)}
    want = dict(zip(sizes, mixing.targets([sum(x) for x in sizes.values()], [1, 2, 3, 1, 2])))
    got = mixing.mixed(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert len(got) == 5 and all(abs(x.n - want[x.source]) <= sum(sizes[x.source]) / len(sizes[x.source]) / 2 for x in got)


def test_plans_of_many_sources_equal_those_of_few(spark):
    r = random.Random(6)
    sizes = {f"s{i}é" if i % 3 else f"S{i}\U0001f600": r.choice([0, 1, 7, 16, 16, 100, r.randrange(5000), r.randrange(100_000)]) for i in range(400)} | {None: 5000, "": 16}
    sources = spark.createDataFrame([(s, n, 3) for s, n in sizes.items()], "src string, n long, source_rows long")
    for options in ({}, {"weights": (5, 1), "most": 2, "shards": 3}, {"most": 1}):
        got = {x.of: (x.source_size, x.target, x.blocks, x.quotas, x.a, x.c) for x in mixing.plan_table(sources, Scratch(spark, "t"), **options).collect()}
        want = {x[0]: tuple(x[1:]) for x in mixing.plan(sizes, **options)}
        assert got == want and sum(sum(x[3]) for x in want.values()) > 1000


def test_more_sources_than_the_driver_plans_for(spark, monkeypatch):
    r = random.Random(7)
    rows = [(i, words(r, r.randrange(0, 90)), "en", r.choice(["a", "b", "c", "d", "e", None])) for i in range(300)] + [(1, None, "en", "z")]
    docs = spark.createDataFrame(rows, DOCS)
    few = sorted(map(str, mixing.mix_documents(docs, by_shard=True).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    assert sorted(map(str, mixing.mix_documents(docs, by_shard=True).collect())) == few
    empty_ones = mixing.mix_documents(docs.withColumn("text", F.lit(" "))).agg(F.count(F.lit(1)), F.sum("taken"), F.sum("copies")).first()
    assert tuple(empty_ones) == (301, 0, 0)


# Decontamination
def test_leaks_equal_brute_force(spark, odd_docs):
    r = random.Random(4)
    vocabulary = [words(r, 1) + words(r, 1) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(12, 60))) for i in range(20)] + [(20, "of the"), (21, None), (22, "")]
    docs, want = [], set()
    for i in range(300):
        t = text(r.randrange(20, 300)).split()
        if i % 10 == 0:
            j = r.randrange(20)
            copy = items[j][1].split()
            for _ in range(len(copy) // 12):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            at = r.randrange(len(t))
            t = t[:at] + copy + t[at:]
            want.add((i, j))
        docs.append((i, " ".join(t), "en", "s"))
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert decontamination.without_leaks(docs, bench).count() == 300 - len({d for d, _ in got})
    assert decontamination.find_leaks(odd_docs, bench).count() == 0
    assert decontamination.find_leaks(empty(spark), bench.limit(0)).count() == 0


@pytest.mark.parametrize("apart", [False, True])
def test_paraphrases_with_the_answer_kept_are_all_found(spark, apart):
    r = random.Random(6)
    vocabulary = [words(r, 1) + words(r, 1) for _ in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.randrange(12, 60)), text(r.randrange(1, 6))) for i in range(24)]
    docs, want = [], set()
    for i in range(240):
        t = text(r.randrange(20, 300))
        if i % 2 == 0:
            j, lost, out = i // 2 % 24, (0, 0.25, 0.35, 0.45, 0.5)[i // 48], i // 2 % 2
            copy, tail = list(items[j][1]), 0 if apart else 5
            gone = set(r.sample(range(len(copy) - tail), int(lost * (len(copy) - tail))))
            copy = [r.choice(vocabulary) if k in gone else w for k, w in enumerate(copy) if not (out and k in gone)]
            at = r.randrange(len(t))
            t = t[:at] + copy + (items[j][2] if apart else []) + t[at:]
            want.add((i, j))
        docs.append((i, " ".join(t), "en", "s"))
    rows = [(i, " ".join(w), " ".join(a) if apart else None) for i, w, a in items]
    bench = spark.createDataFrame(rows, "item_id long, text string, answer string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == want


def test_search_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = [words(r, 1) + words(r, 1) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randrange(12, 20)) for _ in range(8)]
    docs = []
    for i in range(48):
        t, copy = text(r.randrange(10, 40)), list(items[i % 8])
        lost = r.choice([0, 0.1, 0.2, 0.3, 0.45])
        copy = [r.choice(vocabulary) if k < len(copy) - 5 * (lost > 0.2) and r.random() < lost else w for k, w in enumerate(copy)]
        docs.append(t[:5] + (copy if i % 3 else []) + t[5:])

    def common(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
        return best[-1]

    def held(doc, item):
        pad, n, answer = 4 + len(item) // 4, len(item), item[-5:]
        for at in range(-n, len(doc)):
            own = doc[max(0, at - pad) : max(0, at) + n + pad]
            part = common(item, own) / n
            if part >= 0.8 or part >= 0.5 and any(own[k : k + 5] == answer for k in range(len(own))):
                return True
        return False

    want = {(i, j) for i, d in enumerate(docs) for j, x in enumerate(items) if len(set(d) & set(x)) >= len(set(x)) // 2 and held(d, x)}
    df = spark.createDataFrame([(i, " ".join(d), "en", "s") for i, d in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(df, bench).collect()}
    assert len(want) > 20 and got <= want and len(got) >= 0.9 * len(want)


def test_namesakes_and_null_ids_are_judged_by_their_texts(spark):
    r = random.Random(3)
    item, clean = words(r, 40), words(r, 60)
    docs = spark.createDataFrame([(1, item, "en", "s"), (1, clean, "en", "s"), (None, item, "en", "s"), (None, clean, "en", "s"), (2, None, "en", "s")], DOCS).withColumns({"id": F.lit(1), "hash": F.lit(2)})
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((x.doc_id or 0, x.text == clean) for x in kept.collect()) == [(0, True), (1, True), (2, False)]


def test_long_items_keep_memory_linear():
    places = {}
    for k in range(60_000):
        places.setdefault(k % 59_000, []).append(k)
    assert decontamination.lcs(places, 60_000, list(range(0, 2000))) == 2000


def test_words_and_subsequence():
    ids, sizes = decontamination.split_words(["Hello, hello WORLD", None, "é-É", "x" * 10])
    assert sizes.tolist() == [3, 0, 2, 1] and ids[0] == ids[1] and ids[3] == ids[4]
    masks = {}
    for k, x in enumerate("abcbdab"):
        masks.setdefault(x, []).append(k)
    assert decontamination.lcs(masks, 7, list("bdcaba")) == 4


# Language
def test_languages_of_held_out_and_mixed_texts(spark, odd_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op7_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2).all()
    d = docs.toPandas()
    en, fr = (d[d.lang == x].text.iloc[0][:1500] for x in ("en", "fr"))
    both = spark.createDataFrame([(0, en + " " + fr[:500], None, None)], DOCS)
    shares = language_id.identify(both, docs).first().language.proportions
    assert set(shares) == {"en", "fr"} and 0.6 < shares["en"] < 0.9
    odd = {r.doc_id: r.language.lang_pred for r in language_id.identify(odd_docs, docs).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[7] == "und" and odd[4] == odd[5] != "und"
    assert {r.language.lang_pred for r in language_id.identify(odd_docs, docs.limit(0)).collect()} == {"und"}
    assert language_id.identify(empty(spark), docs).count() == 0


# Personal data
def test_base_spans():
    text = "a@b@c.com, 1.2.3.4 and 1.2.3.999; 4111 1111 1111 1111 +1 (555) 123-4567"
    plain = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.PATTERNS[kind].finditer(text) if pii.valid(kind, m[0]))
    assert pii.base_spans(text) == plain and [k for _, k, _ in plain] == [0, 1, 2, 3]


def test_base_spans_are_found_in_linear_time_and_in_order():
    r = random.Random(7)
    for _ in range(300):
        text = "".join(r.choice("0123456789...1 -+@ab()") for _ in range(60))
        plain = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.PATTERNS[kind].finditer(text) if pii.valid(kind, m[0]))
        assert pii.base_spans(text) == plain
    began = time.time()
    pii.base_spans("7" * 200_000 + "." + "1.2.3" * 50_000 + "a" * 100_000 + "@")
    assert time.time() - began < 5


def test_tagger_adds_what_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train_tagger(docs.select("doc_id", "text"))
    r = random.Random(99)
    host = [x.text for x in docs.where("length(text) > 400").orderBy("doc_id").limit(200).collect()]
    texts, want = [], []
    for i in range(400):
        inside, before = pii.disguised(i % 4, r), r.choice(host)[:200] + " "
        text, at = before + inside + " " + r.choice(host)[:150], len(before)
        if not any(s < at + len(inside) and at < e for s, _, e in pii.base_spans(text)):
            texts.append(text)
            want.append((at, i % 4, at + len(inside)))
    added = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
    for k in range(4):
        hits = [w in x for w, x in zip(want, added) if w[1] == k]
        assert len(hits) > 30 and sum(hits) >= 0.9 * len(hits)
    clean = [t for t in host if not any(c.isdigit() or c == "@" for c in t)]
    assert not any(pii.added_spans(clean, [[] for _ in clean], tagger))
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 40).alias("doc_id"), "text"))
    # The 40 texts are training windows too; what the patterns miss in them has no label there.
    found = {r.doc_id: r.spans for r in pii.find_personal_data(more).where("doc_id < 40 AND n_added > 0").collect()}
    assert sum(pii.spell([(s, k, e)]) in found.get(i, "") for i, (s, k, e) in enumerate(want[:40])) >= 34


def test_crf_marginals_and_best_path_equal_enumeration():
    r = np.random.default_rng(1)
    e, tr = r.normal(size=(4, 1, pii.TAGS)), r.normal(size=(pii.TAGS, pii.TAGS))
    paths = np.array(np.meshgrid(*[range(pii.TAGS)] * 4)).reshape(4, -1).T
    s = sum(e[t, 0, paths[:, t]] for t in range(4)) + sum(tr[paths[:, t], paths[:, t + 1]] for t in range(3))
    p = np.exp(s - s.max())
    p /= p.sum()
    single, _ = pii.marginals(e, tr, np.array([4]), True)
    assert np.allclose([single[1, 0, k] for k in range(pii.TAGS)], [p[paths[:, 1] == k].sum() for k in range(pii.TAGS)])
    assert pii.viterbi(e, tr, np.array([4]))[:, 0].tolist() == paths[s.argmax()].tolist()


def test_tagger_gradient():
    tagger = pii.Tagger()
    tagger.p = {k: a.astype(np.float64) for k, a in tagger.p.items()}  # finite differences of 1e-5 need it
    r = np.random.default_rng(2)
    c, y = r.integers(1, 100, (3, 6)), r.integers(0, 2, (3, 6))
    y[2, 1:3] = -1

    def loss():
        e = tagger.scores(c).transpose(1, 0, 2)
        z = pii._lse(_forward(e, tagger.p["tr"]), 1)
        known = np.where((y.T[:, :, None] >= 0) & (np.arange(pii.TAGS) != y.T[:, :, None]), -1e4, 0)
        return float((z - pii._lse(_forward(e + known, tagger.p["tr"]), 1)).mean())

    def _forward(e, tr):
        f = e[0]
        for t in range(1, len(e)):
            f = e[t] + pii._lse(f[:, :, None] + tr[None], 1)
        return f

    g = tagger.gradient(c, y)
    for name, at in (("wx0", (1, 3)), ("wh1", (2, 40)), ("emb", (int(c[0, 2]), 1)), ("tr", (0, 1)), ("wo", (3, 1)), ("b1", (5,))):
        keep = tagger.p[name][at]
        tagger.p[name][at] = keep + 1e-5
        up = loss()
        tagger.p[name][at] = keep - 1e-5
        down = loss()
        tagger.p[name][at] = keep
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_personal_data_of_odd_rows(spark, odd_docs):
    more = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(9, "mail x.y@z.example.com now 10.0.0.1")], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find_personal_data(more).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert (got[9].n_email, got[9].n_ip) == (1, 1) and got[9].spans.startswith("email:5:22,ip:27:35")
    assert pii.find_personal_data(empty(spark)).count() == 0


# Embeddings
def near_rows(seed, dim, groups, most, noise):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(groups):
        base = r.normal(size=dim)
        rows += [(len(rows) + k, (base + r.normal(size=dim) * noise).tolist(), int(i % 3)) for k in range(r.integers(1, most))]
    return rows


@pytest.mark.parametrize(("dim", "groups", "most", "noise"), [(32, 60, 6, 0.06), (64, 150, 12, 0.085), (64, 12, 60, 0.09)])
def test_links_of_vectors_equal_brute_force(spark, dim, groups, most, noise):
    rows = near_rows(5, dim, groups, most, noise)
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, 1), (n + 2, [0.0] * dim, 1), (n + 3, [float("nan")] * dim, 1), (n + 4, rows[0][1], None), (n + 5, [1.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1))
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    x = np.array([v for _, v, _ in rows[: n + 1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows[: n + 1]])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    links = near.sum(1) - 1
    found = np.array([got[i].n_links for i in range(n + 1)])
    assert links.sum() > 50 and (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n + 1, n + 6))
    assert near_vectors(df.limit(0)).count() == 0


def test_keys_widen_with_the_rows_of_a_label():
    plans = [embedding_dedup.plan_tables(n) for n in (0, 1000, 100_000, 10_000_000, 10**12)]
    assert [p[0] for p in plans] == [10, 10, 17, 24, 24]
    for width, each, words in plans:
        bits, differ = width * each * words, np.arccos(0.98) / np.pi
        assert 2 * each * words - 1 >= bits * differ + 2 * np.sqrt(bits * differ * (1 - differ)) or words == 16


def test_copies_link_across_batches_with_and_without_null_labels(spark):
    v, other = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    parts = [[(1, v, 3), (2, other, None)], [(3, v, 3), (4, v, 4)], [(5, v, 3), (6, v, None)]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(lambda x: x), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (0, 2, True), 3: (2, 1, False), 4: (0, 4, True), 5: (2, 1, False), 6: (0, 6, True)}


def test_the_sample_for_the_rotation_is_bounded(spark, monkeypatch):
    """By vectors and numbers, if ids are null or equal, copies many and single vectors long."""
    rows = near_rows(3, 2000, 60, 8, 0.09)
    n = len(rows)
    rows += [(None, r[1][:16], 1) for r in rows for _ in range(5)] + [(n, [float(i % 7 - 3) for i in range(100_000)], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    shapes, learn = [], embedding_dedup.learn_rotation
    monkeypatch.setattr(embedding_dedup, "learn_rotation", lambda sample, bits: shapes.append(sample.shape) or learn(sample, bits))
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 100)
    got = near_vectors(df).collect()
    assert len(shapes) == 1 and 20 < shapes[0][0] < 150 and shapes[0][1] <= 1024
    x = np.array([v for _, v, _ in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for _, _, k in rows[:n]])
    links = ((x @ x.T >= 0.98) & (label[:, None] == label[None])).sum(1) - 1
    found = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    assert len(got) == len(rows) and found[n] == 0 and links.sum() > 50
    assert all(found[i] <= links[i] for i in range(n)) and sum(found[i] for i in range(n)) >= 0.95 * links.sum()
    assert all(r.n_links >= 4 for r in got if r.vec_id is None)


# URLs
def test_url_rules_and_aliases(spark):
    page = lambda i, url, html="": (i, url, html)
    rows = [
        page(1, "http://x.EXAMPLE.org/en/12?q#f"), page(2, "http://example.org/es/a"), page(3, "no scheme"), page(4, None, None), page(5, "http://a.com/de/x"),
        page(6, "http://a.net/1", '<link href="http://a.com/de/x" rel="canonical">'), page(7, "http://a.net/2", '<META http-equiv=refresh content="0; URL=/1">'),
        page(8, "http://b.net/1", '<link rel=canonical href="http://q.org/ok">'), page(9, "http://b.net/2", '<link rel=canonical href="1">'), page(10, "http://b.net/1#top", ""),
        page(11, "http://c.net/"), page(12, "http://b.net/3", '<link rel=canonical href="//a.com/de/z"><meta http-equiv="refresh" content="5;url=http://b.net/1">'),
    ]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("example.org/es/", "block") and got[3] == got[4] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == (None, "block")
    assert all(got[i][2:] == (None, "allow") for i in (8, 9, 10, 11, 12))


def test_verdicts_equal_brute_force(spark):
    r = random.Random(12)
    hosts = ["a.org", "b.com", "x.example.org", "c.net", "d.net", "e.io"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['fr', 'de', 'es', 'en', 'z'])}/{i}" for i in range(120)]
    target = {i: r.randrange(120) for i in range(120) if r.random() < 0.6}
    pages = [(i, u, f'<LINK rel="canonical" href="{urls[target[i]]}">' if i in target else "<p>") for i, u in enumerate(urls)]
    pages += [(3, *pages[3][1:]), (None, urls[5], None), (500, "http://" + "h" * 30_000 + "/" + "p" * 30_000, "<a>" * 50_000)]
    redirects = [(urls[i], urls[(i * 7) % 120]) for i in range(0, 120, 9)] + [(None, "x"), ("x", None)]
    root = list(range(120))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in [*target.items(), *((i, (i * 7) % 120) for i in range(0, 120, 9))]:
        root[find(i)] = find(j)

    def own(url):
        host, _, path = url.split("://")[1].partition("/")
        fits = [(len(h + p), says) for says, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    group = {}
    for i, u in enumerate(urls):
        group.setdefault(find(i), set()).add(own(u))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = url_filter.filter_urls(df, redirects=spark.createDataFrame(redirects, "url string, target string")).collect()
    assert len(got) == len(pages)
    for x in got:
        if x.page_id is not None and x.page_id < 120:
            kinds = group[find(x.page_id)]
            assert x.verdict == (own(urls[x.page_id]) or ("allow" if "allow" in kinds or "block" not in kinds else "block"))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_plan_has_no_python(spark):
    plan = QUERIES["op10_url_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    a, leak = words(r, 80), words(r, 40)
    more = [(20 + i, words(r, 60), "en" if i % 2 else None, "a") for i in range(12)] + [(50, a, "en", "b"), (51, a + " tail", "en", "b"), (51, a + " tail", "en", "b"), (52, words(r, 20) + " " + leak, "en", "c")]
    docs = odd_docs.drop("n", "sid", "size", "b", "rank").unionByName(spark.createDataFrame(more, DOCS)).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({"language": F.lit("x"), "_id": F.lit(1), "_hash": F.lit(2), "_copies": F.lit(3), "id": F.lit(4), "hash": F.lit(5)})
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    folder = f"file://{tmp_path}/sf"
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert sorted(x.doc_id for x in pipeline.near_duplicates(spark, docs.where("doc_id >= 20"), folder).collect()) == [*range(20, 32), 50, 52]
    ids = {x.doc_id for x in pipeline.run(spark, folder).collect()}
    assert ids and 51 not in ids and 52 not in ids and not ids & {1, 2, 3, 5}


def test_pipeline_keeps_clean_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    told = pipeline.language(spark, docs, FOLDER)
    assert told.columns == docs.columns and told.count() >= 0.98 * docs.count()
    rest = pipeline.decontamination(spark, told, FOLDER)
    bad = decontamination.find_leaks(told, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).select("doc_id").distinct().count()
    assert rest.count() == told.count() - bad
    assert pipeline.shards(spark, pipeline.mixture(spark, rest, FOLDER), FOLDER).select("shard").distinct().count() == 8
