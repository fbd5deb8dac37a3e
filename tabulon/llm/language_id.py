"""Language identification by multilingual mixture inference.

Learning: character trigram counts of every labelled document, hashed to ``BUCKETS`` features, summed by
Spark; smoothed logarithms are each language's n-gram likelihoods. Inference: a document is a sequence of
words (runs of letters and marks), each drawn from one language of a mixture. Expectation-maximisation over the
words' likelihoods estimates the proportions. The set of languages is chosen among the sets of the most
frequent ones by penalised likelihood (BIC). All documents of an Arrow batch are inferred together with
numpy; whole texts are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch

BUCKETS = 1 << 14
ROUNDS = 12
#: Code points that a step of inference holds at most, besides those of its last document.
STEP = 1 << 18

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point up to U+FFFF, 2 for a letter, 1 for a mark, which belongs to words too, else 0."""
    if not _letters:
        _letters.append(np.array(["-ML".find(unicodedata.category(chr(i))[0]) for i in range(65536)]).clip(0).astype(np.int8))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, word number and document number of every trigram; words are padded by one blank each side."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low])
    kind = letters()[np.minimum(cp, 65535)]
    for c in np.unique(cp[cp > 65535]).tolist():
        kind[cp == c] = max(0, "-ML".find(unicodedata.category(chr(c))[0]))
    bare = (kind == 1) & (np.concatenate([np.zeros(1, np.int8), kind[:-1]]) == 0)  # marks that follow no letter count as none
    code = np.where((kind > 0) & ~bare, cp, 0).astype(np.uint64)
    code = np.concatenate([np.zeros(1, np.uint64), code, np.zeros(1, np.uint64)])
    at = np.flatnonzero(code[1:-1])  # a trigram for each letter, its neighbours or blanks beside it
    h = (code[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 2]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    word = np.cumsum(code[at] == 0) - 1
    return h.astype(np.int64), word, np.searchsorted(ends, at, side="right")


def pieces(texts: Iterable[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, own in b.groupby("lang")["text"]:
            for part in pieces(own):
                h, _, _ = trigrams(part)
                total[lang] = total.get(lang, 0) + np.bincount(h, minlength=BUCKETS)
    for lang, c in total.items():
        g = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "gram": g, "n": c[g]})


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log likelihoods (BUCKETS, languages) from rows (text, lang); null ones don't count.

    The counts come to the driver: BUCKETS numbers for each language, whatever the number of documents.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = rows.mapInPandas(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    c = np.zeros((BUCKETS, len(langs)))
    c[counts["gram"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = counts["n"]
    return langs, np.log((c + 0.05) / (c.sum(0) + 0.05 * BUCKETS)).astype(np.float32)


def mixture(like: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (n, languages) and the log likelihood (n) for words with log likelihoods like and ordered doc numbers."""
    k = like.shape[1]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    have, size = doc[starts], np.diff(np.r_[starts, len(doc)])
    top = like.max(1, keepdims=True)
    p = np.exp(np.maximum(like - top, -60)).astype(np.float64)

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            r = p * np.repeat(pi, size, axis=0)
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            pi = np.add.reduceat(r, starts) / size[:, None]
        r = (p * np.repeat(pi, size, axis=0)).sum(1)
        return pi, np.add.reduceat(np.log(np.maximum(r, 1e-300)) + top[:, 0], starts)

    best, score = fit(np.ones((len(have), k)))
    rank = np.argsort(np.argsort(-best, axis=1, kind="stable"), axis=1, kind="stable")
    chosen, value = np.zeros_like(best), np.full(len(have), -np.inf)
    for m in range(1, k + 1):  # until no document's set grows
        pi, ll = fit((rank < m) * np.maximum(best, 1e-6))
        worth = ll - 0.5 * (m - 1) * np.log(size + 1.0) - (m - 1)
        up = worth > value + 1e-9
        chosen[up], value[up] = pi[up], worth[up]
        if not up.any():
            break
    out, total = np.zeros((n, k)), np.zeros(n)
    out[have], total[have] = chosen, value
    return out, total


def language_of(langs: list[str], logp: np.ndarray):
    """A column function of texts: struct of lang_pred, score and proportions (map of the chosen set)."""

    @F.pandas_udf("lang_pred string, score double, proportions map<string,double>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pred, score, shares = [], [], []
            for part in pieces(b.fillna("")):
                h, word, doc = trigrams(part)
                if not len(h) or not langs:
                    pred += ["und"] * len(part)
                    score += [0.0] * len(part)
                    shares += [{}] * len(part)
                    continue
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                pi, _ = mixture(np.add.reduceat(logp[h], first), doc[first], len(part))
                for x in pi:
                    i = int(x.argmax())
                    pred.append(langs[i] if x[i] > 0 else "und")
                    score.append(float(min(1.0, x[i])))
                    shares.append({langs[j]: float(x[j]) for j in np.flatnonzero(x > 0).tolist()})
            yield pd.DataFrame({"lang_pred": pred, "score": score, "proportions": shares})

    return infer


def identify(docs: DataFrame, labelled: DataFrame, name: str = "language") -> DataFrame:
    """docs with a column ``name``: lang_pred, score (its proportion) and proportions (map of the chosen set).

    A null text, one without letters, and any text when nothing was learned are ``und`` with score 0.
    Equal texts get equal answers; lang, source and ids are not read here. Empty tables give empty ones.
    A column of docs that is called ``name`` is replaced. Of equal proportions the language first in order is taken.
    """
    Scratch(docs.sparkSession, "lang")
    return docs.withColumn(name, language_of(*learn(labelled))(F.col("text")))


def held_out(doc_id):
    """Whether crc32 of the id as text is 2 modulo 4 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
