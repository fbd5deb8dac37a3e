"""Personal data by base patterns and a character-level bidirectional LSTM with CRF transitions, in numpy.

The base patterns find what they describe in every whole text. The tagger is trained on the driver from
labelled spans: windows of a bounded sample of documents labelled by the patterns, and the same kinds
written in other ways (without a plus, with other separators or blanks around them) as well as harmless
numbers put into such windows. What the patterns pass over but could be a kind all the same, enough digits close together
or an ``@``, has no label there: the likelihood is summed over all its tags. Kinds spelled in words alone, without a digit
or an ``@``, aren't looked for. The tagger reads every window
of a text that holds a digit or an ``@``: no kind can do without either. Windows overlap by half; each
character takes the scores of the window in which it is most central, stitched stretches are decoded by the CRF in pieces
that overlap by far more than a span, each span taken from the piece that owns its start, and a decoded span is added where its marginal probability is high, it has the
substance of its kind and it doesn't touch a base span.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WINDOW, HOP = 64, 32
#: Windows of the training sample at most; disguised instances for each of them, and in all at least.
SAMPLE, DISGUISED, LEAST_DISGUISED = 2000, 2, 2400
HIDDEN, EMBED = 20, 12
SURE = 0.8
#: Characters that the CRF decodes at a time, what pieces overlap on each side (with HOP-aligned pieces, windows are the same), and characters of a group of pieces.
PIECE, MARGIN, GROUP = 4096, 256, 1 << 17
#: What may be a kind that the patterns don't know: four numbers or ten digits close together, or an ``@`` and what is around it.
_MAYBE = re.compile(r"[+(\[{]*[0-9]+(?:[^A-Za-z0-9\n]{1,4}[0-9]+){3,}|[+(\[{]*[0-9](?:[^A-Za-z0-9\n]{0,3}[0-9]){9,}|[A-Za-z0-9._%+-]*[ (\[{<]{0,3}@[ )\]}>]{0,3}[^\s@]*(?: ?[.] ?[A-Za-z0-9-]+)*")

_DIGITS = re.compile(r"[^0-9]")
_TRIGGER, _TRIGGERS = re.compile(r"[0-9@]"), re.compile(r"[0-9@]+")
_NUMBERS, _NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in found.split("."))
    digits = _DIGITS.sub("", found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' valid matches, leftmost and not overlapping within a kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if _TRIGGER.search(text):
        for k in (1, 2, 3):
            if k == 1:
                out += _ips(text)
            elif k != 3 or "+" in text:
                out += [(m.start(), k, m.end()) for m in PATTERNS[KINDS[k]].finditer(text) if valid(KINDS[k], m[0])]
    return sorted(out)


def _ips(text: str) -> list[tuple[int, int, int]]:
    """The ip pattern's valid matches: each run of numbers with single dots between them gives its fours in order, so the scan is linear."""
    out = []
    for chain in _NUMBERS.finditer(text):
        parts = list(_NUMBER.finditer(text, chain.start(), chain.end()))
        for i in range(0, len(parts) - 3, 4):
            start, end = parts[i].start(), parts[i + 3].end()
            if valid("ip", text[start:end]):
                out.append((start, 1, end))
    return out


def _emails(text: str) -> Iterator[re.Match]:
    """The email pattern's matches; only the run of local characters before each ``@`` is tried, so the scan is linear."""
    local, at, done = re.compile(r"[A-Za-z0-9._%+-]+\Z"), text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := PATTERNS["email"].match(text, start)):
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Characters: ASCII by itself, others by whether they are letters; 0 pads.
CHARS = 131


def chars(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, cp + 1, np.where(cp < 0x2000, 129, 130)).astype(np.int64)


TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


class Tagger:
    """Embeddings, an LSTM in each direction, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        self.p = {
            "emb": r.normal(0, 0.3, (CHARS, e)), "wx0": r.normal(0, e**-0.5, (e, 4 * h)), "wh0": r.normal(0, h**-0.5, (h, 4 * h)), "b0": np.zeros(4 * h),
            "wx1": r.normal(0, e**-0.5, (e, 4 * h)), "wh1": r.normal(0, h**-0.5, (h, 4 * h)), "b1": np.zeros(4 * h),
            "wo": r.normal(0, (2 * h) ** -0.5, (2 * h, TAGS)), "bo": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS)),
        }
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.p["b0"][h : 2 * h] = self.p["b1"][h : 2 * h] = 1.0
        for k in range(len(KINDS)):  # inside follows its own kind only
            for t in range(TAGS):
                if t not in (1 + 2 * k, 2 + 2 * k):
                    self.p["tr"][t, 2 + 2 * k] = -8.0

    def _run(self, x: np.ndarray, d: int, keep: bool):
        """Hidden states (time, batch, HIDDEN) of one direction for inputs x (time, batch, EMBED)."""
        wh, h = self.p[f"wh{d}"], HIDDEN
        z = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        n, b = x.shape[:2]
        hs, cs, gates = np.zeros((n + 1, b, h), z.dtype), np.zeros((n + 1, b, h), z.dtype), np.zeros((n, b, 4 * h), z.dtype) if keep else None
        for t in range(n):
            g = z[t] + hs[t] @ wh
            s = 1 / (1 + np.exp(-g[:, : 3 * h]))
            u = np.tanh(g[:, 3 * h :])
            cs[t + 1] = s[:, h : 2 * h] * cs[t] + s[:, :h] * u
            hs[t + 1] = s[:, 2 * h :] * np.tanh(cs[t + 1])
            if keep:
                gates[t, :, : 3 * h], gates[t, :, 3 * h :] = s, u
        return hs, cs, gates

    def scores(self, c: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, TAGS) of character windows (batch, time)."""
        x = self.p["emb"][c.T]
        a, b = self._run(x, 0, False)[0][1:], self._run(x[::-1], 1, False)[0][1:][::-1]
        return (np.concatenate([a, b], 2) @ self.p["wo"] + self.p["bo"]).transpose(1, 0, 2)

    def _back(self, x, d, state, dh):
        hs, cs, gates = state
        h, grads = HIDDEN, {}
        dz, carry_h, carry_c = np.zeros_like(gates), np.zeros_like(hs[0]), np.zeros_like(cs[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, u = (gates[t, :, k * h : (k + 1) * h] for k in range(4))
            tc = np.tanh(cs[t + 1])
            g = dh[t] + carry_h
            gc = carry_c + g * o * (1 - tc * tc)
            dz[t] = np.concatenate([gc * u * i * (1 - i), gc * cs[t] * f * (1 - f), g * tc * o * (1 - o), gc * i * (1 - u * u)], 1)
            carry_h, carry_c = dz[t] @ self.p[f"wh{d}"].T, gc * f
        flat = lambda a: a.reshape(-1, a.shape[-1])
        grads[f"wx{d}"], grads[f"wh{d}"], grads[f"b{d}"] = flat(x).T @ flat(dz), flat(hs[:-1]).T @ flat(dz), flat(dz).sum(0)
        return grads, dz @ self.p[f"wx{d}"].T

    def gradient(self, c: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log likelihood of tags y (batch, time); -1 is an unknown tag, summed over."""
        x = self.p["emb"][c.T]
        s0, s1 = self._run(x, 0, True), self._run(x[::-1], 1, True)
        both = np.concatenate([s0[0][1:], s1[0][1:][::-1]], 2)
        e = both @ self.p["wo"] + self.p["bo"]
        n, b = e.shape[:2]
        de, dtr = marginals(e, self.p["tr"], np.full(b, n), True)
        sure = (y >= 0).all(1)
        at = np.flatnonzero(sure)
        de[np.arange(n)[:, None], at[None], y[at].T] -= 1
        np.add.at(dtr, (y[at, :-1].ravel(), y[at, 1:].ravel()), -1)
        if len(at) < b:  # what the known tags leave possible
            rest = np.flatnonzero(~sure)
            barred = np.where((y[rest].T[:, :, None] >= 0) & (np.arange(TAGS) != y[rest].T[:, :, None]), -1e4, 0.0)
            single, pair = marginals(e[:, rest] + barred, self.p["tr"], np.full(len(rest), n), True)
            de[:, rest] -= single
            dtr = dtr - pair
        de /= b
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"wo": flat(both).T @ flat(de), "bo": flat(de).sum(0), "tr": dtr / b}
        dh = de @ self.p["wo"].T
        g0, dx0 = self._back(x, 0, s0, dh[:, :, :HIDDEN])
        g1, dx1 = self._back(x[::-1], 1, s1, dh[::-1, :, HIDDEN:])
        demb = np.zeros_like(self.p["emb"])
        np.add.at(demb, c.T.ravel(), flat(dx0 + dx1[::-1]))
        return g | g0 | g1 | {"emb": demb}

    def train(self, c: np.ndarray, y: np.ndarray, rounds: int = 1200, batch: int = 64, rate: float = 0.02, seed: int = 4) -> None:
        """Adam over windows c and tags y (windows, WINDOW)."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            at = r.integers(0, len(c), batch)
            g = self.gradient(c[at], y[at])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.p[k] -= rate * (1 - 0.8 * step / rounds) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def marginals(e: np.ndarray, tr: np.ndarray, size: np.ndarray, pairs: bool = False):
    """Tag probabilities (time, batch, TAGS) of scores e under transitions tr for sequences of given sizes, and summed pair probabilities."""
    n, b, k = e.shape
    f, g = np.zeros((n, b, k)), np.zeros((n, b, k))
    f[0] = e[0]
    for t in range(1, n):
        f[t] = np.where((t < size)[:, None], e[t] + _lse(f[t - 1][:, :, None] + tr[None], 1), f[t - 1])
    for t in range(n - 2, -1, -1):
        g[t] = np.where((t + 1 < size)[:, None], _lse(tr[None] + (e[t + 1] + g[t + 1])[:, None, :], 2), 0)
    total = _lse(f[-1], 1)
    single = np.exp(f + g - total[None, :, None])
    if not pairs:
        return single, None
    both = np.zeros((k, k))
    for t in range(1, n):
        both += np.exp(f[t - 1][:, :, None] + tr[None] + (e[t] + g[t])[:, None, :] - total[:, None, None]).sum(0)
    return single, both


def viterbi(e: np.ndarray, tr: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best tags (time, batch) of scores e (time, batch, TAGS); beyond a sequence's size the values mean nothing."""
    n, b, k = e.shape
    back, f = np.zeros((n, b, k), np.int64), e[0]
    stay = np.broadcast_to(np.arange(k), (b, k))
    for t in range(1, n):
        s = f[:, :, None] + tr[None]
        on = (t < size)[:, None]
        back[t] = np.where(on, s.argmax(1), stay)
        f = np.where(on, s.max(1) + e[t], f)
    out = np.zeros((n, b), np.int64)
    out[-1] = f.argmax(1)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t][np.arange(b), out[t]]
    return out


def _tags(size: int, spans: Iterable[tuple[int, int, int]], lo: int = 0) -> np.ndarray:
    y = np.zeros(size, np.int64)
    for s, k, e in spans:
        if s - lo < size and e > lo:
            y[max(0, s - lo) : e - lo] = 2 + 2 * k
            if s >= lo:
                y[s - lo] = 1 + 2 * k
    return y


def disguised(kind: int, r: random.Random) -> str:
    """A made-up instance of a kind, in a way of writing that the base patterns may not know."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    blank = lambda x: r.choice(["", "", " "]) + x + r.choice(["", "", " "])
    mark = blank(r.choice("!#$%&*+,-./:;<=>?|'^\u00b7\u2013"))  # any mark may stand between numbers
    if kind == 0:
        name, host = word() + r.choice(["", ".", "_", "-"]) + r.choice([word(), digits(2)]), word() + r.choice(["", digits(1), "-" + word()])
        return name + r.choice([blank("@"), blank("@"), blank("@"), "(@)", " [@] "]) + host + blank(".") + r.choice(["com", "org", "net", "example.com", "co.uk", "de", word()])
    if kind == 1:
        return r.choice([blank("."), blank("."), "[.]", "(,)", "-", " ", mark, mark]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = r.choice("3456") + digits(r.choice([13, 14, 14, 14, 15]))
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice([".", " ", "-", "", "/", " - ", "  ", mark]).join(body[i : i + 4] for i in range(0, len(body), 4))
    parts = [digits(n) for n in r.choice([(3, 3, 4), (3, 4, 4), (2, 4, 4), (4, 3, 3)])]
    between = r.choice(["-", ".", " ", "/", " - ", "-", " ", mark])
    head = r.choice(["", "", "+1 ", "001 ", "00 44 ", "1-", "0"])
    return head + (f"({parts[0]}) " if r.random() < 0.4 else parts[0] + between) + between.join(parts[1:])


def harmless(r: random.Random) -> str:
    """Numbers that are no personal data: dates, times, amounts, versions, measures, lists of years."""
    n = lambda lo, hi: str(r.randint(lo, hi))
    day = r.choice(["-", "/", "."]).join([n(1900, 2099), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"])
    clock = f"{r.randint(0, 23):02}:{r.randint(0, 59):02}" + r.choice(["", f":{r.randint(0, 59):02}"])
    return r.choice([
        day, clock, f"{day} {clock}", f"{day}T{clock}", n(0, 9999), f"{r.uniform(0, 1e6):,.2f}", f"{n(1, 99)}.{n(0, 99)}%", f"v{n(0, 20)}.{n(0, 30)}.{n(0, 99)}", f"${n(1, 999)}.{n(10, 99)}", f"{n(1, 500)}x{n(1, 500)}",
        ", ".join(n(1900, 2030) for _ in range(r.randint(2, 4))), f"{n(1, 20)}-{n(21, 99)}", f"[{n(1, 99)}]", f"No. {n(1, 99999)}", f"@{r.choice('abcdefgh')}{n(1, 9)}", f"#{n(1, 99999)}",
    ])


def labels(text: str) -> np.ndarray:
    """Tags of a whole text by the base patterns; -1 for what may be a kind that they don't know."""
    spans = base_spans(text)
    y = _tags(len(text), spans)
    for m in _MAYBE.finditer(text):
        free = y[m.start() : m.end()]
        free[free == 0] = -1
    return y


def _labelled(keep: int):
    """Windows of HOP's spacing that hold a digit or an ``@`` and each text's first, with their tags: the least by hash of each of ``keep`` buckets."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[int, str, list[int]]] = {}
        for b in batches:
            for t in b["text"]:
                y = None
                for lo in dict.fromkeys([0, *(x for a, z in stretches(t) for x in range(a, z, HOP))]):
                    window = t[lo : lo + WINDOW]
                    h = zlib.crc32(window.encode("utf-8", "surrogatepass"))
                    bucket, rank = h % keep, zlib.crc32(window.encode("utf-8", "surrogatepass"), 77)
                    if bucket not in best or (rank, window) < best[bucket][:2]:
                        y = labels(t) if y is None else y
                        best[bucket] = rank, window, np.pad(y[lo : lo + WINDOW], (0, WINDOW - len(window))).tolist()
        yield pd.DataFrame([(k, *v) for k, v in best.items()], columns=["bucket", "h", "text", "tags"])

    return run


def train_tagger(docs: DataFrame, sample: int = SAMPLE, seed: int = 6) -> Tagger:
    """A tagger trained on at most ``sample`` windows of docs and more of them with disguised instances put in.

    All windows of all texts are hashed to ``sample`` buckets and each bucket keeps its least, so tasks combine before the
    shuffle, copies of a window count once and the driver gets ``sample`` rows at most, whatever the input.
    """
    r = random.Random(seed)
    hit = docs.where("text IS NOT NULL").select("text").where(F.col("text").rlike("[0-9@]"))
    windows = hit.mapInPandas(_labelled(sample), "bucket long, h long, text string, tags array<int>")
    kept = windows.groupBy("bucket").agg(F.min(F.struct("h", "text", "tags")).alias("w")).select("w.*")
    rows = sorted(kept.collect(), key=lambda x: (x["h"], x["text"]))
    c, y = [], []
    texts = [(x["text"], np.array(x["tags"])) for x in rows] or [("", np.zeros(WINDOW, np.int64))]
    for text, tags in texts:
        c.append(chars(text.ljust(WINDOW)[:WINDOW]))
        y.append(tags)
    for i in range(max(DISGUISED * len(texts), LEAST_DISGUISED)):
        text, tags = texts[i % len(texts)]
        kind = r.choice([0, 1, 2, 3, 3, len(KINDS)])  # phone numbers are written in most ways
        inside, at = disguised(kind, r) if kind < len(KINDS) else harmless(r), r.randint(0, WINDOW // 2)
        plain = "".join(" " if t else x for x, t in zip(text.ljust(WINDOW), tags))
        text = (plain[:at] + r.choice([" ", " ", "(", ": "]) + inside + r.choice([" ", " ", ".", ", ", ")"]) + plain[at:])
        first = text.index(inside, at)
        c.append(chars(text[:WINDOW].ljust(WINDOW)))
        y.append(_tags(WINDOW, [(first, kind, first + len(inside))] if kind < len(KINDS) else []))
    tagger = Tagger(seed)
    tagger.train(np.stack(c), np.stack(y))
    return tagger


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text covered by windows that hold a digit or an ``@``: multiples of HOP, joined where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGERS.finditer(text):
        first = max(0, (m.start() - WINDOW) // HOP + 1) * HOP
        end = (m.end() - 1) // HOP * HOP + WINDOW
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, min(b, len(text))) for a, b in out]


def _substance(kind: int, found: str) -> bool:
    digits = len(_DIGITS.sub("", found))
    if found != found.strip():
        return False
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+[ (\[{<]{0,2}@[ )\]}>]{0,2}[A-Za-z0-9-]+( ?\. ?[A-Za-z0-9-]+)+", found))
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and not re.search(r"[A-Za-z]", found)
    if re.search(r"[A-Za-z\n]", found):
        return False
    return 14 <= digits <= 19 and luhn(_DIGITS.sub("", found)) if kind == 2 else 10 <= digits <= 15


class Taken:
    """The base spans of a text, to ask which places they touch."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.reach, far = [], 0  # how far the spans up to each one go
        for _, _, e in spans:
            far = max(far, e)
            self.reach.append(far)

    def meets(self, x: int, y: int) -> bool:
        k = bisect_left(self.starts, y)
        return k > 0 and self.reach[k - 1] > x


def pieces_of(i: int, a: int, b: int) -> Iterator[tuple[int, int, int, int, int]]:
    """A stretch of text i as pieces (i, from, to, first, end) of PIECE characters that overlap by MARGIN on each side; a piece owns first to end."""
    own = PIECE - 2 * MARGIN
    for first in range(a, b, own) if b - a > PIECE else (a,):
        end = min(first + own, b) if b - a > PIECE else b
        yield i, max(a, first - MARGIN), min(b, end + MARGIN), first, end


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text that are sure and touch no base span."""
    where = [x for i, t in enumerate(texts) for a, b in stretches(t) for x in pieces_of(i, a, b)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    touched = [Taken(x) for x in base]
    where.sort(key=lambda x: x[2] - x[1])
    lo = 0
    while lo < len(where):
        hi = lo
        while hi < len(where) and (hi == lo or (hi - lo + 1) * (where[hi][2] - where[hi][1]) <= GROUP):
            hi += 1
        group = where[lo:hi]
        lo = hi
        size = np.array([b - a for _, a, b, _, _ in group])
        starts = [range(0, max(1, n - HOP), HOP) for n in size.tolist()]
        c = np.zeros((sum(map(len, starts)), WINDOW), np.int64)
        k = 0
        for (i, a, b, _, _), s in zip(group, starts):
            own = chars(texts[i][a:b])
            for x in s:
                c[k, : len(own[x : x + WINDOW])] = own[x : x + WINDOW]
                k += 1
        scores = np.concatenate([tagger.scores(c[x : x + 1024]) for x in range(0, len(c), 1024)])
        e = np.zeros((int(size.max()), len(group), TAGS), np.float32)
        k = 0
        for g, s in enumerate(starts):
            for x in s:  # the middle of a window, and what no other window holds
                n = int(size[g])
                left, right = x + (WINDOW - HOP) // 2 if x else 0, x + (WINDOW + HOP) // 2 if x != s[-1] else n
                right = min(right, n, x + WINDOW)
                e[left:right, g] = scores[k, left - x : right - x]
                k += 1
        tr = tagger.p["tr"]
        best, sure = viterbi(e, tr, size), marginals(e, tr, size)[0]
        for g, (i, a, b, first, end) in enumerate(group):
            tags = best[: b - a, g].tolist()
            s = 0
            while s < len(tags):
                if not tags[s]:
                    s += 1
                    continue
                kind, t = (tags[s] - 1) // 2, s + 1
                while t < len(tags) and tags[t] == 2 + 2 * kind:
                    t += 1
                p = sure[np.arange(s, t), g, tags[s:t]].mean()
                x, y = a + s, a + t
                if first <= x < end and p >= SURE and _substance(kind, texts[i][x:y]) and not touched[i].meets(x, y):
                    out[i].append((x, kind, y))
                s = t
    return out


def _detect(tagger: Tagger):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger)
            n = np.array([[sum(k == j for _, k, _ in x) for j in range(len(KINDS))] for x in base], np.int64).reshape(len(texts), len(KINDS))
            yield pd.DataFrame({
                "doc_id": b["doc_id"].array, **{f"n_{k}": n[:, j] for j, k in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(spell(x).encode()).hexdigest() for x in base],
                "spans": [spell(sorted(x + y)) for x, y in zip(base, more)], "n_added": [len(y) for y in more],
            })

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs (doc_id, text).

    The counts and the hash are those of the base patterns; spans holds all spans, n_added how many the
    tagger added. A null text is empty: no spans, and the hash of nothing. Repeated rows are read each.
    An empty table trains nothing and gives an empty one.
    """
    Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(_detect(train_tagger(rows)), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
