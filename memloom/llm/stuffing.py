"""Keyword-stuffed pages, link lists and product tag lists: robust outliers in spam-directed directions.

Method: every text is cut into passages of some forty words, and every passage
becomes a point of four features: density (of links, tags and prices), entropy
of its words, repetition (of content words close by) and share of function words.
Per language a robust centre and scatter are found over the passages of all
texts: medians and absolute deviations, then twice a mean and covariance of the
points within the limit.  A passage whose Mahalanobis distance is beyond the
limit and whose deviation points towards spam is an outlier, and a text is
reported if more than half of its characters lie in such passages.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from memloom.llm.workers import batched
from memloom.sources.shared import materialize
from memloom.sources.small import enough_tasks

#: Frequent function words of four languages written with blanks, and characters of grammar in Chinese; in Japanese, hiragana.
FUNCTION_WORDS = {
    "en": "a after all although an and are as at be because been before but by can do does every for from had has have he if in into is it its just no not of on or our over she so than that the their them then there they this though to under unless until was we were what when whenever which while who will with without you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für haben hat ich im in ist jede jeder kann mit nach nicht noch nur oder ohne sich sie sind so solange sonst über um und uns von vor war weil wenn werden wie wir wird zu zum zur",
    "fr": "au aux avec car ce ces chaque cette comme dans de des donc du elle en est et il ils je la le les leur mais ne ni nous on ont ou par pas pendant plus pour puis qu que qui reste sa sans se ses si son sont sur tourne trop un une vers vous",
    "es": "a al cada como con cuando de del desde después el ella en entre es esta este esté están fue ha hay la las lo los marcha mientras más muy no nos o para pero por porque que quien se si sigue sin sobre son su sus tras un una vez y ya",
}
CHINESE = frozenset("的了在是和把从到不会但而与或也都就还被对为以及如果因所之后前仍然请这那它我们你他没有时每只才再很更最将已着过吗呢吧啊让给向于其")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())
LANGUAGES = ("en", "de", "fr", "es", "zh", "ja", "und")
FEATURES = ("density", "entropy", "repetition", "function_words")
D = len(FEATURES)
TOWARDS = np.array([1.0, -1.0, 1.0, -1.0])
LIMIT = 13.28  # the 0.99 quantile of chi-squared with four degrees of freedom
FLOOR = np.array([0.25, 0.05, 0.08, 0.1])  # least deviation: most passages hold no link at all, and a link beside a sentence is nothing odd
PASSAGE = 40  # words
NEAR = 30  # words to either side in which a word comes back
OFTEN = 4  # comings back that count as full repetition
FULL = 20  # words below which a passage says less of entropy, repetition and function words
FITTED = 40 * D  # passages below which a language is set against all
BINS = 1024  # of medians, for features between 0 and 1
BATCH_CHARS = 1 << 21

_LINK = re.compile(r"!?\[[^\]\n]*\]\((?:https?://|www\.)[^)\s]*\)|<?(?:https?://|www\.)\S+|<a\s[^>]*>.*?</a>", re.I)
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s)>'\"]*|<[^>]*>", re.I)
_TAG = re.compile(r"(?<!\S)#\w*[^\W\d]\w*")
_MONEY = re.compile(r"[$€£¥₹]|usd|eur|gbp", re.I)
_PRICE = re.compile(r"[$€£¥₹]\s?\d|\d\s?(?:[$€£¥₹]|USD|EUR|GBP)\b", re.I)
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_DONE = re.compile(r"[.!?。！？]\W*$")
_CLOSE = "\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"  # scripts written without blanks
_RUN = re.compile(f"[{_CLOSE}]")
_WORD = re.compile(f"[{_CLOSE}]+|[^\\W\\d_{_CLOSE}]+")
_PLAIN_WORD = re.compile("[a-z]+")
_KANA, _HAN = re.compile("[\u3040-\u30ff]"), re.compile("[\u4e00-\u9fff]")


def _words(low: str) -> list[str]:
    """Words; a run of a script without blanks gives its pairs of characters."""
    if low.isascii():
        return _PLAIN_WORD.findall(low)
    found = _WORD.findall(low)
    if not _RUN.search(low):
        return found
    out = []
    for x in found:
        if _RUN.match(x):
            out += [x[k : k + 2] for k in range(max(1, len(x) - 1))]
        else:
            out.append(x)
    return out


def passages(text: str) -> tuple[list[list], int]:
    """[characters, of them links, tags and prices, words] of each passage, and the characters of fenced code, which is in none.

    Lines stay together, and longer ones are cut at the ends of sentences.  A
    fence that is never closed is none.
    """
    lines = text.splitlines()
    marks = [i for i, x in enumerate(lines) if x.lstrip().startswith("```")] if "```" in text else []
    fenced = {i for a, b in zip(marks[::2], marks[1::2]) for i in range(a, b + 1)}
    linked, tagged, priced = "://" in text or "www." in text.lower(), "#" in text, bool(_MONEY.search(text))
    code = 0
    out: list[list] = []
    now: list = [0, 0, []]
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if i in fenced:
            code += len(s)
            continue
        for unit in _END.split(s) if len(s) > 200 else (s,):
            low, n, odd = unit.lower(), len(unit), 0
            if linked and ("://" in low or "www." in low):
                odd = n - len(_LINK.sub(" ", unit).strip())
                low = _ADDRESS.sub(" ", low)
            if tagged and "#" in unit:
                found = _TAG.findall(unit)
                if len(found) >= 3:
                    odd += sum(map(len, found)) + len(found)
            if priced and not odd and _PRICE.search(unit) and not _DONE.search(unit):
                odd = n
            now[0] += n
            now[1] += min(n, odd)
            now[2] += _words(low)
            if len(now[2]) >= PASSAGE or now[0] >= 10 * PASSAGE:
                out.append(now)
                now = [0, 0, []]
    if now[0]:
        out.append(now)
    return out, code


def language(text: str, words: int, hits: dict[str, int]) -> str:
    """From the text itself, as the column is partly null or wrong."""
    if not text.isascii():
        letters = sum(map(str.isalpha, text)) or 1
        if len(_KANA.findall(text)) > 0.1 * letters:
            return "ja"
        if len(_HAN.findall(text)) > 0.1 * letters:
            return "zh"
    best = max(hits, key=lambda k: (hits[k], k))
    return best if hits[best] > 0.05 * words else "und"


def measure(texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(language, points, words and characters of the passages, characters of code) of each text."""
    book: dict[str, int] = defaultdict(count().__next__)
    cut = [passages(t) for t in texts]
    each = [p for ps, _ in cut for p in ps]
    of = np.repeat(np.arange(len(texts)), [len(ps) for ps, _ in cut])
    n = np.array([len(p[2]) for p in each], np.int64)
    code = np.fromiter((book[w] for p in each for w in p[2]), np.int64, int(n.sum()))
    part = np.repeat(np.arange(len(each)), n)
    text = of[part] if len(each) else part
    vocabulary = list(book)
    m, v = len(each), len(vocabulary)
    member = {k: np.array([w in s for w in vocabulary], bool) for k, s in _SETS.items()}
    hits = {k: np.bincount(text[x[code]], minlength=len(texts)) for k, x in member.items()}
    total = np.bincount(text, minlength=len(texts))
    langs = [language(t, int(total[i]), {k: int(h[i]) for k, h in hits.items()}) for i, t in enumerate(texts)]
    weight = np.zeros(len(code))
    spoken = np.array([LANGUAGES.index(x) for x in langs])[text] if len(code) else text
    for k, lang in enumerate(LANGUAGES):
        on = spoken == k
        if not on.any():
            continue
        if lang == "ja":
            table = np.array([sum("\u3041" <= c <= "\u3096" for c in w) / len(w) for w in vocabulary])
        elif lang == "zh":
            table = np.array([sum(c in CHINESE for c in w) / len(w) for w in vocabulary])
        else:
            table = member[lang].astype(float) if lang in member else np.array([w in _ANY for w in vocabulary], float)
        weight[on] = table[code[on]]
    # How often a word comes back near by: places of a word in a text lie side by side in one sorted list.
    at, wide = np.arange(len(code)), len(code) + 2 * NEAR + 2
    own = (text * v + code) * wide + at
    key = np.sort(own)
    back = np.searchsorted(key, own + NEAR, "right") - np.searchsorted(key, own - NEAR, "left") - 1
    some = np.maximum(n, 1)
    again = np.bincount(part, weights=np.minimum(back, OFTEN) / OFTEN * (weight < 0.5), minlength=m) / some
    pair, times = np.unique(part * max(v, 1) + code, return_counts=True)
    where = pair // max(v, 1)
    q = times / some[where]
    entropy = np.where(n > 1, np.bincount(where, weights=-q * np.log(q), minlength=m) / np.log(np.maximum(n, 2)), 1.0)
    chars = np.array([p[0] for p in each], np.int64)
    x = np.stack([np.array([p[1] for p in each]) / np.maximum(chars, 1), entropy, again, np.bincount(part, weights=weight, minlength=m) / some], 1) if m else np.zeros((0, D))
    edge = np.r_[0, np.cumsum([len(ps) for ps, _ in cut])]
    return [(langs[i], x[a:b], n[a:b], chars[a:b], cut[i][1]) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:]))]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        group = np.cumsum([len(t) for t in texts]) // BATCH_CHARS if len(texts) else np.zeros(0, np.int64)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            rows = measure([texts[i] for i in at])
            yield pd.DataFrame(
                {"id": pdf["id"].iloc[at].to_numpy(), "lang": [r[0] for r in rows], "x": [r[1].astype(np.float32).ravel() for r in rows], "words": [r[2].astype(np.int32) for r in rows], "chars": [r[3].astype(np.int32) for r in rows], "code": [r[4] for r in rows]}
            )


def _points(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, point, words and characters of every passage."""
    words = np.concatenate(pdf["words"].to_numpy()) if len(pdf) else np.zeros(0)
    row = np.repeat(np.arange(len(pdf)), pdf["words"].map(len))
    x = np.concatenate(pdf["x"].to_numpy()).astype(np.float64).reshape(-1, D) if len(pdf) else np.zeros((0, D))
    return row, x, words.astype(np.int64), (np.concatenate(pdf["chars"].to_numpy()) if len(pdf) else np.zeros(0)).astype(np.float64)


def _full(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """(language, points) of the passages with enough words; those of all languages come again as ``und``."""
    row, x, words, _ = _points(pdf)
    langs, on = pdf["lang"].to_numpy()[row] if len(row) else row, words >= FULL
    for lang in pd.unique(langs[on]):
        if lang != "und":
            yield lang, x[on & (langs == lang)]
    if on.any():
        yield "und", x[on]


def _medians(points: DataFrame, centre: dict | None) -> dict[str, np.ndarray]:
    """Median per language and feature, of the deviation from ``centre`` where one is given, to 1 / BINS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, x in _full(pdf):
                y = x if centre is None else np.abs(x - centre[lang])
                k = np.minimum((y * BINS).astype(np.int64), BINS - 1) + np.arange(D) * BINS
                acc[lang] = acc.get(lang, 0) + np.bincount(k.ravel(), minlength=D * BINS)
        for lang, n in acc.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": n[at]})

    rows = points.select("lang", "x", "words", "chars").mapInPandas(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BINS x D
    out = {}
    for lang, part in rows.groupby("lang"):
        n = np.zeros(D * BINS)
        n[part["bin"]] = part["n"]
        sums = n.reshape(D, BINS).cumsum(1)
        out[lang] = ((sums < sums[:, -1:] / 2).sum(1) + 0.5) / BINS
    return out


def _moments(points: DataFrame, centre: dict, inverse: dict) -> tuple[dict, dict]:
    """Mean and inverse covariance per language over the points within the limit; sums are taken per task and then added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for lang, x in _full(pdf):
                x = x - centre[lang]
                x = x[np.einsum("ij,jk,ik->i", x, inverse[lang], x) <= LIMIT]
                n, s, q = acc.get(lang, (0, 0.0, 0.0))
                acc[lang] = n + len(x), s + x.sum(0), q + x.T @ x
        if acc:
            yield pd.DataFrame({"lang": list(acc), "n": [v[0] for v in acc.values()], "s": [np.r_[v[1], np.ravel(v[2])].tolist() for v in acc.values()]})

    parts = points.select("lang", "x", "words", "chars").mapInPandas(run, "lang string, n long, s array<double>")
    sums = parts.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(D + D * D)])
    mean, inv = dict(centre), dict(inverse)
    for r in sums.collect():  # a row per language, of which there are seven
        if r["n"] < FITTED:
            continue
        s = np.array([r[f"s{i}"] for i in range(D + D * D)]) / r["n"]
        mean[r["lang"]] = centre[r["lang"]] + s[:D]
        inv[r["lang"]] = np.linalg.inv(s[D:].reshape(D, D) - np.outer(s[:D], s[:D]) + np.diag(FLOOR**2))
    few = {r["lang"] for r in sums.select("lang", "n").collect() if r["n"] >= FITTED}
    return {k: mean[k] if k in few else mean["und"] for k in mean}, {k: inv[k] if k in few else inv["und"] for k in inv}


def spam_scores(df: DataFrame, item: str, text: str, shortest: int = 100, limit: float = LIMIT) -> DataFrame:
    """``(item, lang, distance, towards, share, is_spam)`` of every text of ``shortest`` characters or more.

    ``share`` is the part of a text's characters in passages whose squared robust
    Mahalanobis distance in the text's language is above ``limit`` and which
    deviate towards spam; ``distance`` and ``towards`` (the cosine between the
    deviation and the spam direction, both in the scale of the scatter) are
    means over its passages by characters.  Texts of no known language are set
    against all, without function words, and so are languages with too few
    passages.  Null, empty and
    shorter texts and null ids are left out; an id delivered again counts once.
    Copies are measured each for itself and come out alike.
    """
    rows = df.select(F.col(item).alias("id"), F.col(text).alias("text")).where("id is not null").where(F.char_length("text") >= shortest)
    kind = dict(rows.dtypes)["id"]
    points = materialize(enough_tasks(rows, "id").mapInPandas(batched(_measured), f"id {kind}, lang string, x array<float>, words array<int>, chars array<int>, code int").dropDuplicates(["id"]), "points")
    middle = _medians(points, None)
    centre = {k: middle.get(k, middle.get("und", np.zeros(D))) for k in LANGUAGES}
    away = _medians(points, centre)
    inverse = {k: np.diag(1 / np.maximum(1.4826 * away.get(k, np.zeros(D)), FLOOR) ** 2) for k in LANGUAGES}
    for _ in range(2):
        centre, inverse = _moments(points, centre, inverse)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = {k: np.linalg.cholesky(v).T for k, v in inverse.items()}
        for pdf in batches:
            row, x, words, chars = _points(pdf)
            langs = pdf["lang"].to_numpy()
            dist, towards = np.zeros(len(x)), np.zeros(len(x))
            for lang in pd.unique(langs):
                on = (langs == lang)[row]
                z = x[on] - centre[lang]
                z[:, 1:] *= np.sqrt(np.minimum(1, words[on] / FULL))[:, None]
                if lang == "und":
                    z[:, -1] = 0  # what are function words there isn't known
                z = z @ root[lang].T
                way = root[lang] @ (TOWARDS * FLOOR)
                dist[on] = (z * z).sum(1)
                towards[on] = z @ way / np.maximum(np.sqrt(dist[on]) * np.sqrt(way @ way), 1e-12)
            total = lambda w: np.bincount(row, weights=chars * w, minlength=len(pdf))
            whole = total(np.ones(len(x)))
            share = total((dist > limit) & (towards > 0)) / np.maximum(whole + pdf["code"].to_numpy(), 1)
            whole = np.maximum(whole, 1)
            yield pd.DataFrame({"id": pdf["id"], "lang": langs, "distance": total(dist) / whole, "towards": total(towards) / whole, "share": share, "is_spam": share > 0.5})

    return points.mapInPandas(judge, f"id {kind}, lang string, distance double, towards double, share double, is_spam boolean").withColumnRenamed("id", item)
