"""Reading level of the prose of a document.

A linear scorer is fitted to pairs of samples of one language whose bands differ, on syntax and vocabulary features scaled
per language; isotonic regression of the band on the score turns scores into levels. The samples are a small labelled
table (at most ``MAX_SAMPLES`` rows are used, by sample id); every document is scored whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ("easy", "medium", "hard")
MIN_WORDS = 60
MAX_SAMPLES = 5000
#: Prose with a smaller share of Latin letters is in none of the languages.
LATIN_SHARE = 0.6
_L2 = 1e-2
#: Features whose spread over a language's samples is below this are left as they are.
_LEAST_SPREAD = 1e-6

_BREAK = re.compile(r"\r\n?|[\u2028\u2029\x0b\x0c\x85]|<br\s*/?>|</?p\s*/?>", re.I)
_RULE = re.compile(r"^\s*([-=_*~.#]\s*){3,}$")
_ITEM = re.compile(r"(?:[-*+\u2022]|\d{1,3}[.)]|\[[ xX]\]|\#{1,6})(?:\s|$)|\[[^\]]*\]:\s")
_MARKUP = re.compile(r"`[^`]*`|!?\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)|<?https?://\S+|www\.\S+|</?[a-zA-Z][^<>]{0,200}>")
_LEADS = frozenset("-*+\u2022[#0123456789")
FEATURES = (
    "word_length", "long_words", "very_long_words", "short_words", "log_sentence", "sentence", "log_longest_sentence",
    "marks_per_sentence", "function_share",
)
#: Longer words, mostly names and paths, count as this long.
_LONGEST = 22
_PORTION = 1 << 20


def prose(text: str | None) -> list[str]:
    """The paragraphs of running prose: no front matter, code, tables, lists, headings, rules, links or markup."""
    if not text:
        return []
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    lines = html.unescape(_BREAK.sub("\n", text)).split("\n")
    first = next((i for i, line in enumerate(lines) if line.strip("\ufeff \t")), len(lines))
    if first < len(lines) and lines[first].strip("\ufeff \t") == "---":
        closing = next((i for i in range(first + 1, len(lines)) if lines[i].strip() in ("---", "...")), None)
        if closing is not None:
            lines = lines[closing + 1 :]
    out: list[list[str]] = [[]]
    fenced = False
    for line in lines:
        bare = line.strip()
        if not bare:
            out.append([])
            continue
        if bare[:3] in ("```", "~~~"):
            fenced = not fenced
            continue
        if fenced or line[0] == "\t" or line[:4] == "    " or bare[0] == "|" or bare.count("|") >= 3:
            continue
        while bare[:1] == ">":
            bare = bare[1:].lstrip()
        if bare[:1] in _LEADS and _ITEM.match(bare) or _RULE.match(bare):
            continue
        if any(c in bare for c in "`[<") or "://" in bare or "www." in bare:
            bare = _MARKUP.sub(" ", bare).strip()
        if bare:
            out[-1].append(bare)
    return [" ".join(part) for part in out if part]


#: Odd multipliers for the places of the characters of a word.
_PLACES = np.cumprod(np.full(64, 0x94D049BB133111EB, dtype=np.uint64))
_LETTER, _DIGIT, _SPACE, _END, _MARK, _DROP, _LATIN = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of the basic plane and a number for the lower case of each; those beyond count as symbols."""
    kinds, lower = np.zeros(65536, dtype=np.uint8), np.arange(65536, dtype=np.uint64)
    for point in range(65536):
        char = chr(point)
        category = unicodedata.category(char)
        if category[0] in "LM":
            kinds[point] = _LETTER | (_LATIN if point < 0x250 or 0x1E00 <= point < 0x1F00 or category[0] == "M" else 0)
            lower[point] = ord(char.lower()[0])
        elif category[0] == "N":
            kinds[point] = _DIGIT
        elif char.isspace():
            kinds[point] = _SPACE
        elif category[0] == "C" or char == "\ufffd":
            kinds[point] = _DROP
        elif char in ".!?\u2026:;":
            kinds[point] = _END | (_MARK if char in ":;" else 0)
        elif char in ",()\u2013\u2014":
            kinds[point] = _MARK
    kinds[65535] = 0
    mixed = (lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return kinds, mixed ^ (mixed >> np.uint64(32))


@dataclass(frozen=True)
class Profile:
    """Of each text of a batch: counts and features, and its words as (text number, hash) for what depends on the language."""

    n_words: np.ndarray
    latin_share: np.ndarray
    values: np.ndarray
    word_text: np.ndarray
    word_hash: np.ndarray


def profile(paragraphs: list[list[str]]) -> Profile:
    """Counts of a batch of texts, on one array of all their characters."""
    kinds, mixed = _characters()
    n = len(paragraphs)
    joined = ["\n".join(parts) + "\n" for parts in paragraphs]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.minimum(codes, 65535).astype(np.uint16)
    kind = kinds[codes]
    ends = np.cumsum([len(x) for x in joined])
    dropped = (kind & _DROP) > 0
    if dropped.any():
        ends = ends - np.concatenate([[0], np.cumsum(dropped)])[ends]
        codes, kind = codes[~dropped], kind[~dropped]
    begins = np.concatenate([[0], ends[:-1]])

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, begins, dtype=np.int64) if n else np.empty(0, dtype=np.int64)

    space = (kind & _SPACE) > 0
    # a word counts where its first letter or digit stands: the last one seen is before the last space
    point = np.flatnonzero((kind & (_LETTER | _DIGIT)) > 0)
    token = np.cumsum(space, dtype=np.int32)[point]
    first = point[np.flatnonzero(np.diff(token, prepend=-1))]
    n_words = np.diff(np.searchsorted(first, ends), prepend=0)

    letter = (kind & _LETTER) > 0
    latin = per_text((kind & _LATIN) > 0) / np.maximum(per_text(letter), 1)

    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    start, stop = edge[::2], edge[1::2]
    full = stop - start
    length = np.minimum(full, _LONGEST)
    upto = np.searchsorted(start, ends)
    word_text = np.repeat(np.arange(n), np.diff(upto, prepend=0))
    count = np.maximum(np.diff(upto, prepend=0), 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[upto], prepend=0) / count

    after = np.concatenate([space[1:], [True]]) if len(space) else space
    breaks = np.flatnonzero(((kind & _END) > 0) & after | (codes == 10))
    size = np.diff(np.searchsorted(start, breaks), prepend=0)
    held = size > 0
    owner, size = np.searchsorted(ends, breaks[held], side="right"), size[held]
    n_sentences = np.maximum(np.bincount(owner, minlength=n), 1)
    per_sentence = np.bincount(owner, weights=size, minlength=n) / n_sentences
    longest = np.zeros(n)
    np.maximum.at(longest, owner, size)
    marks = per_text((kind & _MARK) > 0) / n_sentences

    # the hash of a word sums a number for each of its characters, turned by the character's place
    place = np.arange(len(codes), dtype=np.int64)
    place -= np.repeat(np.concatenate([start, [len(codes)]]), np.diff(np.concatenate([[0], stop, [len(codes)]])))
    turned = mixed[codes] * _PLACES[place & 63]
    turned[~letter] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(turned)])
    values = np.column_stack([
        mean(length), mean(length >= 8), mean(length >= 12), mean(length <= 3), np.log(np.maximum(per_sentence, 1)), per_sentence,
        np.log(np.maximum(longest, 1)), marks,
    ])
    return Profile(n_words, np.asarray(latin, dtype=float), values, word_text, sums[stop] - sums[start])


@dataclass(frozen=True)
class Model:
    """A fitted scorer: the samples' words with their log weight and function flag per language, scales, weights, calibration."""

    languages: tuple[str, ...]
    words: np.ndarray
    log_weight: np.ndarray
    function: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def known(self, batch: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Number of the most likely language of each text, and the share of its function words among the words."""
        n = len(batch.n_words)
        at = np.minimum(np.searchsorted(self.words, batch.word_hash), len(self.words) - 1)
        hit = self.words[at] == batch.word_hash
        at = np.where(hit, at, len(self.words))
        scores = np.column_stack([np.bincount(batch.word_text, weights=self.log_weight[at, k], minlength=n) for k in range(len(self.languages))])
        best = scores.argmax(axis=1)
        flags = self.function[at, best[batch.word_text]] if len(at) else np.empty(0)
        return best, np.bincount(batch.word_text, weights=flags, minlength=n) / np.maximum(np.bincount(batch.word_text, minlength=n), 1)

    def scores(self, batch: Profile) -> tuple[np.ndarray, np.ndarray]:
        best, share = self.known(batch)
        rows = np.column_stack([batch.values, share])
        return best, ((rows - self.middle[best]) / self.spread[best]) @ self.weights


def isotonic(scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function closest to the values, as its blocks' outer scores and levels."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(scores[order], values[order]):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            low, high, value, n = blocks.pop()
            last = blocks[-1]
            last[2] = (last[2] * last[3] + value * n) / (last[3] + n)
            last[1], last[3] = high, last[3] + n
    knots = np.array([k for low, high, _, _ in blocks for k in (low, high)])
    return knots, np.repeat([b[2] for b in blocks], 2)


def fit_pairs(rows: np.ndarray, grades: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Weights w for which w.(x - y) > 0 when x is graded above y in the same group: ridge logistic regression by Newton steps."""
    above, below = np.nonzero((grades[:, None] > grades[None, :]) & (groups[:, None] == groups[None, :]))
    x = rows[above] - rows[below]
    # a pair of neighbouring grades counts as much as one of distant grades
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - 1) / len(x) + _L2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + _L2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(samples: pd.DataFrame) -> Model:
    """Fit on rows (lang, band, text). Rows of unknown band or without words do not count; no usable row is an error."""
    samples = samples[samples["band"].isin(BANDS) & samples["lang"].notna()].reset_index(drop=True)
    batch = profile([prose(text) for text in samples["text"]])
    usable = np.flatnonzero(batch.n_words > 0)
    if not len(usable):
        raise ValueError("no reading samples with a known band")
    names = tuple(sorted(set(samples["lang"].iloc[usable])))
    lang = np.array([names.index(x) if x in names else -1 for x in samples["lang"]])
    grade = samples["band"].map(BANDS.index).to_numpy(dtype=float)
    words, code = np.unique(batch.word_hash, return_inverse=True)
    counts = np.zeros((len(words) + 1, len(names)))
    np.add.at(counts, (code, lang[batch.word_text]), 1)
    total = counts.sum(axis=0) + (counts > 0).sum(axis=0) + 1
    held = np.unique(np.column_stack([code, batch.word_text]), axis=0)
    spread_over = np.zeros((len(words) + 1, len(names)))
    np.add.at(spread_over, (held[:, 0], lang[held[:, 1]]), 1)
    function = spread_over >= 0.4 * np.bincount(lang[usable], minlength=len(names))
    empty = np.zeros((len(names), len(FEATURES)))
    model = Model(names, words, np.log((counts + 1) / total), function, empty, empty + 1, np.zeros(len(FEATURES)), np.zeros(1), np.zeros(1))
    flags = function[code, lang[batch.word_text]]
    share = np.bincount(batch.word_text, weights=flags, minlength=len(samples)) / np.maximum(np.bincount(batch.word_text, minlength=len(samples)), 1)
    rows = np.column_stack([batch.values, share])[usable]
    lang, grade = lang[usable], grade[usable]
    middle = np.array([rows[lang == k].mean(axis=0) for k in range(len(names))])
    spread = np.array([rows[lang == k].std(axis=0) for k in range(len(names))])
    spread = np.where(spread < _LEAST_SPREAD, 1.0, spread)
    scaled = (rows - middle[lang]) / spread[lang]
    weights = fit_pairs(scaled, grade, lang)
    knots, levels = isotonic(scaled @ weights, grade)
    return replace(model, middle=middle, spread=spread, weights=weights, knots=knots, levels=levels)


def train(samples: DataFrame) -> Model:
    """Fit on a table of graded samples (sample_id, lang, band, text), of which the first ``MAX_SAMPLES`` by id count."""
    bounded = samples.filter("lang is not null and text is not null").orderBy("sample_id").limit(MAX_SAMPLES)
    return fit(bounded.select("lang", "band", "text").toPandas())


def _portions(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in portions of about ``_PORTION`` characters, a longer text by itself, so that arrays stay small."""
    size = texts.str.len().fillna(0).to_numpy()
    part = (np.cumsum(size) // _PORTION).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(texts) else []
    for a, b in zip(cuts, [*cuts[1:], len(texts)]):
        yield texts.iloc[a:b]


def reading_levels(documents: DataFrame, model: Model, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, language, n_words, score, level (0 easiest to 2), band for every document.

    Language and score are those of the prose alone, whatever the document's own lang column says. They, level and band are
    null for null, empty or wordless texts, for prose of fewer than ``min_words`` words and for prose in another script.
    Long texts are read whole; repeated texts get the same level.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, n_words bigint, score double, level double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        names = np.array(fitted.languages, dtype=object)
        parts = []
        for some in _portions(texts):
            batch = profile([prose(text) for text in some])
            best, score = fitted.scores(batch)
            ok = (batch.n_words >= min_words) & (batch.latin_share >= LATIN_SHARE)
            level = np.interp(score, fitted.knots, fitted.levels)
            parts.append((np.where(ok, names[best], None), batch.n_words, np.where(ok, score, np.nan), np.where(ok, level, np.nan)))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [[], [], [], []]
        return pd.DataFrame(dict(zip(("language", "n_words", "score", "level"), columns)))

    judged = documents.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")
    level = F.when(~F.isnan("level"), F.col("level"))
    band = F.when(level < 0.5, BANDS[0]).when(level < 1.5, BANDS[1]).when(level.isNotNull(), BANDS[2])
    return judged.select("doc_id", "language", "n_words", F.when(~F.isnan("score"), F.col("score")).alias("score"), level.alias("level"), band.alias("band"))
