"""Language identification with interpolated Kneser-Ney character models.

Words are lower-cased runs of letters between word marks; contexts stay inside a word, so a
word's log probability under each language is a property of the word and is worked out once
for all its copies in a task. n-grams are kept as 64-bit hashes in one sorted array, found by
binary search, with a row of log probabilities (one column per language); contexts have a row
of back-off weights. The language of the lowest cross-entropy per character wins.

Training counts come from a sample of labelled rows: about ``SAMPLE`` documents of each
language, chosen by a hash of id and text, whole texts. Of every ``APART`` of them one is kept out of the counts for
calibration: per language the mean cross-entropy and its spread at a given length, on texts the
model has not seen (with fewer than ``FEW`` such texts the counted ones take part, and the spread is that over all languages). The score is the posterior probability of the
winner times the share of its own language's texts that fit no better by a wide margin; texts
in no learned language score near 0 and are rejected below ``REJECT``.

Defined results: ``und`` with score 0 for a null text, for one without a letter, and for all
texts if there is nothing to learn from. Ties go to the alphabetically first language. Repeated
rows get the same result; extra columns are not touched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

ORDER = 5
SAMPLE = 1200  # documents per language
DISCOUNT = 0.75
APART = 8
FEW = 20
REJECT = 0.2
CACHE = 100_000  # words that a task keeps
AT_ONCE = 10_000  # words that are looked up together
WORDS = re.compile(r"[^\W\d_]+")
START, STOP = "\x02", "\x03"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each place (only valid where so many precede)."""
    h = np.full(len(codes), order * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h[k:] = (h[k:] ^ codes[: len(codes) - k]) * PRIME
            h ^= h >> np.uint64(29)
    return h


def joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their marks, and where each word begins."""
    codes = np.frombuffer((START + (STOP + START).join(words) + STOP).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return codes, np.flatnonzero(codes == ord(START))


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of n-grams
    logp: np.ndarray  # (n-gram, language)
    ctx: np.ndarray  # sorted hashes of contexts
    back: np.ndarray  # (context, language)
    mean: np.ndarray | None = None  # of cross-entropy, by language
    sd: np.ndarray | None = None  # of (cross-entropy - mean) * sqrt(length)
    unseen: float = -14.0

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word and its closing mark, by language."""
        codes, first = joined(words)
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        out = np.zeros((len(codes), len(self.langs)))
        todo = np.flatnonzero(place > 0)
        for n in range(ORDER, 0, -1):
            if not len(todo):
                break
            now = todo[place[todo] >= n - 1]
            if len(now):
                h = hashes(codes, n)[now]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                out[now[hit]] += self.logp[at[hit]]
                missed = now[~hit]
                if n > 1 and len(missed):
                    c = hashes(codes, n - 1)[missed - 1]
                    at = np.minimum(np.searchsorted(self.ctx, c), len(self.ctx) - 1)
                    known = self.ctx[at] == c
                    out[missed[known]] += self.back[at[known]]
                elif n == 1:
                    out[missed] += self.unseen
                todo = np.concatenate([missed, todo[place[todo] < n - 1]]) if n > 1 else missed[:0]
        return np.add.reduceat(out, first, axis=0) if len(words) else out


def train(grams: dict[str, dict[str, int]]) -> Model:
    """Interpolated Kneser-Ney from counts of n-grams (orders 1 to ORDER) by language."""
    langs = sorted(grams)
    every: dict[str, int] = {}
    for lang in langs:
        for g in grams[lang]:
            every.setdefault(g, len(every))
    contexts: dict[str, int] = {}
    for g in every:
        if len(g) > 1:
            contexts.setdefault(g[:-1], len(contexts))
    by_order = [[g for g in every if len(g) == n] for n in range(1, ORDER + 1)]
    logp = np.zeros((len(every), len(langs)))
    back = np.zeros((len(contexts), len(langs)))
    for k, lang in enumerate(langs):
        raw = grams[lang]
        count: dict[str, int] = {}
        for g, c in raw.items():  # lower orders count distinct preceding characters, unless a word begins there
            if len(g) == ORDER or g[0] == START:
                count[g] = c
            if len(g) > 1:
                count[g[1:]] = count.get(g[1:], 0) + 1
        total: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for g, c in count.items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        floor = 1.0 / (len(by_order[0]) + 2)
        p: dict[str, float] = {}
        for grams_n in by_order:
            for g in grams_n:
                h, shorter = g[:-1], p[g[1:]] if len(g) > 1 else floor
                t = total.get(h, 0)
                p[g] = shorter if not t else (max(count.get(g, 0) - DISCOUNT, 0) + DISCOUNT * kinds[h] * shorter) / t
                logp[every[g], k] = np.log(p[g])
        for h, i in contexts.items():
            if t := total.get(h, 0):
                back[i, k] = np.log(DISCOUNT * kinds[h] / t)

    def hashed(names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        h = np.zeros(len(names), np.uint64)
        by: dict[int, list[str]] = {}
        for g in names:
            by.setdefault(len(g), []).append(g)
        for n, gs in by.items():
            codes = np.frombuffer("".join(gs).encode("utf-32-le"), np.uint32).astype(np.uint64)
            h[[names[g] for g in gs]] = hashes(codes, n)[n - 1 :: n]
        order = np.argsort(h)
        return h[order], order

    keys, o = hashed(every)
    ctx, c = hashed(contexts)
    return Model(langs, keys, logp[o], ctx, back[c])


class Scorer(dict):
    """A bounded cache from words to rows of their log probabilities."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.rows = np.zeros((1024, len(model.langs)))

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, int, np.ndarray | None]]:
        """(language or und, score, length, cross-entropy by language) of each text."""
        if len(self) > CACHE:
            self.clear()
        tokens, sizes, chars = [], [], []
        for x in texts:
            w = WORDS.findall(x.lower()) if x else []
            if not any(map(str.isalpha, w)) and not any(c.isalpha() for v in w for c in v):
                w = []  # numerals that are no digits are words too, but not letters
            tokens.append(list(map(self.__getitem__, w)))
            sizes.append(len(w))
            chars.append(sum(map(len, w)) + len(w))
        if self.new:
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]))])
            for i in range(0, len(self.new), AT_ONCE):
                part = self.new[i : i + AT_ONCE]
                self.rows[[self[w] for w in part]] = self.model.words(part)
            self.new = []
        out, m = [], self.model
        for t, n in zip(tokens, chars):
            if not t:
                out.append(("und", 0.0, 0, None))
                continue
            ll = self.rows[t].sum(axis=0)
            ce = -ll / n
            best = int(np.argmin(ce))
            gap = np.exp(-np.clip(ll[best] - ll, 0, 700))
            score = 1 / gap.sum()
            if m.mean is not None:
                z = (ce[best] - m.mean[best]) / (m.sd[best] / np.sqrt(n) + 0.1)
                score /= 1 + np.exp(np.clip(2 * (z - 6), -50, 50))
            out.append((m.langs[best], float(score), n, ce))
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learn from labelled rows (see the module's text); None if there are none."""
    spark = docs.sparkSession
    key = [F.col("doc_id")] if "doc_id" in docs.columns else []
    draw = F.pmod(F.xxhash64(F.col(text), *key), F.lit(APART << 20))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))))
    taken = rows.where(F.shiftright("draw", 3) < share[F.col("lang")] * (APART << 17)).withColumn("apart", F.col("draw") % APART == 0)

    def words(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for x, la in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in WORDS.findall(x.lower()):
                    found[la, w] = found.get((la, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    def grams(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for la, w, c in zip(*(x.to_pylist() for x in b.columns)):
                w = START + w + STOP
                for end in range(1, len(w)):
                    for start in range(max(0, end - ORDER + 1), end + 1):
                        k = la, w[start : end + 1]
                        found[k] = found.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = small_batches(taken.where("not apart")).select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counted.mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    by: dict[str, dict[str, int]] = {k: {} for k in counts}
    for la, g, n in zip(got["lang"], got["gram"], got["n"]):
        by[la][g] = n
    by = {k: v for k, v in by.items() if v}
    if not by:
        return None
    model = train(by)
    sent = spark.sparkContext.broadcast(model)

    def entropies(batches):
        s = Scorer(sent.value)
        for b in batches:
            got = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), s.texts(b.column(0).to_pylist()))
            rows = [(la, apart, n, float(ce[s.model.langs.index(la)])) for la, apart, (_, _, n, ce) in got if n and la in s.model.langs]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.float64()))], names=["lang", "apart", "n", "ce"])

    seen = stored(small_batches(taken).select("text", "lang", "apart").mapInArrow(entropies, "lang string, apart boolean, n long, ce double"), f"{shared_dir(spark)}/entropies")
    # One row a language and side; the mean is weighted by length, the spread is that of a mean over n characters.
    sums = {(r["lang"], r["apart"]): r for r in seen.groupBy("lang", "apart").agg(F.sum("n").alias("n"), F.sum(F.col("ce") * F.col("n")).alias("s"), F.sum(F.pow("ce", F.lit(2)) * F.col("n")).alias("q"), F.count("*").alias("m")).collect()}
    model.mean, model.sd = np.zeros(len(model.langs)), np.ones(len(model.langs))
    squares, texts, thin = 0.0, 0, []
    for i, k in enumerate(model.langs):
        unseen, counted = sums.get((k, True)), sums.get((k, False))
        thin.append(not unseen or unseen["m"] < FEW)
        use = [r for r in ((unseen, counted) if thin[i] else (unseen,)) if r]
        if use:
            n, s, q, m = (sum(r[c] for r in use) for c in ("n", "s", "q", "m"))
            model.mean[i] = s / n
            around = max(q - n * model.mean[i] ** 2, 0)
            model.sd[i] = np.sqrt(around / m)
            squares, texts = squares + around, texts + m
    if texts:  # a handful of texts can't tell a language's own spread
        model.sd[thin] = np.sqrt(squares / texts)
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    cols = [c for c in df.columns if c not in ("lang_pred", "score")]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            got = scorer.texts(b.column(b.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in cols), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*cols, "lang_pred", "score"])

    schema = df.select(*cols).schema.add("lang_pred", "string", False).add("score", "double", False)
    return small_batches(df).select(*cols).mapInArrow(run, schema)
