"""Subword lattice likelihood of texts, beside a smoothed word model as the base.

The vocabulary is that of an existing tokenizer file. All its pieces are used, whatever their
length, with A-Z folded to lower case as in the texts' words; pieces that become the same are one,
at the better rank. A piece's score is its log probability: it starts from the piece's rank in the file and is
fitted to the training words by ``ROUNDS`` steps of expectation-maximisation over all their
segmentations. A word's probability is the sum over its segmentations of the product of their
pieces' probabilities, worked out by a forward recursion in log space over the word's lattice;
a text's is the product over its words and the closing end token. Characters outside the
vocabulary are spelled in bytes, each at a small probability of its own.

Words are counted over all documents: each task counts its own, the counts are summed in a
shuffle, and the lattice is run once per distinct word. Of the resulting word table the most
frequent words, at most ``TOP``, are broadcast; what they don't cover goes to the table in a
shuffle, and no word there is frequent enough to be a hot key.

Defined results: a null or empty text has only the end token. Where there is nothing to learn
from, counts are zero and the base score stays finite (N = V = 0). Rows that repeat a document
id are scored apart. Extra columns are not touched.
"""

from __future__ import annotations

import functools
import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

TOP = 150_000
ROUNDS = 3
WORD = b"\x01"  # begins each word; stands for the tokenizer's mark
BYTE_LOG = -9.0  # natural log, a byte of a character that no piece has
FLUSH = 200_000
LETTERS = 400_000  # bytes of words in one lattice, which holds some hundred bytes for each
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The file's pieces in the order of their ranks, A-Z folded to lower case, each once."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i).replace("▁", WORD.decode()).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    else:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]["vocab"]
        names = [x[0].replace("▁", WORD.decode()).encode() for x in spec]
    return [x for x in dict.fromkeys(n.lower() for n in names) if x]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the pieces and, in the same order, their ranks; the bytes of the longest piece."""
    names = pieces(path)
    h = np.array([_hash_one(x) for x in names], np.uint64)
    order = np.argsort(h)
    return h[order], order, max(map(len, names))


def _hash_one(piece: bytes) -> int:
    return int(_rolling(np.frombuffer(piece, np.uint8)[None, :], len(piece))[0, 0])


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each column on, for each row."""
    w = codes.shape[1] - n + 1
    h = np.full((codes.shape[0], w), n * 0xD6E8FEB86659FD93 % 2**64, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ codes[:, k : k + w].astype(np.uint64)) * M1
            h ^= h >> np.uint64(31)
        h *= M2
    return h


def lattice(words: list[bytes], keys: np.ndarray, logp: np.ndarray, weights: np.ndarray | None = None, longest: int | None = None):
    """Natural-log probability of each word; with weights also the expected counts of pieces.

    ``longest`` is the number of bytes of the longest piece; without it pieces of all lengths are looked up.
    """
    out = np.zeros(len(words))
    expected = np.zeros(len(keys)) if weights is not None else None
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, rows in by.items():
        many = max(1, min(20_000, LETTERS // (size + 1)))  # arrays grow with words times letters
        for at in range(0, len(rows), many):
            part = rows[at : at + many]
            codes = np.frombuffer(b"".join(WORD + words[i] for i in part), np.uint8).reshape(len(part), size + 1)
            n = size + 1
            spelled = np.full(n, BYTE_LOG)
            fw = np.full((n + 1, len(part)), -np.inf)
            fw[0] = 0
            arcs = []
            for k in range(1, min(n, longest or n) + 1):
                h = _rolling(codes, k)
                p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[p] == h
                if hit.any():
                    arcs.append((k, p, np.where(hit, logp[p], -np.inf)))
            for end in range(1, n + 1):
                best = fw[end - 1] + spelled[end - 1]
                for k, _, lp in arcs:
                    if k > end:
                        break
                    best = np.logaddexp(best, fw[end - k] + lp[:, end - k])
                fw[end] = best
            out[part] = fw[n]
            if expected is not None:
                bw = np.full((n + 1, len(part)), -np.inf)
                bw[n] = 0
                for start in range(n - 1, -1, -1):
                    best = bw[start + 1] + spelled[start]
                    for k, _, lp in arcs:
                        if k > n - start:
                            break
                        best = np.logaddexp(best, bw[start + k] + lp[:, start])
                    bw[start] = best
                w = weights[part]
                for k, p, lp in arcs:
                    for start in range(n - k + 1):
                        e = np.exp(fw[start] + lp[:, start] + bw[start + k] - fw[n]) * w
                        use = e > 0
                        np.add.at(expected, p[use, start], e[use])
    return out, expected


def _gathered(batches, rows: int = 50_000):
    """Record batches joined to about ``rows`` rows, so that array operations are long."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(docs: DataFrame) -> DataFrame:
    """word (binary), c (in training texts), n (in all); the end token is the empty word."""

    def run(batches):
        train, rest = Counter(), Counter()

        def out():
            names = [*train, *(w for w in rest if w not in train)]
            c = [train.get(w, 0) for w in names]
            n = [x + rest.get(w, 0) for w, x in zip(names, c)]
            train.clear(), rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for b in batches:
            for x, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                to = rest if held else train
                to.update(tokens(x))
                to[b""] += 1
            if len(train) + len(rest) > FLUSH:
                yield out()
        yield out()

    return small_batches(docs).select("text", "held_out").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces and, last, of the end token."""
    keys, ranks, _ = vocabulary(path)
    start = -np.log(ranks + 10.0)
    logp = np.append(start - np.log(np.exp(start).sum()), -6.0)
    sc = words.sparkSession.sparkContext
    ends = words.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    seen = words.where("c > 0 and length(word) > 0").select("word", "c")
    for _ in range(rounds):
        sent = sc.broadcast(logp)

        def run(batches):
            k, _, longest = vocabulary(path)
            total = np.zeros(len(k))
            for b in _gathered(batches):
                total += lattice(b.column(0).to_pylist(), k, sent.value[:-1], b.column(1).to_numpy().astype(float), longest)[1]
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.float64())], names=["piece", "e"])

        got = seen.mapInArrow(run, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()  # one row a piece
        e = np.full(len(keys) + 1, 0.01)
        e[got.column("piece").to_numpy()] += got.column("e").to_numpy()
        e[-1] += ends
        logp = np.log(e / e.sum())
    return logp


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``docs`` has doc_id, text and held_out."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    words = stored(_counted(docs), f"{where}/words")
    logp = fit(words, path)
    total = words.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V")).first()
    big_n, big_v = total["N"] or 0, total["V"] or 0
    floor = np.log10(0.1) if not big_n else np.log10(0.1 / (big_n + 0.1 * (big_v + 1)))
    sent = spark.sparkContext.broadcast(logp)

    def run(batches):
        keys, _, longest = vocabulary(path)
        for b in _gathered(batches):
            w = b.column(0).to_pylist()
            model = lattice(w, keys, sent.value[:-1], longest=longest)[0] / np.log(10)
            model[[i for i, x in enumerate(w) if not x]] = sent.value[-1] / np.log(10)
            c = b.column(1).to_numpy()
            base = np.log10((c + 0.1) / (big_n + 0.1 * (big_v + 1)))
            yield from pa.table([b.column(0), b.column(2), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(model)], names=["word", "n", "known", "base", "model"]).to_batches(20_000)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    scored = stored(words.select("word", "c", "n").mapInArrow(run, "word binary, n long, known long, base double, model double"), f"{where}/scored")

    # The frequency that at most TOP words reach; the number of distinct counts is far below that of words.
    sizes = scored.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(TOP).toArrow().to_pydict()
    least, sum_ = None, 0
    for n, m in zip(sizes["n"], sizes["m"]):
        sum_ += m
        if sum_ > TOP:
            break
        least = n
    if least is None:
        top = spark.sparkContext.broadcast(({}, np.zeros((0, 3))))
        rare = scored
    else:
        t = scored.where(F.col("n") >= least).toArrow()
        top = spark.sparkContext.broadcast(({w: i for i, w in enumerate(t.column("word").to_pylist())}, np.column_stack([t.column(k).to_numpy() for k in ("known", "base", "model")]).astype(float)))
        rare = scored.where(F.col("n") < least)

    def sums(batches):
        no, table = top.value
        at = 0
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                w = tokens(x)
                w.append(b"")
                ids = list(map(no.get, w))
                left = [v for v, i in zip(w, ids) if i is None] if None in ids else []
                known = table[[i for i in ids if i is not None]] if left else table[ids]
                out.append((len(w), *known.sum(axis=0).tolist(), left))
            cols = list(zip(*out)) if out else [()] * 5
            types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + [b.column(1), b.column(2)], names=["n_tokens", "known", "base", "model", "left", "doc_id", "held_out"])
            at += b.num_rows

    part = small_batches(docs).select("text", "doc_id", "held_out").mapInArrow(sums, "n_tokens long, known double, base double, model double, left array<binary>, doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", held_out boolean")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), f"{where}/part")
    more = part.select("row", F.explode("left").alias("word")).join(rare.select("word", "known", "base", "model"), "word").groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "model")))
    out = part.drop("left").join(more, "row", "left")

    def both(c):
        return F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))

    return out.select("doc_id", "held_out", "n_tokens", both("known").cast("long").alias("n_known"), F.lit(int(big_n)).cast("long").alias("train_tokens"), both("base").alias("base_score"), both("model").alias("score"))
