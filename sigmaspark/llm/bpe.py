"""BPE encoding by backtracking over longest token matches, and decoding with an offset table.

A sequence of tokens is the encoding of a word exactly when each token is its own encoding and
every adjacent pair is compatible, that is, merging the pair's joined symbols gives the pair
back. One pass of an Aho-Corasick automaton over the vocabulary gives the longest token at each
place of a word. The encoder walks the word from the left, takes that token, accepts it if it is
compatible with the token before, else tries the next shorter one, and steps back where none is
left; end positions that lead nowhere are marked so that each is tried once. Time is linear in
the word's length.

Vocabulary files are read by path in the Python workers; the path is a parameter. Letters,
numbers, white space and lower case are those of the tokenizer file's library. Each character
that comes up is compared once with what this module's patterns make of it; a text that holds
one they disagree on, as can be with characters of newer Unicode versions, is normalised and cut
into words by the library's own components.

Defined results: a null text is encoded as the empty one (no ids, empty decoded text); rows,
ids and extra columns are passed on unchanged, repeated rows included.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SPACE = "\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPLIT = re.compile(f"[{SPACE}]+")
ODD = re.compile("[\x1c-\x1f]")
END = "</w>"
MARK = "\U0010fffd"  # stands for END, as one character
CACHE = 400_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class WordBpe(dict):
    """Encoder and decoder of a word-level BPE file; as a dict, a bounded cache from chunks without white space to ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = {k.replace(END, MARK) if k.endswith(END) else k: v for k, v in model["vocab"].items()}
        self.rank = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((self._unit(a), self._unit(b)), i)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_re = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.blob = "".join(names.get(i, "") for i in range(max(names) + 1))
        self.offsets = np.cumsum([0] + [len(names.get(i, "")) for i in range(max(names) + 1)])
        self.pieces = [self.blob[a:b] for a, b in zip(self.offsets, self.offsets[1:])]
        self.byte_chars = byte_chars()
        self.auto = ahocorasick.Automaton()
        for k in self.ids:
            self.auto.add_word(k, len(k))
        self.auto.make_automaton()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.agreed: set[str] = set()
        self.odd: set[str] = set()
        self.prefix: dict[str, str] = {}
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    @staticmethod
    def _unit(s: str) -> str:
        return s.replace(END, MARK) if s.endswith(END) else s

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge neighbours by rank, leftmost first among equals; used for the compatibility of short strings only."""
        s = symbols
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: (self.rank.get((s[i], s[i + 1]), 1 << 40), i))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s = s[:best] + [s[best] + s[best + 1]] + s[best + 2 :]
        return s

    @staticmethod
    def symbols(text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(MARK) else list(text)

    def reachable(self, token: str) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(self.symbols(token)) == [token]
        return ok

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.symbols(a) + self.symbols(b) if not a.endswith(MARK) else [a, b]) == [a, b]
        return ok

    def longest(self, text: str) -> list[int]:
        """The length of the longest token at each place, 0 where there is none."""
        out = [0] * len(text)
        for end, k in self.auto.iter(text):
            if k > out[end - k + 1]:
                out[end - k + 1] = k
        return out

    def shorter(self, token: str) -> str:
        """The longest token that is a proper prefix of a string."""
        found = self.prefix.get(token)
        if found is None:
            found = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ids), "")
            if len(self.prefix) > 4 * CACHE:
                self.prefix.clear()
            self.prefix[token] = found
        return found

    def word(self, text: str) -> list[int]:
        """Ids of one word (or part of one), given in byte characters; a word's end is closed by MARK."""
        n, ids, whole, pairs, most = len(text), self.ids, self.whole.get, self.pairs.get, self.longest(text)
        dead = bytearray(n + 1)
        if text.endswith(MARK):
            dead[n - 1] = 1  # no token is MARK alone
        out: list[str] = []
        at, last, token = 0, "", text[: most[0]]
        while True:
            while token:
                end = at + len(token)
                if not dead[end] and (whole(token) or self.reachable(token)):
                    ok = not last or pairs((last, token))
                    if ok is None:
                        ok = self.compatible(last, token)
                    if ok:
                        break
                token = self.shorter(token)
            if token:
                out.append(token)
                if end == n:
                    return [ids[s] for s in out]
                at, last = end, token
                token = text[at : at + most[at]]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""
                token = self.shorter(token)
            else:  # symbols outside the vocabulary are dropped, and what is left stands together
                known = [s for s in self.symbols(text) if s in ids]
                return self.word("".join(known)) if known else []

    def __missing__(self, chunk: str) -> list[int]:
        if len(self) > CACHE:
            self.clear()
        bc, ids = self.byte_chars, []
        found_words = [chunk] if chunk.isascii() and chunk.isalpha() else WORDS.findall(chunk)
        for w in found_words:
            found = self.words.get(w)
            if found is None:
                if len(self.words) > CACHE:
                    self.words.clear()
                found = self.word((w if w.isascii() and w.isprintable() else "".join([bc[b] for b in w.encode("utf-8", "replace")])) + MARK)
                if len(w) < 64:
                    self.words[w] = found
            ids = found if len(found_words) == 1 else ids + found
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def strange(self, text: str) -> bool:
        """Whether the library may see the text's characters in another way than this module's patterns."""
        for c in set(text) - self.agreed - self.odd:
            probe = f"x{c}1{c}!{c}"
            known = unicodedata.category(c) != "Cn" and [w for w, _ in self.words_of(probe)] == ["".join(self.byte_chars[b] for b in w.encode()) for w in WORDS.findall(self.plain_text(probe))]
            (self.agreed if known else self.odd).add(c)
        return not self.odd.isdisjoint(text)

    def words_of(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Words in byte characters, by the library's components."""
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))

    @staticmethod
    def plain_text(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def plain(self, text: str) -> chain:
        if not text.isascii():
            text = text.encode("utf-8", "replace").decode()
            if self.strange(text):
                return chain.from_iterable(self.word(w + MARK) for w, _ in self.words_of(text) if w)
            text = self.plain_text(text)
        text = text.lower()
        return chain.from_iterable(map(self.__getitem__, SPLIT.split(text) if ODD.search(text) else text.split()))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special_re and "<|" in text and self.special_re.search(text):
            out: list[int] = []
            for part in self.special_re.split(text):
                out += [self.special[part]] if part in self.special else self.plain(part)
            return out
        return list(self.plain(text))

    def decode(self, ids) -> str:
        return " ".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and, if named, the ``decoded`` text of those ids."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (ids, decoded)] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))
    keep = [f.name for f in schema.fields if f.name not in (ids, decoded)]

    def run(batches):
        bpe = load(path)
        for b in batches:
            every = [bpe.encode(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            sizes = np.fromiter(map(len, every), np.int32, len(every))
            flat = np.fromiter(chain.from_iterable(every), np.int32, int(sizes.sum()))
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)))
            if decoded:
                cols.append(pa.array([bpe.decode(x) for x in every], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=keep + [ids] + ([decoded] if decoded else []))

    return small_batches(df).select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of ids, null ids and a null array being empty."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType(), False)])
    keep = [f.name for f in schema.fields if f.name != out]

    def run(batches):
        bpe = load(path)
        for b in batches:
            text = [bpe.decode(i for i in x or [] if i is not None) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keep] + [pa.array(text, pa.string())], names=[*keep, out])

    return small_batches(df).mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    out = encode(df.select("doc_id", "text"), path, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
