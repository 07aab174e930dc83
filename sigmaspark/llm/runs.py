"""Runs (maximal periodic stretches) of words, found through a Re-Pair grammar of each document.

* **Grammar.** Word ids are rewritten by Re-Pair: a round counts all adjacent pairs of a
  document and replaces each pair that is more frequent than those it overlaps by a nonterminal
  (ties by a hash), until no pair repeats. Pairs that don't compete are replaced in the same
  round, so a round is a few passes of numpy over many documents and rounds are few. The
  sequence that is left is closed by a balanced binary tree.
* **Boundaries.** Every stretch of the text lies across the boundary of exactly one lowest node
  that holds it. For each nonterminal the runs across its boundary are computed once, at its
  first place in the text, and for each node of the closing tree at its only place. A run
  repeats three words beside the boundary one period away, so the periods to try are the
  distances to other places of these words inside the node. Prefix hashes extend each by binary
  search, cut at the node's ends.
* **Derivation.** What a nonterminal holds is translated to all places where it is derived;
  intervals of one period that overlap by it are merged to maximal ones, and of equal intervals
  the smallest period stays, as a longer one is its multiple.

Each run is checked word by word at the end; were a hash ever to lie, that batch of documents is
done again by comparing words. Documents don't meet: nothing is shuffled, a task holds a few
megabytes of texts at a time (``BATCH``, or one document), and a lost task is run again by itself.

Defined results: words are what ASCII white space separates; a null text has none; a run has
at least ``max(least, 2 * period)`` words. Repeated rows and ids are treated alike. Extra columns
are passed on whatever their names, but for ``runs`` and ``collapsed``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 12  # words of a run
BATCH = 4 << 20  # bytes of text worked on at a time
CHUNK = 1 << 20  # candidate periods worked on at a time
RUN = "struct<start:bigint,length:bigint,period:bigint>"
SPACE = "[ \\t-\\r]+"
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * MIX
    x = (x ^ (x >> np.uint64(31))) * BASE
    return x ^ (x >> np.uint64(29))


class Grammar:
    """Re-Pair over ``words``, ids that no two documents share."""

    def __init__(self, words: np.ndarray, terminals: int):
        self.terminals = terminals
        self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lens = np.ones(terminals, np.int64)
        self.repeated = np.zeros(len(words), bool)  # of the first round: whether a word and the next stand so elsewhere
        self.pair_id = np.zeros(len(words), np.int64)
        self.seq, self.pos = words, np.arange(len(words))
        self._keys, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rules by pair, sorted
        at = np.arange(len(words) - 1)
        first = True
        while len(at):
            kinds, kind, count = np.unique(self.seq[at] << 32 | self.seq[at + 1], return_inverse=True, return_counts=True)
            twice = count[kind] > 1
            if first:
                self.repeated[at], self.pair_id[at], first = twice, kind, False
            at = self._round(at[twice], kinds, kind[twice], count)

    def _round(self, at: np.ndarray, kinds: np.ndarray, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Replaces pairs at places among ``at``, where they repeat; returns the places whose pairs may repeat then."""
        if not len(at):
            return at
        rank = np.empty(len(kinds), np.int64)
        rank[np.lexsort((mixed(kinds), count))] = np.arange(1, len(kinds) + 1)
        weight = np.zeros(len(self.seq) + 2, np.int64)  # of the pair at each place, one place on
        mine = weight[at + 1] = rank[kind]
        # Stretches of one pair that overlaps itself count as one, and every second place of them is taken.
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1])
        starts = np.flatnonzero(new)
        stretch = np.cumsum(new) - 1
        begin, end = at[starts], at[np.append(starts[1:], len(at)) - 1]
        wins = (weight[begin] < mine[starts]) & (weight[end + 2] < mine[starts])
        taken = wins[stretch] & ((at - begin[stretch]) % 2 == 0)
        places = at[taken]
        pairs, which = np.unique(kinds[kind[taken]], return_inverse=True)
        near = np.zeros(len(self.seq), bool)
        near[at] = near[places] = near[np.maximum(places - 1, 0)] = True
        self.seq[places] = self._rules(pairs)[which]
        stay = np.ones(len(self.seq), bool)
        stay[places + 1] = False
        self.seq, self.pos = self.seq[stay], self.pos[stay]
        # Two words' pair only gets rarer; one with a nonterminal may come again.
        made = self.seq >= self.terminals
        return np.flatnonzero(near[stay][:-1] | made[:-1] | made[1:])

    def _rules(self, pairs: np.ndarray) -> np.ndarray:
        """Symbols of the pairs, old rules found again and others made."""
        spot = np.searchsorted(self._keys, pairs)
        known = np.zeros(len(pairs), bool)
        inside = spot < len(self._keys)
        known[inside] = self._keys[spot[inside]] == pairs[inside]
        out = np.empty(len(pairs), np.int64)
        out[known] = self._ids[spot[known]]
        fresh = pairs[~known]
        out[~known] = made = np.arange(len(self.lens), len(self.lens) + len(fresh))
        left, right = fresh >> 32, fresh & 0xFFFFFFFF
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.lens = np.append(self.lens, self.lens[left] + self.lens[right])
        keys, ids = np.append(self._keys, fresh), np.append(self._ids, made)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ids = keys[order], ids[order]
        return out

    def derived(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of at least ``least`` words and their places, wherever they are derived."""
        symbols, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sym, pos = self.seq, self.pos
        while True:
            long = (sym >= self.terminals) & (self.lens[sym] >= least)
            sym, pos = sym[long], pos[long]
            if not len(sym):
                return np.concatenate(symbols), np.concatenate(places)
            symbols.append(sym)
            places.append(pos)
            left = self.left[sym - self.terminals]
            sym, pos = np.append(left, self.right[sym - self.terminals]), np.append(pos, pos + self.lens[left])

    def closing(self, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, boundary and end of the nodes of the balanced tree over each document's symbols."""
        doc = np.searchsorted(firsts, self.pos, "right") - 1
        head = np.searchsorted(self.pos, firsts)  # each document's first symbol
        ends = np.append(self.pos, size)
        at = np.arange(len(self.pos))
        i = at - head[doc]
        half = i & -i
        tail = np.append(head[1:], len(self.pos))[doc]
        inner = i > 0
        lo, hi = ends[(at - half)[inner]], ends[np.minimum(at + half, tail)[inner]]
        return lo, self.pos[inner], hi


class Words:
    """How far stretches of the words agree with those some words on."""

    def __init__(self, words: np.ndarray, exact: bool = False):
        self.words, self.exact = words, exact
        if not exact:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), BASE)]))
                self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * self.power[:-1])])

    def agree(self, i: np.ndarray, p: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``i`` on (or up to before ``i``) equal those ``p`` further, ``limit`` at most."""
        got = np.zeros(len(i), np.int64)
        if not len(i):
            return got
        if self.exact:
            live = np.flatnonzero(limit > 0)
            while len(live):
                x = i[live] - got[live] - 1 if back else i[live] + got[live]
                live = live[self.words[x] == self.words[x + p[live]]]
                got[live] += 1
                live = live[got[live] < limit[live]]
            return got
        with np.errstate(over="ignore"):
            step = 1 << int(limit.max()).bit_length()
            while step := step >> 1:
                live = np.flatnonzero(got + step <= limit)
                a = i[live] - got[live] - step if back else i[live] + got[live]
                b, shift = a + p[live], self.power[p[live]]
                same = (self.sums[a + step] - self.sums[a]) * shift == self.sums[b + step] - self.sums[b]
                got[live[same]] += step
        return got


def crossing(grammar: Grammar, text: Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Node, start, end and period of stretches of a period across the nodes' boundaries, cut at the nodes' ends."""
    words, n = text.words, len(text.words)
    # Places of three words that stand elsewhere in their document too, by words and place.
    both = np.flatnonzero(grammar.repeated[:-1] & grammar.repeated[1:])
    both = both[both + 3 <= n]
    _, kind, count = np.unique(grammar.pair_id[both] << 32 | words[both + 2], return_inverse=True, return_counts=True)
    both, kind = both[count[kind] > 1], kind[count[kind] > 1]
    triple = np.full(n + 3, -1)
    triple[both] = kind
    order = np.argsort(kind, kind="stable")
    spots = both[order]
    keys = kind[order] * n + spots
    found = []
    node = np.concatenate([np.arange(len(mid))] * 2)
    base = np.concatenate([mid - 3, mid])
    ok = (base >= lo[node]) & (base + 3 <= hi[node])
    node, base = node[ok], base[ok]
    ok = triple[base] >= 0
    node, base = node[ok], base[ok]
    begin = np.searchsorted(keys, triple[base] * n + lo[node])
    many = np.searchsorted(keys, triple[base] * n + hi[node] - 2) - begin
    node, base, begin, many = (x[many > 1] for x in (node, base, begin, many))
    upto = np.cumsum(many)
    cuts = np.searchsorted(upto, np.arange(CHUNK, int(upto[-1]) + CHUNK, CHUNK), "right") if len(upto) else []
    for a, b in zip([0, *cuts], [*cuts, len(many)], strict=False):
        if a >= b:
            continue
        each = np.repeat(np.arange(a, b), many[a:b])
        other = spots[begin[each] + np.arange(len(each)) - np.repeat(upto[a:b] - many[a:b] - (upto[a] - many[a]), many[a:b])]
        p, i, k = np.abs(other - base[each]), np.minimum(other, base[each]), node[each]
        ok = (p > 0) & (2 * p <= hi[k] - lo[k])
        p, i, k = p[ok], i[ok], k[ok]
        # A run has six words at least that equal those a period on: three more beside these three.
        near = np.full(len(p), 3)
        for step, stop in ((1, hi[k] - p), (-1, lo[k])):
            live = np.arange(len(p))
            x = i + 3 if step > 0 else i - 1
            for _ in range(3):
                live = live[x[live] < stop[live] if step > 0 else x[live] >= stop[live]]
                live = live[words[x[live]] == words[x[live] + p[live]]]
                near[live] += 1
                x[live] += step
        ok = near >= 6
        p, i, k = p[ok], i[ok], k[ok]
        start = i - text.agree(i, p, i - lo[k], back=True)
        end = i + text.agree(i, p, hi[k] - p - i) + p
        ok = end - start >= np.maximum(least, 2 * p)
        found.append(np.stack([k[ok], start[ok], end[ok], p[ok]]))
    k, start, end, p = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    order = np.lexsort((p, end, start, k))
    k, start, end, p = k[order], start[order], end[order], p[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return k[new], start[new], end[new], p[new]


def maximal(start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by it are one; of equal intervals the smallest period stays. By start, then period."""
    if not len(p):
        return start, end, p
    order = np.lexsort((start, p))
    start, end, p = start[order], end[order], p[order]
    group = np.cumsum(np.append(False, p[1:] != p[:-1]))
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span) - group * span
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] + p[1:] > far[:-1])
    firsts = np.flatnonzero(new)
    start, p, end = start[firsts], p[firsts], far[np.append(firsts[1:], len(far)) - 1]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def find(words: np.ndarray, terminals: int, firsts: np.ndarray, least: int = LEAST, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in ``words``, the documents beginning at ``firsts``."""
    if not len(words):
        return tuple(np.zeros((3, 0), np.int64))
    g = Grammar(words.copy(), terminals)
    symbols, places = g.derived(least)
    once, rep = np.unique(symbols, return_index=True)
    lo, mid, hi = g.closing(firsts, len(words))
    own = places[rep]
    lo, hi = np.append(own, lo), np.append(own + g.lens[once], hi)
    mid = np.append(own + g.lens[g.left[once - terminals]], mid)
    held = np.append(np.arange(len(once)), np.full(len(mid) - len(once), -1))
    big = hi - lo >= least
    lo, mid, hi, held = lo[big], mid[big], hi[big], held[big]
    k, start, end, p = crossing(g, Words(words, exact), lo, mid, hi, least)
    top = held[k] < 0
    out = [np.stack([start[top], end[top], p[top]])]
    order = np.argsort(symbols, kind="stable")
    bounds = np.searchsorted(symbols[order], np.append(once, 1 << 62))
    inner = np.flatnonzero(~top)
    which = held[k[inner]]
    times = bounds[which + 1] - bounds[which]
    each = np.repeat(np.arange(len(inner)), times)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    shift = places[order][bounds[which[each]] + nth] - own[which[each]]
    out.append(np.stack([start[inner][each] + shift, end[inner][each] + shift, p[inner][each]]))
    start, end, p = maximal(*np.concatenate(out, 1))
    if not exact and not all(np.array_equal(words[a : b - q], words[a + q : b]) for a, b, q in zip(start.tolist(), end.tolist(), p.tolist(), strict=True)):
        return find(words, terminals, firsts, least, exact=True)
    return start, end, p


def _batch(texts: list[bytes | None], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of each text (their number; start, length and period of all) and the texts without repetitions."""
    every = [x.split() if x else [] for x in texts]
    long = [i for i, x in enumerate(every) if len(x) >= least]
    ids, firsts, total, kinds = [], [], 0, 0
    for i in long:
        known = {x: j for j, x in enumerate(dict.fromkeys(every[i]), kinds)}
        ids.append(np.fromiter(map(known.__getitem__, every[i]), np.int64, len(every[i])))
        firsts.append(total)
        total += len(every[i])
        kinds += len(known)
    firsts = np.array(firsts, np.int64)
    start, end, p = find(np.concatenate(ids) if ids else np.zeros(0, np.int64), kinds, firsts, least)
    doc = np.searchsorted(firsts, start, "right") - 1
    edges = np.bincount(start + p, minlength=total + 1) - np.bincount(end, minlength=total + 1)
    kept = np.cumsum(edges)[:-1] == 0
    for d in np.unique(doc).tolist():
        i, a = long[d], firsts[d]
        every[i] = [every[i][j] for j in np.flatnonzero(kept[a : a + len(every[i])]).tolist()]
    counts = np.bincount(np.array(long, np.int64)[doc], minlength=len(texts))
    return counts, np.stack([start - firsts[doc], end - start, p]), [b" ".join(x) for x in every]


def detect(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with ``runs`` (start, length and period, by start and period) and ``collapsed``, the words that no run repeats."""
    kept = [c for c in df.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([T.StructField("row", T.StructType([df.schema[c] for c in kept])), *T._parse_datatype_string(f"runs array<{RUN}>, collapsed binary").fields])

    def work(batches):
        for b in batches:
            size = np.cumsum(b.column("words").cast(pa.large_binary()).fill_null(b"").to_pandas().str.len().to_numpy(np.int64) if b.num_rows else [])
            ends = np.flatnonzero(np.diff(size // BATCH, append=-1)) + 1
            for a, e in zip([0, *ends[:-1]], ends, strict=True):
                part = b.slice(a, e - a)
                counts, runs, collapsed = _batch(part.column("words").to_pylist(), least)
                structs = pa.StructArray.from_arrays([pa.array(x) for x in runs], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(collapsed, pa.binary())], names=["row", "runs", "collapsed"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text}`").cast("string").cast("binary").alias("words"))
    out = rows.mapInArrow(work, schema)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(df: DataFrame) -> DataFrame:
    """doc_id and the words of each text with one space between; a tenth of the texts, chosen by id, are periodic from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    chosen = df.select("doc_id", "text", h.alias("h")).select("doc_id", "text", F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, words).alias("words"))
    n = F.greatest(F.size("words"), F.lit(1))
    cut = chosen.select("doc_id", "text", "words", "g", n.alias("n"), (F.col("g") % n).cast("int").alias("a"))
    cut = cut.withColumn("p", (F.expr("(n - a) div (3 + g % 8)") + 1).cast("int"))
    times = F.expr("(n - a) div p + 1").cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.size("words") > 0, periodic).otherwise(F.col("text")).alias("text"))


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    out = detect(planted(df))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("best.l * 1000 div (-best.p)").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
