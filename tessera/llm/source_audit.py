"""How the sources of a language differ: divergence of each two, and the terms that mark a source.

A task counts the terms of its rows in a radix trie over UTF-8 bytes; a leaf stands for a term
and has a counter for each source (occurrences, and rows that hold the term). A trie is
written as its leaves in byte order. The tries merge by prefix range: leaves are range-
partitioned by language and term, and the counters of a term add up in its range. A
traversal of the merged leaves in UTF-8 order then streams, for each kept term, what it adds
to each pair of sources, and holds the best candidates of each source, ties to the smaller
term; a task returns only these sums and candidates.

A source that lacks a term has a share that depends on nothing but the source, so a term
costs its own sources times the sources of the language, not their square; terms that both
lack are counted and taken at once. A language's square of sums is held in a task, as the
result holds it; the totals of sources go to tasks in the closure.

Defined results: null text, language and source are ''; sources without terms take part, with
no counts; a language without kept terms has pairs of value 0; an empty table gives an empty
table; rows are documents also where ids repeat; other columns are not read. All arithmetic is
in whole numbers. Texts are read a stretch at a time; a trie is passed on when it is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .automaton import byte_classes, words
from .common import small_batches, stored

# Fixed values of the contract: bytes of terms, documents that a term needs, unit of a share, weight added to a count, ranks of terms.
TERM_BYTES = [(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)]
MIN_DOCUMENTS, UNIT, ADDED, TOP = 10, 1_000_000_000, 2, 10
CLASSES = byte_classes(TERM_BYTES)
#: A trie is written and begun anew when it has so many leaves, bytes in its terms, or counters.
MOST_LEAVES, MOST_BYTES, MOST_COUNTERS = 1_000_000, 64 << 20, 4_000_000
#: Levels of a trie with a byte to an edge.
DEEP = 32
#: Numbers in a block of the traversal.
BLOCK = 1 << 21


class Trie:
    """A byte trie that takes many terms at once, a level in a step.

    The edges of a level are sorted numbers, parent << 8 | byte, with the nodes they lead to.
    Below DEEP bytes what is left of a term is one edge (the radix step), as few terms go there.
    """

    def __init__(self):
        none = np.zeros(0, dtype=np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(none, none) for _ in range(DEEP)]
        self.tails: dict[int, dict[bytes, int]] = {}
        self.nodes = 1
        self.leaf_of = np.full(1024, -1, dtype=np.int64)  # the leaf's number, by node
        self.terms: list[pa.Array] = []
        self.leaves = self.size = 0

    def _numbered(self, n: int) -> np.ndarray:
        out = np.arange(self.nodes, self.nodes + n)
        self.nodes += n
        while self.nodes > len(self.leaf_of):
            self.leaf_of = np.concatenate([self.leaf_of, np.full(len(self.leaf_of), -1, dtype=np.int64)])
        return out

    def _step(self, level: int, edges: np.ndarray) -> np.ndarray:
        """The nodes at the ends of edges, new ones where the trie has none."""
        own, at = np.unique(edges, return_inverse=True)
        keys, ends = self.levels[level]
        place = np.searchsorted(keys, own)
        known = np.zeros(len(own), dtype=bool)
        known[place < len(keys)] = keys[place[place < len(keys)]] == own[place < len(keys)]
        nodes = np.empty(len(own), dtype=np.int64)
        nodes[known] = ends[place[known]]
        nodes[~known] = self._numbered(int((~known).sum()))
        self.levels[level] = np.insert(keys, place[~known], own[~known]), np.insert(ends, place[~known], nodes[~known])
        return nodes[at]

    def add(self, terms: pa.Array) -> np.ndarray:
        """The numbers of the leaves of distinct terms (large_binary, none empty)."""
        offsets = np.frombuffer(terms.buffers()[1], dtype=np.int64)[terms.offset : terms.offset + len(terms) + 1]
        data = np.frombuffer(terms.buffers()[2], dtype=np.uint8)
        sizes = np.diff(offsets)
        order = np.argsort(-np.minimum(sizes, DEEP + 1), kind="stable")  # those still going down are a prefix
        starts, sizes = offsets[:-1][order], sizes[order]
        node = np.zeros(len(order), dtype=np.int64)
        going = len(sizes)
        for level in range(DEEP):
            going = int(np.searchsorted(-sizes[:going], -level, side="left"))  # sizes above level
            if not going:
                break
            node[:going] = self._step(level, node[:going] << 8 | data[starts[:going] + level])
        for i in np.flatnonzero(sizes > DEEP):
            rest = data[starts[i] + DEEP : starts[i] + sizes[i]].tobytes()
            below = self.tails.setdefault(int(node[i]), {})
            if rest not in below:
                below[rest] = int(self._numbered(1)[0])
            node[i] = below[rest]
        new = np.flatnonzero(self.leaf_of[node] < 0)
        self.leaf_of[node[new]] = np.arange(self.leaves, self.leaves + len(new))
        self.terms.append(terms.take(pa.array(order[new])))
        self.leaves += len(new)
        self.size += int(sizes[new].sum())
        out = np.empty(len(order), dtype=np.int64)
        out[order] = self.leaf_of[node]
        return out

    def walk(self) -> tuple[pa.Array, np.ndarray]:
        """The terms in the order of bytes, and their leaves: a traversal with each node before those below it."""
        held = (self.leaf_of[: self.nodes] >= 0).astype(np.int64)
        below = held.copy()  # leaves at or below each node
        tails = [(n, sorted(t.items())) for n, t in self.tails.items()]
        for n, own in tails:
            below[n] += len(own)
        for keys, ends in reversed(self.levels):
            np.add.at(below, keys >> 8, below[ends])
        first = np.zeros(self.nodes, dtype=np.int64)  # how many leaves come before
        for keys, ends in self.levels:
            if not len(keys):
                break
            parent = keys >> 8
            before = np.cumsum(below[ends]) - below[ends]
            start = np.flatnonzero(np.diff(parent, prepend=-1))
            before -= np.repeat(before[start], np.diff(start, append=len(parent)))
            first[ends] = first[parent] + held[parent] + before
        for n, own in tails:
            first[[end for _, end in own]] = first[n] + held[n] + np.arange(len(own))
        nodes = np.flatnonzero(held)
        leaves = np.empty(self.leaves, dtype=np.int64)
        leaves[first[nodes]] = self.leaf_of[nodes]
        terms = pa.concat_arrays(self.terms) if self.terms else pa.array([], pa.large_binary())
        return terms.take(pa.array(leaves)), leaves


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sum of each of values for them."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *[np.add.reduceat(v[order], first) for v in values])


class SourceTrie:
    """A trie with, for each leaf, counters by group: occurrences, and rows that hold the term."""

    def __init__(self, groups: dict[tuple[str, str], int]):
        self.trie, self.groups = Trie(), groups
        self.pending: list[tuple[np.ndarray, ...]] = []

    def count(self, texts: pa.Array, group_of_row: np.ndarray) -> None:
        pairs, times = [], []
        for found in words(texts, CLASSES):
            sizes = found.ends - found.starts
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(found.classes[found.classes != 0])]).dictionary_encode()
            leaves = self.trie.add(terms.dictionary)
            one, n = summed((found.rows.astype(np.int64) << 32) | leaves[terms.indices.to_numpy()], np.ones(len(sizes), dtype=np.int64))
            pairs.append(one)
            times.append(n)
        if not pairs:
            return
        # a row that took several stretches is one document
        pair, n = summed(np.concatenate(pairs), np.concatenate(times)) if len(pairs) > 1 else (pairs[0], times[0])
        leaf, row = pair & 0xFFFFFFFF, pair >> 32
        self.pending.append(summed((leaf << 31) | group_of_row[row], n, np.ones(len(n), dtype=np.int64)))
        if len(self.pending) > 32:
            self.pending = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, ...]:
        return summed(*[np.concatenate(c) for c in zip(*self.pending)]) if self.pending else (np.zeros(0, dtype=np.int64),) * 3

    def full(self) -> bool:
        return self.trie.leaves > MOST_LEAVES or self.trie.size > MOST_BYTES or sum(len(p[0]) for p in self.pending) > MOST_COUNTERS

    def leaves(self) -> Iterator[pa.RecordBatch]:
        """The counters in the order of terms; and a row without a term for each group."""
        names = list(self.groups)
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        none = pa.array(np.zeros(len(names), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(names), pa.string()), none, none], names=LEAF_NAMES)
        key, n, rows = self._merged()
        walked, leaves = self.trie.walk()
        place = np.empty(len(leaves), dtype=np.int64)
        place[leaves] = np.arange(len(leaves))
        terms = walked.cast(pa.large_string())
        order = np.argsort(place[key >> 31], kind="stable")
        key, n, rows, place = key[order], n[order], rows[order], place[key[order] >> 31]
        for at in range(0, len(key), 50_000):
            part = slice(at, at + 50_000)
            group = pa.array(key[part] & 0x7FFFFFFF)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), terms.take(pa.array(place[part])).cast(pa.string()), pa.array(n[part]), pa.array(rows[part])], names=LEAF_NAMES)


LEAF_NAMES = ["lang", "source", "term", "n", "documents"]


def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to leaves of tries."""
    groups: dict[tuple[str, str], int] = {}
    held = SourceTrie(groups)
    for batch in batches:
        pair = pc.struct_field(pa.StructArray.from_arrays(batch.columns[:2], names=["lang", "source"]).cast(pa.struct([("lang", pa.string()), ("source", pa.string())])), [0])
        lang, source = pair.dictionary_encode(), batch.column(1).cast(pa.string()).dictionary_encode()
        both = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
        distinct, at = np.unique(both, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        numbers = [groups.setdefault((langs[b // len(sources)], sources[b % len(sources)]), len(groups)) for b in distinct.tolist()]
        held.count(batch.column(2), np.array(numbers, dtype=np.int64)[at])
        if held.full():
            yield from held.leaves()
            held = SourceTrie(groups)
    yield from held.leaves()


def merged_leaves(df: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text", min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n, sources: array<struct<source,n>>) of the kept terms, and (lang, source) of all groups; both stored."""
    small_batches(df.sparkSession)
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_column), ("source", source_column), ("text", text_column))])
    leaves = stored(rows.mapInArrow(count_leaves, "lang string, source string, term string, n long, documents long"), "tries")
    groups = stored(leaves.where("term IS NULL").select("lang", "source").distinct(), "audit-groups")
    ranged = leaves.where("term IS NOT NULL").repartitionByRange("lang", "term")
    # both sums stay in the ranges
    counters = ranged.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = counters.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = terms.where(F.col("documents") >= min_documents).select("lang", "term", "n", "sources").sortWithinPartitions("lang", "term")
    return stored(kept, "merged-tries"), groups


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / total), exact."""
    if len(counts) and int(counts.max()) > (1 << 62) // UNIT:
        return np.array([1 + UNIT * (int(c) + ADDED) // int(t) for c, t in zip(counts, np.broadcast_to(total, counts.shape))], dtype=np.int64)
    return 1 + UNIT * (counts + ADDED) // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class LanguageSums:
    """What the kept terms of one language add to its pairs of sources, and the best terms of each source."""

    def __init__(self, sources: list[str], totals: list[int], terms: int):
        self.sources, self.place = sources, {s: i for i, s in enumerate(sources)}
        self.weights = np.array(totals, dtype=np.int64) + ADDED * terms
        self.of_all = int(sum(totals)) + ADDED * terms
        self.absent = shares(np.zeros(len(sources), dtype=np.int64), self.weights)
        side = (len(sources), len(sources))
        self.any, self.both, self.common = (np.zeros(side, dtype=np.int64) for _ in range(3))
        self.terms = 0
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def add(self, terms: pa.Array, counts: np.ndarray, term_at: np.ndarray, source_at: np.ndarray, n: np.ndarray) -> None:
        """Terms with their counts in the language; n occurrences of term term_at[i] in source source_at[i]."""
        s = len(self.sources)
        self.terms += len(terms)
        p, q = shares(n, self.weights[source_at]), shares(counts, self.of_all)[term_at]
        step = max(1, BLOCK // s)
        for lo in range(0, len(terms), step):
            inside = np.flatnonzero((term_at >= lo) & (term_at < lo + step))
            own = np.tile(self.absent, (min(step, len(terms) - lo), 1))
            has = np.zeros(own.shape, dtype=bool)
            own[term_at[inside] - lo, source_at[inside]] = p[inside]
            has[term_at[inside] - lo, source_at[inside]] = True
            inside = inside[np.argsort(source_at[inside], kind="stable")]
            for at in range(0, len(inside), step):
                some = inside[at : at + step]
                value = divergence(p[some][:, None], own[term_at[some] - lo])
                first = np.flatnonzero(np.diff(source_at[some], prepend=-1))
                to, with_it = source_at[some][first], has[term_at[some] - lo]
                self.any[to] += np.add.reduceat(value, first)
                self.both[to] += np.add.reduceat(value * with_it, first)
                self.common[to] += np.add.reduceat(with_it.astype(np.int64), first)
        self._rank(terms, term_at, source_at, p, q)

    def _rank(self, terms: pa.Array, term_at: np.ndarray, source_at: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        more = np.flatnonzero(p > q)
        value = divergence(p[more], q[more])
        place = np.empty(len(terms), dtype=np.int64)
        place[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((place[term_at[more]], -value, source_at[more]))
        source = source_at[more][order]
        first = np.flatnonzero(np.diff(source, prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        for i in order[rank < TOP]:
            self.best[source_at[more[i]]].append((-int(value[i]), terms[term_at[more[i]]].as_py()))
        for s in np.unique(source):
            self.best[s] = sorted(self.best[s], key=lambda x: (x[0], x[1].encode()))[:TOP]

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        """(source, part, item, value)."""
        held = np.diag(self.common)
        neither = self.terms - held[:, None] - held[None, :] + self.common
        total = self.any + self.any.T - self.both + neither * divergence(self.absent[:, None], self.absent[None, :])
        for a, source in enumerate(self.sources):
            for b, other in enumerate(self.sources):
                if a != b:
                    yield source, "pair", other, int(total[a, b])
            for value, term in self.best[a]:
                yield source, "term", term, -value


def audit(df: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of the language by divergence, and the TOP terms that a source has more of."""
    kept, groups = merged_leaves(df, lang_column, source_column, text_column, min_documents)
    in_source = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    in_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    known = groups.join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left").fillna(0, ["n", "terms"])
    facts: dict[str, tuple[list[str], list[int], int]] = {}
    for r in sorted(known.collect(), key=lambda r: (r["lang"], r["source"])):  # a row for each group, of which the result holds the squares
        own = facts.setdefault(r["lang"], ([], [], r["terms"]))
        own[0].append(r["source"])
        own[1].append(r["n"])

    def traverse(batches):
        sums: dict[str, LanguageSums] = {}
        for batch in batches:
            langs = batch.column(0).cast(pa.string()).dictionary_encode()
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten()
            sources, n = flat.field(0).cast(pa.string()).dictionary_encode(), flat.field(1).to_numpy()
            term_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            lang_of = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in sums:
                    sums[lang] = LanguageSums(*facts[lang])
                own = sums[lang]
                rows = np.flatnonzero(lang_of == k)
                entries = np.flatnonzero(lang_of[term_of] == k)
                place = np.array([own.place.get(s, -1) for s in sources.dictionary.to_pylist()], dtype=np.int64)
                at = np.searchsorted(rows, term_of[entries])
                own.add(batch.column(1).cast(pa.string()).take(pa.array(rows)), batch.column(2).to_numpy()[rows], at, place[sources.indices.to_numpy()[entries]], n[entries])
        out = [(lang, *r) for lang, own in sums.items() for r in own.rows()]
        for at in range(0, len(out), 50_000):
            columns = zip(*out[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()])], names=["lang", "source", "part", "item", "value"])

    found = stored(kept.select("lang", "term", "n", "sources").mapInArrow(traverse, "lang string, source string, part string, item string, value long"), "audit-sums")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    every = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(found.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = every.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))
