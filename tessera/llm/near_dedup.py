"""Near-duplicate documents: BagMinHash signatures of five-word shingles, bands, exact checks.

A text is the multiset of its five-word shingles (one shingle of all words where there are
fewer). Signatures follow the weighted minwise scheme of hierarchical Poisson processes: a
shingle that occurs c times sees the points of a Poisson process over weights up to c, the
weights being split into dyadic stretches (0,1], (1,2], (2,4], ... with a process each; a
stretch that c only reaches into keeps the points at or below c. Points come in order of
time and are dropped once they are later than every register of their document, so each
shingle costs about one point. Two registers agree with the probability of the weighted
Jaccard similarity.

Documents with the same text are one node. Nodes that agree in a band are compared, first
each with its bucket's pivot. Where a bucket still holds several classes, its nodes outside
the largest class are compared with all others, in blocks; so every pair of a bucket is either
checked or already in one class. Checks compute the exact multiset similarity from the texts,
and each task returns a forest of links. Classes are the connected components of the links.

Defined results: null or empty texts (no words) are each a class of their own; repeated
rows are in one class, and different texts with one id are judged each by itself (classes that
have the same least id then share its name); a row with a null id is a class of its own, without
a name (null), and no node; an empty table gives an empty table; other
columns pass through (columns named like results are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .hashing import ODD, mix, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
REGISTERS = BANDS * ROWS
SLICE_BYTES = 2_000_000
#: Shingles, or products of shingles, worked on at a time.
STRETCH = 1 << 20
#: Nodes of a bucket that a task holds, and their shingles; larger buckets are in several units.
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Nodes compared with a pivot in one unit.
UNIT = 4096


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, shingles before each text and in all)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    bounds = (np.asarray(lists.offsets) - lists.offsets[0].as_py()).astype(np.int64)
    real = np.asarray(pc.binary_length(flat)) > 0
    kept = np.concatenate([[0], np.cumsum(real)])
    bounds = kept[bounds]
    h = word_hashes(flat.filter(pa.array(real)))
    counts = np.diff(bounds)
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    before = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(counts)), n)
    at = bounds[:-1][doc] + np.arange(before[-1]) - before[:-1][doc]
    out = np.zeros(len(at), dtype=np.uint64)
    short = counts[doc] < WORDS
    for k in range(WORDS):
        inside = ~short | (k < counts[doc])
        out[inside] += h[at[inside] + k] * ODD[k]
    return mix(out), before


def multiset(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, times) of each different shingle of each document."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(first)
    return d[starts], h[starts], np.diff(np.append(starts, len(h)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers points: the earliest of each register; infinite for documents without shingles."""
    least = np.full((n, registers), np.inf)
    for k in range(0, len(doc), STRETCH):
        part = slice(k, k + STRETCH)
        _lower(least, doc[part], element[part], weight[part])
    return least


def _lower(points: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> None:
    """Take more shingles into the points."""
    n, registers = points.shape
    parts = [(doc, element, np.zeros(len(doc), dtype=np.int64), np.ones(len(doc), dtype=np.int64), weight)]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:
        k = len(more)
        parts.append((doc[more], element[more], np.full(k, low), np.full(k, low), weight[more]))
        low *= 2
    doc, element, base, width, weight = (np.concatenate(x) for x in zip(*parts))
    seed = mix(element + (base.astype(np.uint64) + np.uint64(1)) * ODD[1])
    time = np.zeros(len(doc))
    least = points.reshape(-1)
    last = points.max(axis=1)
    step = np.uint64(0)
    while len(doc):
        step += np.uint64(1)
        draw = mix(seed + np.uint64((int(step) * int(ODD[2])) & 0xFFFFFFFFFFFFFFFF))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(uniform) / width
        early = time < last[doc]
        doc, seed, time, base, width, weight = doc[early], seed[early], time[early], base[early], width[early], weight[early]
        draw = mix(draw[early] + ODD[3])
        register = (draw % np.uint64(registers)).astype(np.int64)
        level = base + 1 + ((draw >> np.uint64(32)).astype(np.int64) * width >> 32)
        seen = level <= weight
        np.minimum.at(least, doc[seen] * registers + register[seen], time[seen])
        last = points.max(axis=1)
        more = time < last[doc]
        doc, seed, time, base, width, weight = doc[more], seed[more], time[more], base[more], width[more], weight[more]


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit hash for each document and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, rows)
    out = np.zeros(bits.shape[:2], dtype=np.uint64)
    for k in range(rows):
        out = mix(out * ODD[4] + bits[:, :, k])
    out = mix(out + np.arange(bits.shape[1], dtype=np.uint64) * ODD[0])
    return out.view(np.int64)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(sizes):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, side="right")))
        yield at, end
        at = end


def text_key(column: str) -> Column:
    return F.md5(F.coalesce(F.col(column), F.lit("")))


def sketch(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_key, shingles, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for a, b in _slices(texts):
                part = texts.slice(a, b - a)
                h, before = shingles(part)
                n = len(part)
                values = bands(signatures(*multiset(h, before), n))
                sizes = np.diff(before)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[sizes > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), lists],
                    names=["doc_id", "text_key", "shingles", "bands"],
                )

    text = F.coalesce(F.col(text_column), F.lit(""))
    return df.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("text_key"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_key string, shingles long, bands array<long>"
    )


class Forest:
    """Classes joined so far, in this task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


class Bags:
    """Shingles of some nodes, in order of shingle, and what else is known of the nodes."""

    def __init__(self, node: list[int], kind: list[int], doc: np.ndarray, element: np.ndarray, times: np.ndarray):
        order = np.argsort(element, kind="stable")
        self.node, self.kind = node, kind
        self.element, self.owner, self.times = element[order], doc[order], times[order]
        self.total = np.bincount(doc, weights=times, minlength=len(node)).astype(np.int64)

    def close(self, doc: np.ndarray, element: np.ndarray, times: np.ndarray, n: int, at_least: float) -> tuple[np.ndarray, np.ndarray]:
        """(other, own) pairs whose multiset similarity is at_least or more; others are n bags."""
        first, after = np.searchsorted(self.element, element, side="left"), np.searchsorted(self.element, element, side="right")
        hits = after - first
        at = np.repeat(first - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
        pair = np.repeat(doc, hits) * len(self.node) + self.owner[at]
        both = np.bincount(pair, weights=np.minimum(np.repeat(times, hits), self.times[at]), minlength=n * len(self.node)).reshape(n, -1)
        total = np.bincount(doc, weights=times, minlength=n)
        return np.nonzero((both > 0) & (both >= at_least * (total[:, None] + self.total[None, :] - both)))


UNITS = "u0 long, u1 int, u2 int, held boolean, node long, class long, text string"


def linked(units: DataFrame, at_least: float) -> DataFrame:
    """Links (a, b) between classes whose nodes are similar enough, of nodes that meet in a unit.

    units: UNITS. Every node of a unit that is not held is compared with the held ones of
    another class. Held nodes come first and are kept while the others pass by, so memory is
    bounded by what is held. Links that others in the task already imply are left out: what a
    task returns is a forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, unit, waiting, held = Forest(), None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            key = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            fixed, node, kind = (batch.column(k).to_pylist() for k in (3, 4, 5))
            ends = [i for i in range(1, len(key)) if key[i] != key[i - 1] or fixed[i] != fixed[i - 1]] + [len(key)]
            begin = 0
            for a, b in _slices(batch.column(6)):
                hashes, before = shingles(batch.column(6).slice(a, b - a))
                doc, element, times = multiset(hashes, before)
                doc = doc + a
                while begin < b:
                    end = min(b, next(e for e in ends if e > begin))
                    low, high = np.searchsorted(doc, [begin, end])
                    own = (doc[low:high] - begin, element[low:high], times[low:high])
                    if key[begin] != unit:
                        unit, waiting, held = key[begin], [], None
                    if fixed[begin]:
                        waiting.append((node[begin:end], kind[begin:end], *own))
                    elif waiting or held:
                        if held is None:
                            held, waiting = _held(waiting), []
                        _compare(held, node[begin:end], kind[begin:end], own, at_least, forest, out)
                    begin = end
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    order = ["u0", "u1", "u2"]
    dealt = units.select(*[x.split()[0] for x in UNITS.split(", ")]).repartition(*order).sortWithinPartitions(*order, F.desc("held"))
    return dealt.mapInArrow(run, "a long, b long")


def _held(parts: list[tuple]) -> Bags:
    node = [x for p in parts for x in p[0]]
    kind = [x for p in parts for x in p[1]]
    base = np.cumsum([0, *[len(p[0]) for p in parts]])
    return Bags(node, kind, np.concatenate([p[2] + k for p, k in zip(parts, base)]), *(np.concatenate([p[i] for p in parts]) for i in (3, 4)))


def _compare(held: Bags, node: list[int], kind: list[int], own: tuple, at_least: float, forest: Forest, out: list) -> None:
    doc, element, times = own
    # a stretch of rows whose products with the held bags fit in memory
    step = max(1, STRETCH // max(1, len(held.node) * max(1, -(-len(doc) // max(1, len(node))))))
    for a in range(0, len(node), step):
        b = min(len(node), a + step)
        roots = {forest.root(k) for k in held.kind}
        if len(roots) == 1 and all(forest.root(k) in roots for k in kind[a:b]):
            continue
        low, high = np.searchsorted(doc, [a, b])
        for i, j in zip(*(x.tolist() for x in held.close(doc[low:high] - a, element[low:high], times[low:high], b - a, at_least))):
            x, y = kind[a + i], held.kind[j]
            if node[a + i] != held.node[j] and forest.join(x, y):
                out.append((min(x, y), max(x, y)))


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node of its component, for each node that has a link."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        hop = labels.select(F.col("node").alias("class"), F.col("class").alias("far"))
        moved = labels.join(near, "node").join(hop, "class", "left")
        after = stored(
            moved.select("node", F.least("class", "near", "far").alias("class"), (F.least("class", "near", "far") < F.col("class")).alias("moved")), "labels"
        )
        discard(labels)
        again = not after.where("moved").isEmpty()
        labels = after
        if not again:
            discard(edges)
            return labels.select("node", "class")


def around_pivots(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Units of a pivot (a) and nodes to compare with it (b); pivots of many are in several units."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    rows = pairs.join(sizes, "a").select(F.col("a").alias("u0"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("u1"), F.col("b").alias("node"))
    pivots = sizes.select(F.col("a").alias("u0"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u1"), F.col("a").alias("node"))
    both = rows.withColumn("held", F.lit(False)).unionByName(pivots.withColumn("held", F.lit(True)))
    return both.join(texts.select("node", "text"), "node").withColumns({"u2": F.lit(0), "class": F.col("node")})


def across_classes(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Units of buckets (band) whose members (node, class) are in several classes.

    All nodes but those of the bucket's largest class are held, in blocks of bounded size, and
    every member passes by every block; so a bucket of one large class and a few others takes
    rows in proportion to its members.
    """
    by_class = members.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    sizes = (
        by_class.groupBy("band")
        .agg(F.max(F.struct("n", "class", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("classes"))
        .where("classes > 1 AND n > 2")  # of two, one is the pivot: they are compared
    )
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select(
        "band", F.col("top.class").alias("largest"), blocks(F.col("n"), F.col("shingles")).alias("parts"),
        blocks(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("blocks"),
    )
    own = members.join(sizes, "band").join(texts.select("node", "text"), "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    facts = [F.col("band").alias("u0"), "node", "class", "text"]
    passing = own.select(*facts, part("parts").alias("u1"), every("blocks").alias("u2"), F.lit(False).alias("held"))
    held = own.where(F.col("class") != F.col("largest")).select(*facts, every("parts").alias("u1"), part("blocks").alias("u2"), F.lit(True).alias("held"))
    return passing.unionByName(held)


def led(df: DataFrame, id_column: str, text_column: str, at_least: float) -> DataFrame:
    """(doc_id, text_key, shingles, lead_id, lead_key): the least document of each row's class; null for a row without a node."""
    small_batches(df.sparkSession)
    sketched = stored(sketch(df, id_column, text_column), "sketches")
    nodes = stored(
        sketched.where((F.size("bands") > 0) & F.col("doc_id").isNotNull())
        .groupBy("text_key")
        .agg(F.min(F.struct("doc_id", "shingles", "bands")).alias("x"))
        .select(F.monotonically_increasing_id().alias("node"), "text_key", "x.doc_id", F.col("x.shingles").alias("shingles"), F.col("x.bands").alias("bands")),
        "nodes",
    )
    in_bands = nodes.select("node", "shingles", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min(F.struct("node", "shingles")).alias("p"), F.count("*").alias("n")).where("n > 1")
    members = stored(in_bands.join(buckets.select("band", F.col("p.node").alias("pivot"), F.col("p.shingles").alias("pivot_shingles")), "band"), "members")
    named = nodes.select("node", "text_key", "doc_id").join(members.select("node").distinct(), "node", "left_semi")
    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("text_key"), F.col(text_column).alias("text"))
    texts = stored(texts.join(named, ["text_key", "doc_id"]).select("node", "text").dropDuplicates(["node"]), "texts")
    close = F.least("shingles", "pivot_shingles") >= at_least * F.greatest("shingles", "pivot_shingles")  # else the sizes alone rule it out
    pairs = stored(members.where((F.col("node") != F.col("pivot")) & close).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(linked(around_pivots(pairs, texts), at_least), "links")
    found = components(links)
    own = stored(members.join(found, "node", "left").select("band", "node", "shingles", F.coalesce("class", "node").alias("class")), "members")
    more = stored(linked(across_classes(own, texts), at_least), "links")
    if not more.isEmpty():
        again = components(more).select(F.col("node").alias("class"), F.col("class").alias("final"))
        # classes of one node have no row in found yet
        alone = again.select(F.col("class").alias("node"), "class").join(found.select("node"), "node", "left_anti")
        found = found.unionByName(alone).join(again, "class", "left").select("node", F.coalesce("final", "class").alias("class"))
    discard(members, own, texts, pairs, links, more)
    named = nodes.join(found, "node", "left").select("text_key", "doc_id", F.coalesce("class", "node").alias("class"))
    leads = named.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("lead"))
    named = named.join(leads, "class").select("text_key", F.col("lead.doc_id").alias("lead_id"), F.col("lead.text_key").alias("lead_key"))
    return sketched.join(named, "text_key", "left").select("doc_id", "text_key", "shingles", "lead_id", "lead_key")


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", at_least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, shingles): one row for each row of df; the class is its least document."""
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead_id", "doc_id"))
    return led(df, id_column, text_column, at_least).select("doc_id", class_id.alias("class_id"), "shingles")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", at_least: float = SIMILARITY) -> DataFrame:
    """df with one document of each class: the one with the least id (a null id is kept)."""
    first = F.col("lead_key").isNull() | ((F.col("doc_id") == F.col("lead_id")) & (F.col("text_key") == F.col("lead_key")))
    keep = led(df, id_column, text_column, at_least).where(first).select(F.col("doc_id").alias(id_column), F.col("text_key").alias("_text_key")).distinct()
    one = df.withColumn("_text_key", text_key(text_column)).join(keep, [id_column, "_text_key"], "left_semi").dropDuplicates([id_column, "_text_key"])
    return one.drop("_text_key").unionByName(df.where(F.col(id_column).isNull()))
