"""Operator 4: near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

1. A text is its shingles of five words, with weights tf * idf. idf falls from 1, for shingles in
   fewer than `floor` of all documents, to 1/2 for one in all. Only shingles at or over that
   floor need a count; there are at most (mean shingles per document) / floor of them, found
   exactly in two passes: counts of 65,536 hash buckets, then of the shingles in buckets that reach the floor.
2. Improved consistent weighted sampling (Ioffe) draws `bands` * `rows` samples of each text; two
   texts share a sample with the probability of their weighted Jaccard similarity.
3. Texts that share all samples of a band, its bucket, are candidates. Equal texts count once.
4. A candidate pair is a link if its exact weighted Jaccard similarity reaches the threshold.
5. Classes are the connected components of the links; a class is named by its smallest id.

Buckets are not expanded into all pairs: each round compares a bucket's members with one leader. The
first leader is the member that meets the most others over all its bands (ties: the smallest id), as a
text from which others were copied does. If a bucket's members are then still in several classes, the next
such member outside the first leader's class leads, and is compared with the members of all other classes.
So the work of a round is linear in the members. What is left, every two members of a bucket that are still in
different classes, is compared in cells: parts of a bucket of about CELL members, each pair of parts in one
place, with the text of each member once. Large buckets are parted by total weight first, as texts whose total
weights differ by more than the threshold can't be linked. So no pair that shares a bucket is left out, unless
links that were found already connect it.

Null text: empty; texts without words are alike only if equal. Null id: class null, not compared.
Rows of equal id are one document. Repeated rows: one result each. Empty table: none. Other
columns are not read by classes(); keep_one() returns them unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import Words, map_columns, mixed, powers, shingles
from corpusloom.llm.shared import Steps, stored

BUCKET_BITS = 16
CELLS = 1 << 14
PART = 128
CELL = 256

COUNTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
SIGNATURES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("digest2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("total", T.DoubleType()),
    ]
)
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def _weighed(column: pa.Array, k: int, idf: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of texts laid end to end: hash (by text, then hash), weight, and first index of each text."""
    hashes, first = shingles(Words(column), k)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(hashes)))
    hashes, row = hashes[at], row[at]
    weight = tf.astype(np.float64)
    if len(idf["hash"]):
        near = np.minimum(np.searchsorted(idf["hash"], hashes), len(idf["hash"]) - 1)
        weight *= np.where(idf["hash"][near] == hashes, idf["idf"][near], 1.0)
    return hashes, weight, np.searchsorted(row, np.arange(len(column) + 1))


class Sampler:
    """Draws consistent weighted samples. The random variables of sample k and shingle h are those of one of CELLS cells, by a hash of both; what is left of the hash parts shingles in the same cell."""

    def __init__(self, samples: int):
        rng = np.random.default_rng(41)
        self.r = rng.gamma(2.0, 1.0, (samples, CELLS)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, (samples, CELLS))).astype(np.float32)
        self.beta = rng.random((samples, CELLS), np.float32)
        self.odd = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # At weight 1: t = floor(beta) = 0, log y = -r * beta, log a = log c - log y - r.
        self.plain = self.ordered(self.log_c + self.r * self.beta - self.r)

    @staticmethod
    def ordered(x: np.ndarray) -> np.ndarray:
        """Single-precision numbers as 64-bit ones in the same order, low half 0."""
        bits = x.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        return bits.astype(np.uint64) << np.uint64(32)

    def draw(self, hashes: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """samples x texts: what identifies each text's sample; texts without shingles are left 0."""
        out = np.zeros((len(self.odd), len(first) - 1), np.uint64)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            return out
        other = np.flatnonzero(weight != 1.0)
        log_w = np.log(weight[other]).astype(np.float32)
        low = np.uint64(0xFFFFFFFF)
        for k, odd in enumerate(self.odd):
            x = hashes * odd
            cell = x >> np.uint64(50)
            key = self.plain[k][cell] | (x >> np.uint64(8)) & low
            if len(other):
                c = cell[other]
                r, beta = self.r[k][c], self.beta[k][c]
                t = np.floor(log_w / r + beta)
                log_a = self.log_c[k][c] - r * (t - beta) - r
                # The sample is the shingle with its t, which the cell and log a tell.
                key[other] = self.ordered(log_a) | key[other] & low
            out[k, full] = np.minimum.reduceat(key, first[full])
        return out


_samplers: dict[int, Sampler] = {}


def _signatures(k: int, bands: int, rows: int, idf: dict[str, np.ndarray]):
    def run(columns):
        n = bands * rows
        if n not in _samplers:
            _samplers[n] = Sampler(n)
        hashes, weight, first = _weighed(columns[1], k, idf)
        got = _samplers[n].draw(hashes, weight, first).reshape(bands, rows, -1)
        mix = powers(rows + 1, 0xC2B2AE3D27D4EB4F)[1:, None]
        keys = np.stack([mixed((band * mix).sum(axis=0, dtype=np.uint64) + np.uint64(i)) for i, band in enumerate(got)], axis=1)
        keys = keys.view(np.int64)
        empty = ~got.any(axis=(0, 1))
        yield {
            "id": columns[0],
            "digest": columns[2],
            "digest2": columns[3],
            "bands": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]), pa.int32()), pa.array(keys[~empty].reshape(-1))),
            "total": np.diff(np.concatenate([[0.0], np.cumsum(weight)])[first]),
        }

    return run


def _verified(k: int, idf: dict[str, np.ndarray], threshold: float):
    """The links among runs of rows (a, salt, b, text): each run begins with the text of a, with b null, and goes on with texts of b."""
    run_of, left = None, None

    def run(columns):
        nonlocal run_of, left
        hashes, weight, first = _weighed(columns[3], k, idf)
        out: list[tuple[int, int, float]] = []
        for i, (a, salt, b) in enumerate(zip(*(c.to_pylist() for c in columns[:3]), strict=True)):
            here = slice(first[i], first[i + 1])
            if b is None:
                run_of, left = (a, salt), (hashes[here].copy(), weight[here].copy())
            elif run_of == (a, salt):
                similarity = weighted_jaccard(*left, hashes[here], weight[here])
                if similarity >= threshold:
                    out.append((a, b, similarity))
        yield {"a": [x[0] for x in out], "b": [x[1] for x in out], "similarity": [x[2] for x in out]}

    return run


class _Cell:
    """The texts of a pair of parts that later ones are compared with, and the classes that links have joined."""

    def __init__(self, key: int):
        self.key = key
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids: list[int] = []
        self.of: list[int] = []
        self.totals: list[float] = []
        self.bands: list[np.ndarray] = []
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def add(self, i: int, of: int, bands: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> None:
        self.texts.append((hashes.copy(), weight.copy()))
        self.ids.append(i)
        self.of.append(of)
        self.totals.append(weight.sum())
        self.bands.append(bands)

    def compare(self, i: int, of: int, band: int, bands: np.ndarray, hashes: np.ndarray, weight: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """The links of a text with those held, but where links connect them already. A pair is compared in the first band that it shares."""
        out: list[tuple[int, int, float]] = []
        if not self.ids:
            return out
        total, held = weight.sum(), np.array(self.totals)
        # The similarity is the smaller total over the larger one at most.
        near = np.minimum(held, total) >= (threshold - 1e-9) * np.maximum(held, total)
        same = np.array(self.bands) == bands
        for j in np.flatnonzero(near & (same.argmax(axis=1) == band) & same[:, band]).tolist():
            x, y = self.root(of), self.root(self.of[j])
            if x != y and (similarity := weighted_jaccard(*self.texts[j], hashes, weight)) >= threshold:
                out.append((min(i, self.ids[j]), max(i, self.ids[j]), similarity))
                self.parent[y] = x
        return out


def _compared(k: int, idf: dict[str, np.ndarray], threshold: float):
    """The links in runs of rows (cell, right, text, id, class_id, band, bands, alone): texts of the left part, then of the right one; or those of one part alone."""
    cell = None

    def run(columns):
        nonlocal cell
        hashes, weight, first = _weighed(columns[2], k, idf)
        bands = columns[6].flatten().to_numpy().reshape(len(columns[0]), -1)
        keys, right, ids, of, band, alone = (columns[i].to_pylist() for i in (0, 1, 3, 4, 5, 7))
        out: list[tuple[int, int, float]] = []
        for i, key in enumerate(keys):
            if cell is None or cell.key != key:
                cell = _Cell(key)
            here = hashes[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]
            if right[i] or alone[i]:
                out += cell.compare(ids[i], of[i], band[i], bands[i], *here, threshold)
            if not right[i]:
                cell.add(ids[i], of[i], bands[i].copy(), *here)
        yield {"a": [x[0] for x in out], "b": [x[1] for x in out], "similarity": [x[2] for x in out]}

    return run


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum of the smaller weights over the sum of the larger ones; hashes sorted and distinct."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h1, h2), len(h1) - 1)
    both = h1[at] == h2
    smaller = np.minimum(w1[at[both]], w2[both]).sum()
    return float(smaller / (w1.sum() + w2.sum() - smaller))


def inverse_frequencies(docs: DataFrame, k: int, floor: float, steps: Steps) -> dict[str, np.ndarray]:
    """hash (sorted) and idf of every shingle in at least `floor` of the documents. docs: id, text."""

    def buckets(columns):
        h, _ = shingles(Words(columns[1]), k)
        n = np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(n)
        yield {"key": np.append(at, -1), "n": np.append(n[at], len(columns[0]))}

    counts = map_columns(docs, COUNTS, buckets).groupBy("key").agg(F.sum("n").alias("n"))
    none = {"hash": np.zeros(0, np.uint64), "idf": np.zeros(0)}
    counts = steps.stored(counts, "buckets")  # 65,537 rows at most
    total = next((r.n for r in counts.where("key = -1").collect()), 0)
    least = max(2.0, floor * total)
    heavy = np.zeros(1 << BUCKET_BITS, bool)
    heavy[[r.key for r in counts.where((F.col("key") >= 0) & (F.col("n") >= least)).select("key").collect()]] = True
    if not heavy.any():
        return none

    def exact(columns):
        h, first = shingles(Words(columns[1]), k)
        row = np.repeat(np.arange(len(columns[0])), np.diff(first))
        at = np.flatnonzero(heavy[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)])
        h, row = h[at], row[at]
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        value, n = np.unique(h[new], return_counts=True)
        yield {"key": value.view(np.int64), "n": n}

    # At most (mean shingles per document) / floor rows: a few thousand.
    found = map_columns(docs, COUNTS, exact).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    h = np.array([r.key for r in found], np.int64).view(np.uint64)
    n = np.array([r.n for r in found], float)
    order = np.argsort(h)
    share = np.clip(np.log(total / n[order]) / math.log(1 / floor), 0.0, 1.0) if len(n) else n
    return {"hash": h[order], "idf": (1 + share) / 2}


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """id and class_id (the smallest id it is connected with) of every node of links (a, b).

    Every node takes the smallest label around it, then that label's own label, until nothing changes:
    a number of rounds that grows as the logarithm of the longest chain.
    """
    steps = steps or Steps()
    both = steps.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = steps.stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        around = both.join(labels.withColumnsRenamed({"id": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        least = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.withColumnsRenamed({"id": "next", "label": "far"})
        after = steps.stored(least.join(jump, "next").select("id", "label", F.least("next", "far").alias("next")), "labels")
        if after.where("label != next").isEmpty():
            return labels.withColumnRenamed("label", "class_id")
        labels = after.select("id", F.col("next").alias("label"))


class NearDuplicates:
    """The steps of this operator over one table of id and text."""

    def __init__(self, docs: DataFrame, threshold: float, k: int, bands: int, rows: int, floor: float, steps: Steps | None = None):
        self.docs, self.threshold, self.k, self.steps = docs, threshold, k, steps or Steps()
        self.idf = inverse_frequencies(docs, k, floor, self.steps)
        digests = docs.select("id", "text", F.xxhash64("text").alias("digest"), F.xxhash64("text", F.lit(1)).alias("digest2"))
        signed = self.steps.stored(map_columns(digests, SIGNATURES, _signatures(k, bands, rows, self.idf)), "signatures")
        one = signed.groupBy("digest", "digest2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min("total").alias("total"))
        self.copies = signed.select("id", "digest", "digest2")
        self.reps = self.steps.stored(one, "texts")
        self.members = self.reps.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "key"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b).

        The pairs of an `a` are dealt by a salt into parts of about PART pairs; each part gets the text
        of `a` once, so no text is repeated for each pair and no part is large.
        """
        parts = self.steps.stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
        text = self.docs.select(F.col("id").alias("of"), "text")
        salts = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("of"))
        salted = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b", F.col("b").alias("of"))
        # The same plan at every size: texts are sorted, not the pairs broadcast where there are few.
        rows = salts.unionByName(salted).join(text.hint("merge"), "of").select("a", "salt", "b", "text")
        runs = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return map_columns(runs, LINKS, _verified(self.k, self.idf, self.threshold), column=3)

    def classes(self) -> DataFrame:
        """id and class_id of every document that is a copy or has a link."""
        # What is counted per bucket is stored before it is joined: a join of two plain tables can be split where a bucket is large.
        sizes = self.steps.stored(self.members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = self.steps.stored(self.members.join(sizes, ["band", "key"]), "shared")
        met = shared.groupBy("id").agg(F.sum("n").alias("met"))
        members = self.steps.stored(shared.join(met, "id").select("band", "key", "id", (-F.col("met")).alias("less")), "members")
        leader = self.steps.stored(members.groupBy("band", "key").agg(F.min(F.struct("less", "id")).alias("x")).select("band", "key", F.col("x.id").alias("leader")), "leaders")
        tested = self.steps.stored(_ordered(members.join(leader, ["band", "key"]), "id", "leader"), "pairs")
        links = self.steps.stored(self.verify(tested), "linked").select("a", "b")
        new = self.steps.stored(self._across(members, components(links, self.steps)).join(tested, ["a", "b"], "left_anti"), "pairs")
        links = self.steps.stored(links.unionByName(self.steps.stored(self.verify(new), "linked").select("a", "b")), "links")
        labels = components(links, self.steps)
        rest = self.steps.stored(self._rest(members, labels), "linked").select("a", "b")
        if not rest.isEmpty():
            labels = components(links.unionByName(rest), self.steps)
        rep = self.reps.select("digest", "digest2", "rep")
        named = rep.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "digest2", F.coalesce("class_id", "rep").alias("class_id"))
        return self.copies.join(named, ["digest", "digest2"]).groupBy("id").agg(F.min("class_id").alias("class_id"))

    def _across(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a < b) of the second leader of a bucket, and the members of other classes than its own."""
        known = self.steps.stored(members.join(labels, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "band", "key", "less"), "known")
        first = F.min_by("class_id", F.struct("less", "id")).alias("first")
        mixed_up = self.steps.stored(known.groupBy("band", "key").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most"), first).where("least != most").select("band", "key", "first"), "mixed")
        inside = self.steps.stored(known.join(mixed_up, ["band", "key"]), "mixed")
        second = inside.where("class_id != first").groupBy("band", "key").agg(F.min(F.struct("less", "id", "class_id")).alias("x"))
        lead = self.steps.stored(second.select("band", "key", F.col("x.id").alias("leader"), F.col("x.class_id").alias("of")), "leaders")
        return _ordered(inside.join(lead, ["band", "key"]).where("class_id != of"), "id", "leader")

    def _rest(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """The links of all pairs of a bucket's members that are in different classes, but for those that other such links connect."""
        known = self.steps.stored(members.select("band", "key", "id").join(labels, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")), "known")
        buckets = known.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("class_id").alias("least"), F.max("class_id").alias("most"))
        buckets = self.steps.stored(buckets.where("least != most").select("band", "key", "n"), "mixed")
        known = known.join(buckets, ["band", "key"]).join(self.reps.select(F.col("rep").alias("id"), "bands", "total"), "id")
        # Linked texts are in the same or in adjacent levels: a level's totals differ by the threshold.
        level = F.when(F.col("n") > CELL, F.floor(F.log("total") / -math.log(self.threshold - 1e-6))).otherwise(0).cast("int")
        known = self.steps.stored(known.withColumn("level", level), "rest")
        at = ["band", "key", "level"]
        sizes = self.steps.stored(known.groupBy(*at).agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "sizes")
        parted = self.steps.stored(known.join(sizes, at).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("n", "parts"), "rest")
        at = [*at, "part"]
        parts = self.steps.stored(parted.groupBy(*at).agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")), "parts")
        other = parts.withColumnsRenamed({"level": "level2", "part": "part2", "least": "least2", "most": "most2"})
        cells = parts.join(other, ["band", "key"]).where("(level2 = level and part2 >= part or level2 = level + 1) and least(least, least2) != greatest(most, most2)")
        cells = cells.withColumn("cell", F.monotonically_increasing_id()).withColumn("alone", F.expr("level = level2 and part = part2"))
        cells = self.steps.stored(cells.select("cell", "band", "key", "level", "part", "level2", "part2", "alone"), "cells")
        left = cells.select("cell", *at, "alone", F.lit(False).alias("right"))
        right = cells.where("not alone").select("cell", "band", "key", F.col("level2").alias("level"), F.col("part2").alias("part"), "alone", F.lit(True).alias("right"))
        text = self.docs.select("id", "text")
        rows = parted.join(left.unionByName(right), at).join(text.hint("merge"), "id").select("cell", "right", "text", "id", "class_id", "band", "bands", "alone")
        return map_columns(rows.repartition("cell").sortWithinPartitions("cell", "right", "id"), LINKS, _compared(self.k, self.idf, self.threshold), column=2)


def _ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The distinct pairs of two columns, the smaller one as a, without pairs of equal ids."""
    return rows.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5, bands: int = 16, rows: int = 4, floor: float = 0.05) -> DataFrame:
    """id and class_id (the smallest id of its class) of each row."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with Steps() as steps:
        found = stored(NearDuplicates(docs.where("id is not null"), threshold, k, bands, rows, floor, steps).classes(), "classes")
    return ids.join(found, "id", "left")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of the document with the smallest id of each class, and rows without id, with all their columns."""
    gone = classes(df, id_col, text_col, **settings).where("id != class_id").select("id").distinct()
    # The row as one value, so that no column name of it can clash.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("of"))
    return rows.join(gone, F.col("of") == F.col("id"), "left_anti").select("row.*")
