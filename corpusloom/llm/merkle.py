"""Operator 11: a Merkle manifest of a dataset, stored in van Emde Boas layout.

Each row is a leaf, the SHA-256 of its columns. Per language the leaves ascend by id; runs of eight become the hash of
their digests, until one, the subroot, is left; the subroots, by language, become the root in the same way.

A tree is stored as aligned subtrees (blocks) of 8^RISE leaves. A block holds its digests in one binary value in van Emde Boas
order: the tree is cut at half its height, the top comes first, then the bottoms from left to right, each laid out likewise.
place() finds a node of any level by arithmetic on its number alone; building a block and reading siblings from it both go
through it, and no pointer is stored. The roots of a tier's blocks are the leaves of the next tier, so blocks recurse
until a language has one root; the same is done with the subroots.

manifest() builds the blocks from the bottom up; proofs() goes from the top down: a block's siblings, and those above it, are
the upper part of the path of each of its leaves. Every step is a shuffle of narrow rows to the block they belong to, sorted by
position, so a task streams blocks of bounded size; a language of any size is spread over its blocks. Positions come from sampled
ranges of (language, id). What is broadcast is a row per language, if there are no more than FEW.

Nulls: a null column counts as "-"; a null language is one of its own, the first; a null id comes first in its language. Equal
rows have equal leaves, next to each other; rows of equal id are ordered by leaf. Empty table: no rows. Texts are hashed whole. Only the five columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.shared import ascii_lower, stored
from corpusloom.operators.rank import ranged_prefix_sums
from corpusloom.operators.sides import few

FAN = 8
RISE = 4  # by default
"""Levels that a block rises above its leaves: 4,096 leaves and 4,681 digests (150 KB) a block."""

_BITS = 3  # of FAN
_PATH = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


@cache
def place(levels: int, depth: int) -> np.ndarray:
    """The places of all nodes of a depth (0: the root), left to right, in a complete tree of so many levels in van Emde Boas order."""
    index = np.arange(FAN**depth)
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        tree, index = np.divmod(index, FAN**depth)  # which bottom tree, and where in it
        at += _size(top) + tree * _size(levels)
    return at


def _size(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def layout(leaves: list[str], rise: int) -> tuple[bytes, str]:
    """The digests of the tree over some leaves in van Emde Boas order, up to the last one there is, and the root. Absent nodes are zeros."""
    levels, found = rise + 1, {}
    for depth in range(rise, -1, -1):
        found.update(zip(place(levels, depth)[: len(leaves)].tolist(), leaves, strict=True))
        if depth:
            leaves = [digest_of(leaves[i : i + FAN]) for i in range(0, len(leaves), FAN)]
    out = bytearray(32 * (max(found) + 1))
    for at, digest in found.items():
        out[32 * at : 32 * at + 32] = bytes.fromhex(digest)
    return bytes(out), leaves[0]


class Block:
    """A stored block of n leaves, and the path (siblings before and after, level by level) above its root."""

    def __init__(self, nodes: bytes, n: int, rise: int, upper: list[dict]):
        self.nodes, self.n, self.rise = nodes, n, rise
        self.upper = [(x["before"], x["after"]) for x in upper]
        self.runs: dict[tuple[int, int], list[str]] = {}

    def run(self, level: int, number: int) -> list[str]:
        """The digests of a run of siblings."""
        key = level, number
        if key not in self.runs:
            last = (self.n + (1 << _BITS * level) - 1 >> _BITS * level) - 1
            at = place(self.rise + 1, self.rise - level)[number * FAN : min(number * FAN + FAN, last + 1)]
            self.runs[key] = [self.nodes[32 * a : 32 * a + 32].hex() for a in at.tolist()]
        return self.runs[key]

    def leaf(self, index: int) -> str:
        if not self.rise:
            return self.nodes[:32].hex()
        return self.run(0, index // FAN)[index % FAN]

    def path(self, index: int) -> list[tuple[str, str]]:
        out = []
        for level in range(self.rise):
            run, i = self.run(level, index >> _BITS), index % FAN
            out.append(("".join(run[:i]), "".join(run[i + 1 :])))
            index >>= _BITS
        return out + self.upper


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = digest_of([before, leaf, after])
    return leaf


def _levels(n: Column) -> Column:
    """How often runs of eight are taken until one of n nodes is left."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / _BITS)).otherwise(F.lit(0)).cast("int")


def _streamed(df: DataFrame, schema: T.StructType, step: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """A generator over the rows of each partition, whatever its batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in step(r for b in batches for r in b.to_pylist()):
            out.append(row)
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


_BLOCKS = T.StructType([T.StructField("g", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("levels", T.IntegerType()), T.StructField("rise", T.IntegerType()), T.StructField("root", T.StringType()), T.StructField("nodes", T.BinaryType())])


def _built(leaves: DataFrame, tier: int, most: int) -> DataFrame:
    """The blocks over a tier's leaves (g, pos, digest, levels), rising `most` levels at most."""
    rise = F.least(F.lit(most), F.col("levels") - most * tier).alias("rise")
    rows = leaves.select("g", F.shiftright("pos", _BITS * most).alias("block"), "pos", "digest", "levels", rise)

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        key, held, last = None, [], None
        for row in rows:
            if key != (row["g"], row["block"]):
                if held:
                    yield made(held, last)
                key, held = (row["g"], row["block"]), []
            held.append(row["digest"])
            last = row
        if held:
            yield made(held, last)

    def made(held: list[str], row: dict) -> dict:
        nodes, root = layout(held, row["rise"])
        return {"g": row["g"], "block": row["block"], "n": len(held), "levels": row["levels"], "rise": row["rise"], "root": root, "nodes": nodes}

    return _streamed(rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos"), _BLOCKS, step)


class Tree:
    """The tiers of blocks over leaves (g, pos, digest, levels) of each g, and its root."""

    def __init__(self, leaves: DataFrame, name: str, rise: int = RISE):
        self.tiers, self.rise, roots = [], rise, []
        while True:
            tier = len(self.tiers)
            blocks = stored(_built(leaves, tier, rise), f"{name}-blocks-{tier}")
            self.tiers.append(blocks)
            ended = F.col("levels") <= rise * (tier + 1)
            roots.append(blocks.where(ended).select("g", "root", "levels"))
            leaves = blocks.where(~ended).select("g", F.col("block").alias("pos"), F.col("root").alias("digest"), "levels")
            if leaves.isEmpty():
                break
        self.roots = roots[0]
        for r in roots[1:]:
            self.roots = self.roots.unionByName(r)

    def paths(self, rows: DataFrame, above: DataFrame, fields: list[T.StructField], emit: Callable[[dict, str, list], dict]) -> DataFrame:
        """What emit(row, leaf, path) makes of each of some rows (g, pos and more) that are leaves. above: g and upper, the path over its root."""
        uppers = None
        for tier in range(len(self.tiers) - 1, -1, -1):
            blocks = self.tiers[tier]
            top = blocks.where(F.col("levels") <= self.rise * (tier + 1)).join(few(above.select(F.col("g").alias("of"), "upper")), F.col("g").eqNullSafe(F.col("of")))
            heads = top.select(*blocks.columns, "upper")
            if uppers is not None:
                same = F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("number"))
                heads = heads.unionByName(blocks.join(uppers, same).select(*blocks.columns, "upper"))
            if not tier:
                return _walked(heads, rows, fields, emit, self.rise)
            under = self.tiers[tier - 1].where(F.col("levels") > self.rise * tier).select("g", F.col("block").alias("pos"))
            made = _walked(heads, under, [T.StructField("of", T.StringType()), T.StructField("number", T.LongType()), T.StructField("upper", _PATH)], _upper, self.rise)
            uppers = stored(made, "uppers")


def _upper(row: dict, _: str, path: list) -> dict:
    return {"of": row["g"], "number": row["pos"], "upper": [{"before": b, "after": a} for b, a in path]}


def _walked(heads: DataFrame, rows: DataFrame, fields: list[T.StructField], emit: Callable, rise: int) -> DataFrame:
    """Rows meet their block: it comes first in a stream sorted by block and position."""
    more = [c for c in rows.columns if c not in ("g", "pos")]
    empty = F.lit(None)
    types = dict(rows.dtypes)
    head = heads.select("g", "block", F.lit(-1).cast("long").alias("pos"), "n", "rise", "nodes", "upper", *(empty.cast(types[c]).alias(c) for c in more))
    body = rows.select("g", F.shiftright("pos", _BITS * rise).alias("block"), F.col("pos").cast("long").alias("pos"), empty.cast("int").alias("n"), empty.cast("int").alias("rise"), empty.cast("binary").alias("nodes"), empty.cast(_PATH).alias("upper"), *more)
    both = head.unionByName(body).repartition("g", "block").sortWithinPartitions("g", "block", "pos")

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        block = None
        for row in rows:
            if row["pos"] < 0:
                block = Block(row["nodes"], row["n"], row["rise"], row["upper"])
            else:
                index = row["pos"] % FAN**rise
                yield emit(row, block.leaf(index), block.path(index))

    return _streamed(both, T.StructType(fields), step)


def leaves(df: DataFrame, id_col: str, columns: tuple[str, ...], group_col: str, text_col: str) -> DataFrame:
    """id, g, leaf and tampered: the digest of a row's columns, and of the row whose text has A-Z in lower case where the checksum of its id says so."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    strings = {c: F.col(c).cast("string") for c in columns}
    of = lambda more: F.sha2(F.concat(*(field(more.get(c, x)) for c, x in strings.items())), 256)
    leaf = of({})
    chosen = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    tampered = F.when(chosen, of({text_col: ascii_lower(strings[text_col])}))
    return df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("g"), leaf.alias("leaf"), tampered.alias("tampered"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest:
    """The blocks of all trees of a dataset (languages and top), its leaves' positions, subroots and root."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, group_col: str = "lang", text_col: str = "text", rise: int = RISE):
        made = stored(leaves(df, id_col, columns, group_col, text_col), "leaves")
        counts = made.groupBy("g").agg(_levels(F.count("*")).alias("levels")).select(F.col("g").alias("of"), "levels")
        numbered = ranged_prefix_sums(made, ["g"], [F.asc_nulls_first("id"), F.col("leaf")], {"nth": F.lit(1).cast("long")})
        placed = numbered.withColumn("pos", F.col("nth") - 1).join(few(counts), F.col("g").eqNullSafe(F.col("of")))
        self.rows = stored(placed.select("g", "pos", "id", "leaf", "tampered", "levels"), "placed")
        self.trees = Tree(self.rows.select("g", "pos", F.col("leaf").alias("digest"), "levels"), "language", rise)
        self.subroots = stored(self.trees.roots.select("g", F.col("root").alias("subroot")), "subroots")
        ranked = ranged_prefix_sums(self.subroots, [], [F.asc_nulls_first("g")], {"nth": F.lit(1).cast("long")})
        n = self.subroots.agg(_levels(F.count("*")).alias("levels"))
        one = F.lit(None).cast("string").alias("g")
        self.order = stored(ranked.crossJoin(F.broadcast(n)).select(F.col("g").alias("lang"), (F.col("nth") - 1).alias("pos"), F.col("subroot").alias("digest"), "levels"), "order")
        self.top = Tree(self.order.select(one, "pos", "digest", "levels"), "top", rise)
        self.root = self.top.roots.select("root")  # one row

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256 and folded_root of every row."""
        nothing = self.top.roots.select("g", F.array().cast(_PATH).alias("upper"))
        ranks = self.order.select(F.lit(None).cast("string").alias("g"), "pos", "lang")
        upper = [T.StructField("g", T.StringType()), T.StructField("upper", _PATH)]
        above = self.top.paths(ranks, nothing, upper, lambda row, _, path: {"g": row["lang"], "upper": [{"before": b, "after": a} for b, a in path]})
        above = stored(above, "above")

        def emit(row: dict, leaf: str, path: list[tuple[str, str]]) -> dict:
            return {"id": row["id"], "of": row["g"], "leaf": leaf, "proof_sha256": digest_of([x for level in path for x in level]), "folded_root": folded(row["tampered"] or leaf, path)}

        rows = self.rows.select("g", "pos", "id", "tampered")
        fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.StringType()) for c in ("of", "leaf", "proof_sha256", "folded_root"))]
        out = self.trees.paths(rows, above, fields, emit)
        known = out.join(few(self.subroots), F.col("of").eqNullSafe(F.col("g"))).crossJoin(F.broadcast(self.root))
        return known.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The proofs of every row of a manifest made for it."""
    return Manifest(df, id_col).proofs()


def _tree_sql(name: str, leaves: str, height: int) -> str:
    """Levels of the trees over a relation (g, pos, d), and each node's siblings before and after."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {leaves})"]
    for k in range(height):
        run = f"OVER (PARTITION BY g, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}_at{k} AS (SELECT g, pos, c, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
        up = f"SELECT g, pos // {FAN} AS pos, CASE WHEN max(c) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY g, pos // {FAN}"
        out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ({up}))")
    return ",\n".join(out)


def _fold_sql(rows: str, name: str, height: int, g: str, pos: str) -> str:
    """Rows with cur and proof, taken up through the levels."""
    for k in range(height):
        rows = f"(SELECT r.* EXCLUDE (cur, proof), CASE WHEN t.c > 1 THEN sha256(t.b || r.cur || t.a) ELSE r.cur END AS cur, r.proof || t.b || t.a AS proof FROM {rows} r JOIN {name}_at{k} t ON t.g = r.{g} AND t.pos = r.{pos} // {FAN**k})"
    return rows


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_HEIGHTS = 6, 3  # 262,144 rows per language, 512 languages
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The CRC-32 of a short ASCII string, bit by bit: each character and seven zeros, shifted through the reversed polynomial.
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"

SQL = f"""
WITH base AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql(_LOWER_SQL)} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
leaves AS (SELECT g, pos, leaf AS d FROM placed),
{_tree_sql("l", "leaves", _HEIGHTS[0])},
subroots AS (SELECT 0 AS g, g - 1 AS pos, d FROM l{_HEIGHTS[0]}),
{_tree_sql("t", "subroots", _HEIGHTS[1])},
rows AS (SELECT doc_id, leaf, g, pos, 0 AS top, g - 1 AS rank, coalesce(tampered, leaf) AS cur, '' AS proof FROM placed),
folded AS (SELECT * FROM {_fold_sql(_fold_sql("rows", "l", _HEIGHTS[0], "g", "pos"), "t", _HEIGHTS[1], "top", "rank")})
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.d AS verified
FROM folded f JOIN subroots s ON s.pos = f.rank CROSS JOIN t{_HEIGHTS[1]} t
"""
