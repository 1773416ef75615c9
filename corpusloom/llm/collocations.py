"""Operator 12: collocations of 2 and 3 words per language, counted in quotient filters.

Texts, with A-Z in lower case, are split at `[.,;:!?\\x0A-\\x0D]` into pieces, and those into words `[^\\x20\\x09]+`.

1. Slices of texts become a list of their distinct words and a stream of numbers into it, so what is shuffled later
   is a row per slice and distinct word, not one per occurrence.
2. Words that occur `least` times or more get ids, by alphabet, from sampled ranges. No other word can stand in a phrase that is
   as frequent, so nothing is lost by leaving them out.
3. Each slice's words meet their ids, and its stream becomes n-grams of ids, packed, permuted and counted in filters
   (see quotient.py), one per shard, pre-aggregated over the slices of a task. Permuted keys are uniform, so no word pair,
   however common, makes a shard larger: it is one key with a large counter. A language has a shard per SHARD_WORDS words.
4. The sorted filters of a shard are merged as they stream in, and phrases of `least` occurrences go on.
5. Scores are joins of these phrases: the parts of a frequent phrase are as frequent, so they are there. All arithmetic is exact:
   scores are whole quotients of decimals of 38 digits (counts up to 10^15).

Null text: empty. Null language: `und`. Repeated rows count as often as they occur. Ties: by count, then phrase. Empty table, or no
phrase frequent enough: no rows. Long texts are a slice of their own. Only text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import quotient as Q
from corpusloom.llm.batches import bytes_of, slices
from corpusloom.llm.shared import Steps, stored
from corpusloom.operators.rank import ranged_prefix_sums
from corpusloom.operators.sides import few

SLICE_BYTES = 8 << 20
"""Text bytes of a slice; it has a list of distinct words per language."""

SHARD_WORDS = 4_000_000
"""Words of a language per shard: a merge holds as many distinct n-grams at most, or twice that by chance."""

HELD = 2_000_000
"""Distinct n-grams that a task holds, of one language and length, before it gives a filter."""

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of some texts as numbers into their distinct words, a -1 before each that begins a piece; and the distinct words."""
    flat, offsets = bytes_of(array)
    flat = _LOWER[flat]
    ends = _ENDS[flat]
    inside = ~(ends | _GAP[flat])
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(flat)]
    begin[cut] = inside[cut]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sizes = np.concatenate([[0], np.cumsum(end - start)])
    kind, binary = (np.int32, pa.binary()) if sizes[-1] < 1 << 31 else (np.int64, pa.large_binary())
    found = pa.Array.from_buffers(binary, len(start), [None, pa.py_buffer(sizes.astype(kind)), pa.py_buffer(flat[inside])]).dictionary_encode()
    # The piece of a word: ends before it, and texts.
    piece = np.searchsorted(np.flatnonzero(ends), start) + np.searchsorted(offsets, start, side="right")
    fresh = np.flatnonzero(np.diff(piece, prepend=-1))
    return np.insert(found.indices.to_numpy().astype(np.int32), fresh, -1), found.dictionary


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang and text in slices of SLICE_BYTES, or of one text that is longer."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            if held and size + part.nbytes > SLICE_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_SLICE = "slice long, lang string, words array<string>, counts array<long>, stream binary"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for part in _cut(batches):
        part = part.take(pc.sort_indices(part.column(0)))
        langs = part.column(0).dictionary_encode()
        starts = np.searchsorted(langs.indices.to_numpy(), np.arange(len(langs.dictionary) + 1))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            stream, words = words_of(part.column(1).slice(starts[i], starts[i + 1] - starts[i]))
            counts = np.bincount(stream[stream >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), _one_list(words.cast(pa.string())), _one_list(pa.array(counts)), pa.array([stream.tobytes()])], ["slice", "lang", "words", "counts", "stream"])
        number += 1


_FILTER = "lang string, n int, shard int, shard_bits int, filter binary"


def _filters(bits: int):
    """Streams of word ids to filters."""

    def emitted(lang: str, n: int, shard_bits: int, c: Q.Counts) -> pa.RecordBatch:
        made = Q.shards(c, Q.half_width(n, bits), shard_bits)
        k = len(made)
        return pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([n] * k, pa.int32()), pa.array([s for s, _ in made], pa.int32()), pa.array([shard_bits] * k, pa.int32()), pa.array([d for _, d in made], pa.binary())], ["lang", "n", "shard", "shard_bits", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list[Q.Counts]] = {}
        for lang, shard_bits, ids in _rows(batches):
            known = ids >= 0
            for n in (2, 3):
                at = np.flatnonzero(np.logical_and.reduce([known[j : len(ids) - n + 1 + j] for j in range(n)])) if len(ids) >= n else np.zeros(0, np.int64)
                width = Q.half_width(n, bits)
                for a in range(0, len(at), HELD):
                    packed = Q.pack([ids[at[a : a + HELD] + j] for j in range(n)], bits)
                    parts = held.setdefault((lang, n, min(shard_bits, width)), [])
                    parts.append(Q.counted(*Q.permute(*packed, width), None, width))
                    if sum(map(len, parts)) > HELD:
                        parts[:] = [Q.merged(parts, width)]
                        if len(parts[0]) > HELD // 2:
                            yield emitted(lang, n, min(shard_bits, width), parts.pop())
            if sum(len(c) for v in held.values() for c in v) > 2 * HELD:  # many languages
                for (lang, n, sb), parts in held.items():
                    if parts:
                        yield emitted(lang, n, sb, Q.merged(parts, Q.half_width(n, bits)))
                held.clear()
        for (lang, n, sb), parts in held.items():
            if parts and any(map(len, parts)):
                yield emitted(lang, n, sb, Q.merged(parts, Q.half_width(n, bits)))

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """lang, shard_bits and the stream of ids (-1 for words without one, and between pieces) of each slice."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, shard_bits, stream, local, ids = (batch.column(j)[i] for j in range(5))
            local, ids = local.values.to_numpy(), ids.values.to_numpy()
            stream = np.frombuffer(stream.as_buffer(), np.int32)
            known = np.full(max(int(stream.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int64)
            known[local] = ids  # the last place stays -1, for ends
            yield lang.as_py(), shard_bits.as_py(), known[stream]


_PHRASE = "lang string, n int, w1 long, w2 long, w3 long, a long"


def _merge(bits: int, least: int):
    """Filters, sorted by shard, to the n-grams that occur often enough."""

    def frequent(lang: str, n: int, parts: list[Q.Counts]) -> Iterator[pa.RecordBatch]:
        width = Q.half_width(n, bits)
        c = Q.merged(parts, width)
        hits = np.flatnonzero(c.n >= least)
        ids = Q.unpack(*Q.restore(c.hi[hits], c.lo[hits], width), n, bits)
        for a in range(0, len(hits), 100_000):
            b = min(a + 100_000, len(hits))
            columns = [pa.array(x[a:b].astype(np.int64)) for x in ids] + [pa.nulls(b - a, pa.int64())] * (3 - n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (b - a)), pa.array([n] * (b - a), pa.int32()), *columns, pa.array(c.n[hits[a:b]])], ["lang", "n", "w1", "w2", "w3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                lang, n, shard, shard_bits, data = (batch.column(j)[i].as_py() for j in range(5))
                if key != (lang, n, shard):
                    if parts:
                        yield from frequent(key[0], key[1], parts)
                    key, parts = (lang, n, shard), []
                parts.append(Q.decode(data, shard, shard_bits))
                # Like a tree: the merged part grows before it is merged again.
                if len(parts) > 1 and sum(map(len, parts[1:])) > max(len(parts[0]), HELD // 4):
                    parts = [Q.merged(parts, Q.half_width(n, bits))]
        if parts:
            yield from frequent(key[0], key[1], parts)

    return run


def phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What occurs `least` times or more: n-grams of ids (lang, n, w1, w2, w3, a) and words (lang, word, f, id); and the words of each language (lang, total). All stored."""
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with Steps() as steps:
        made = steps.stored(rows.mapInArrow(_sliced, _SLICE), "slices")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        totals = stored(made.groupBy("lang").agg(F.sum(total).alias("total")), "totals")
        each = made.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("slice", "lang", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
        frequent = each.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        numbered = ranged_prefix_sums(frequent, ["lang"], [F.col("word")], {"nth": F.lit(1).cast("long")})
        words = stored(numbered.select("lang", "word", "f", (F.col("nth") - 1).alias("id")), "words")
        bits = max(1, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
        known = each.select("slice", "lang", "local", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
        ids = known.groupBy("slice", "lang").agg(F.collect_list(F.struct("local", "id")).alias("x"))
        shard_bits = F.length(F.bin(F.floor(F.col("total") / SHARD_WORDS))) - F.when(F.col("total") < SHARD_WORDS, 1).otherwise(0)
        dealt = few(totals.select(F.col("lang").alias("of"), F.least(F.lit(30), shard_bits).alias("shard_bits")))
        streams = made.select("slice", "lang", "stream").join(ids, ["slice", "lang"]).join(dealt, F.col("lang") == F.col("of"))
        filters = streams.select("lang", "shard_bits", "stream", F.col("x.local").alias("local"), F.col("x.id").alias("ids")).mapInArrow(_filters(bits), _FILTER)
        sorted_filters = filters.repartition("lang", "n", "shard").sortWithinPartitions("lang", "n", "shard")
        found = stored(sorted_filters.mapInArrow(_merge(bits, least), _PHRASE), "phrases")
    return found, words, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases.

    A phrase is dropped if a longer one that holds it has `share` percent of its occurrences or more.
    """
    found, words, totals = phrases(df, text_col, lang_col, least)
    word = lambda i: words.select("lang", F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))
    pairs = stored(found.where("n = 2").select("lang", "w1", "w2", "a").join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"]), "pairs")
    triples = found.where("n = 3").select("lang", "w1", "w2", "w3", "a")
    first = pairs.select("lang", "w1", "w2", "word1", "word2", "f1", F.col("a").alias("f12"))
    last = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    score = lambda l, r: F.expr(f"(cast(1000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) * cast(a as decimal(20, 0))) div (cast({l} as decimal(20, 0)) * cast({r} as decimal(20, 0)))")  # noqa: E731, E741
    scored3 = triples.join(first, ["lang", "w1", "w2"]).join(last, ["lang", "w2", "w3"]).withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3"))
    second = F.col("s2") < F.col("s1")
    three = scored3.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(second, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    holding = triples.select("lang", "w1", "w2", "a").unionAll(triples.select("lang", "w2", "w3", "a"))
    longest = holding.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    alone = pairs.join(longest, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    two = alone.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first ones of 64 parts of a language, then the first of these.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    parted = two.unionByName(three).select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(few(totals.select(F.col("lang").alias("of"), F.col("total").alias("n"))), F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
one AS (SELECT lang, unnest(w) AS w1 FROM lists),
f1 AS (SELECT lang, w1, count(*) AS f FROM one GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
f2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS x FROM lists) GROUP BY ALL HAVING a >= 10),
f3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM lists) GROUP BY ALL HAVING a >= 10),
longer AS (SELECT lang, w1, w2, max(a) AS a FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.a, x.f AS l, y.f AS r, 1000000::HUGEINT * f2.a * f2.a // (x.f::HUGEINT * y.f) AS score FROM f2
  JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN longer ON longer.lang = f2.lang AND longer.w1 = f2.w1 AND longer.w2 = f2.w2 WHERE longer.a IS NULL OR 100 * longer.a < 50 * f2.a),
cuts AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.a, x.f AS f1, p.a AS f12, q.a AS f23, y.f AS f3,
  1000000::HUGEINT * f3.a * f3.a // (x.f::HUGEINT * q.a) AS s1, 1000000::HUGEINT * f3.a * f3.a // (p.a::HUGEINT * y.f) AS s2 FROM f3
  JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
  JOIN f2 p ON p.lang = f3.lang AND p.w1 = f3.w1 AND p.w2 = f3.w2 JOIN f2 q ON q.lang = f3.lang AND q.w1 = f3.w2 AND q.w2 = f3.w3),
scored AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN f12 ELSE f1 END, CASE WHEN s2 < s1 THEN f3 ELSE f23 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
"""
