"""Operator 5: mixing sources to target weights by iterative proportional fitting.

Each document is in one cell of source, language and topic, with its tokens (words) as weight. The
cells' sampling probabilities start equal and are raked: for each margin in turn, every category's probabilities
are scaled to the category's target share of the token budget, and held at 1 at most; sweeps go on until they move
by less than `tolerance`. A document is then sampled if a hash of its id, as a number in [0, 1), is below
its cell's probability: the same choice at any partitioning.

Targets are shares of a category by name, or an exponent: a share grows as the category's share of all tokens to
this power (1 keeps the mix, 0 makes it even). A category that named targets don't list keeps its own share; the others divide the rest.
A share by exponent that exceeds all tokens of its category is all of them, and the other categories fill what is left of the budget. If the
margins still can't be met together, shares by exponent are eased towards the categories' own ones in the steps of EASE, as little as
does; `eased` tells how far. A named share is demanded as it stands.

A topic is a column, or else one of `topics` groups of words of five or more bytes, by their hash: the one in
which the document exceeds the whole corpus the most.

Cells are summed where they are; up to Mix.max_cells of them are raked on the driver, more of them as a table, by the same steps.
The sweeps end unconverged if a named target can't be met (a category would need more than all its tokens): its
probabilities are then 1, `converged` is false, and margins() tells how far each category is from its target.

Null source, language or topic: a category of its own. Null text: empty, of 0 tokens. A cell without tokens has
probability 0. Null id: the hash of the text decides. Rows of equal id: the same hash. Repeated rows: one result
each. Empty table: none. measure() reads only the columns named; sample() keeps all columns and adds none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import Words, map_columns, slices
from corpusloom.llm.shared import stored

MARGINS = ("source", "lang", "topic")
EASE = (0.0, 0.125, 0.25, 0.5, 1.0)
LEAST_BYTES = 5

MEASURED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("u", T.DoubleType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("groups", T.ArrayType(T.LongType())),
    ]
)


@dataclass(frozen=True)
class Mix:
    """What to mix for.

    targets: per margin, shares by category, or an exponent; fraction: the token budget as a part of all tokens; max_cells: how
    many cells (source x language x topic, not documents) the driver may hold.
    """

    targets: dict[str, dict[str, float] | float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.0})
    fraction: float = 0.5
    topics: int = 8
    topic_col: str | None = None
    seed: int = 42
    tolerance: float = 1e-9
    sweeps: int = 200
    max_cells: int = 100_000


def _groups(column: pa.Array, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its longer words by topic group (texts x topics)."""
    words = Words(column)
    long = (words.end - words.start) >= LEAST_BYTES
    cell = words.doc[long] * topics + (words.hash[long] % np.uint64(topics)).astype(np.int64)
    return words.count, np.bincount(cell, minlength=len(column) * topics).reshape(len(column), topics)


def _uniform(id_col: Column, text: Column, seed: int) -> Column:
    h = F.when(id_col.isNotNull(), F.xxhash64(id_col, F.lit(seed))).otherwise(F.xxhash64(text, F.lit(seed)))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def _topic(groups: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """The group of the largest excess over the corpus (the first of equal ones), -1 for a text without longer words."""
    share = groups / np.maximum(groups.sum(axis=1, keepdims=True), 1)
    best = np.argmax(share / np.maximum(corpus, 1e-300), axis=1)
    return np.where(groups.sum(axis=1) > 0, best, -1)


def measure(df: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> tuple[DataFrame, np.ndarray]:
    """id, source, lang, topic, n_tokens and u of each row, as a stored table, and the corpus's share of each topic group."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = F.col(mix.topic_col).cast("string") if mix.topic_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), _uniform(F.col(id_col), text, mix.seed).alias("u"), topic.alias("topic"))

    def run(columns):
        n, groups = _groups(columns[1], mix.topics)
        yield {"id": columns[0], "source": columns[2], "lang": columns[3], "u": columns[4], "n_tokens": n, "groups": list(groups), "topic": columns[5]}

    found = stored(map_columns(rows, T.StructType([*MEASURED, T.StructField("topic", T.StringType())]), run), "measured")
    sums = found.agg(*(F.sum(F.col("groups")[i]).alias(f"g{i}") for i in range(mix.topics))).first()
    totals = np.array([x or 0 for x in sums], float)
    corpus = totals / max(totals.sum(), 1.0)
    if not mix.topic_col:
        found = found.withColumn("topic", _topic_column(corpus))
    return found.drop("groups"), corpus


def _topic_column(corpus: np.ndarray) -> Column:
    """_topic() of the column groups."""
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda a, x: a + x)
    lifts = F.array(*(F.col("groups")[i] / F.greatest(total, F.lit(1)) / float(max(c, 1e-300)) for i, c in enumerate(corpus.tolist())))
    return F.when(total > 0, (F.array_position(lifts, F.array_max(lifts)) - 1).cast("string")).otherwise(F.lit("-1"))


def cells(measured: DataFrame) -> DataFrame:
    """source, lang, topic and the tokens of each cell."""
    return measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))


def filled(weight: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Shares in proportion to weights that add up to 1, each held at its cap, as far as the caps let them."""
    held = np.zeros(len(weight), bool)
    while True:
        left = weight[~held].sum()
        scale = (1.0 - cap[held].sum()) / left if left > 0 else 0.0
        over = ~held & (weight * scale > cap)
        if not over.any():
            return np.where(held, cap, weight * scale)
        held |= over


def shares(names: list, tokens: np.ndarray, target: dict[str, float] | float, fraction: float = 1.0, ease: float = 0.0) -> np.ndarray:
    """Target shares of the categories of a margin, in the order of names, of a budget that is a fraction of all tokens. ease: how far shares by exponent are moved to the own ones."""
    own = tokens / max(tokens.sum(), 1)
    if not isinstance(target, dict):
        return (1 - ease) * filled(np.where(own > 0, own, 0.0) ** target * (own > 0), own / fraction) + ease * own
    named = np.array([n in target for n in names], bool)
    want = np.where(named, [target.get(n, 0.0) for n in names], own)
    rest = 1.0 - want[~named].sum()
    if want[named].sum() > 0:
        want[named] *= rest / want[named].sum()
    return want / max(want.sum(), 1e-300)


def rake(table: pd.DataFrame, mix: Mix, ease: float = 0.0) -> tuple[np.ndarray, bool]:
    """Sampling probability of each cell of a small table (source, lang, topic, tokens), and whether all margins are met."""
    tokens = table["tokens"].to_numpy(float)
    p = np.where(tokens > 0, min(1.0, mix.fraction), 0.0)
    margins = []
    for m in MARGINS:
        names, code = np.unique(table[m].fillna("\0").to_numpy(str), return_inverse=True)
        sums = np.bincount(code, tokens, len(names))
        margins.append((code, len(names), mix.fraction * tokens.sum() * shares([None if x == "\0" else x for x in names], sums, mix.targets[m], mix.fraction, ease)))
    for _ in range(mix.sweeps):
        before = p
        for code, n, want in margins:
            have = np.bincount(code, tokens * p, n)
            p = np.minimum(1.0, p * np.divide(want, have, out=np.zeros(n), where=have > 0)[code])
        if np.abs(p - before).max(initial=0) < mix.tolerance:
            break
    met = all(np.allclose(np.bincount(code, tokens * p, n), want, rtol=1e-6, atol=1e-6) for code, n, want in margins)
    return p, met


def _filled(own: DataFrame) -> DataFrame:
    """filled() for a table with weight and cap. A category is held if cap / weight is below the scale of the others, which grows as more are held."""
    own = stored(own, "shares")
    scale, before = 0.0, None
    while scale != before:
        held = F.col("cap") < F.col("weight") * scale
        sums = own.agg(F.sum(F.when(held, F.col("cap"))), F.sum(F.when(~held, F.col("weight")))).first()
        before, scale = scale, (1.0 - (sums[0] or 0.0)) / sums[1] if sums[1] else scale
    return own.withColumn("want", F.least("cap", F.col("weight") * scale))


def rake_table(table: DataFrame, mix: Mix, ease: float = 0.0) -> tuple[DataFrame, bool]:
    """rake() for cells of any number, as a table with p; each sweep is three aggregations over the cells."""
    total = table.agg(F.sum("tokens")).first()[0] or 0
    p = stored(table.withColumn("p", F.when(F.col("tokens") > 0, F.lit(min(1.0, mix.fraction))).otherwise(F.lit(0.0))), "cells")
    wants = {}
    for m in MARGINS:
        own = table.groupBy(m).agg(F.sum("tokens").alias("have")).withColumn("own", F.col("have") / float(max(total, 1)))
        target = mix.targets[m]
        if isinstance(target, dict):
            given = table.sparkSession.createDataFrame(list(target.items()) or [("", 0.0)], f"given string, share double")
            own = own.join(given, F.col(m) == F.col("given"), "left")
            sums = own.agg(F.sum(F.when(F.col("given").isNull(), F.col("own"))), F.sum("share")).first()
            scale = (1.0 - (sums[0] or 0.0)) / sums[1] if sums[1] else 0.0
            own = own.withColumn("want", F.coalesce(F.col("share") * scale, F.col("own")))
        else:
            own = _filled(own.where("own > 0").withColumn("weight", F.pow("own", F.lit(float(target)))).withColumn("cap", F.col("own") / mix.fraction))
            own = own.withColumn("want", (1 - ease) * F.col("want") + ease * F.col("own"))
        norm = own.agg(F.sum("want")).first()[0] or 1.0
        wants[m] = stored(own.select(F.col(m).alias("of"), (F.col("want") / norm * mix.fraction * float(total)).alias("want")), "targets")
    for _ in range(mix.sweeps):
        after = p.withColumn("before", F.col("p"))
        for m in MARGINS:
            have = after.groupBy(F.col(m).alias("h")).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
            ratio = have.join(wants[m], F.col("h").eqNullSafe(F.col("of"))).select("h", F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(F.lit(0.0)).alias("ratio"))
            after = after.join(ratio, F.col(m).eqNullSafe(F.col("h")), "left").withColumn("p", F.least(F.lit(1.0), F.col("p") * F.coalesce("ratio", F.lit(1.0)))).drop("h", "ratio")
        after = stored(after, "cells")
        moved = after.agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0] or 0.0
        p = after.drop("before")
        if moved < mix.tolerance:
            break
    met = True
    for m in MARGINS:
        have = p.groupBy(F.col(m).alias("h")).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
        far = have.join(wants[m], F.col("h").eqNullSafe(F.col("of"))).where(F.abs(F.col("have") - F.col("want")) > 1e-6 + 1e-6 * F.col("want"))
        met = met and far.isEmpty()
    return p, met


def _eased(fit, mix: Mix) -> tuple:
    """p, whether all margins are met, and the least step of EASE with which they are (the first one, if none does)."""
    first = None
    for ease in EASE:
        p, met = fit(ease)
        if met:
            return p, met, ease
        first = first or (p, met, ease)
        if all(isinstance(t, dict) or t == 1 for t in mix.targets.values()):  # nothing to ease
            break
    return first


def probabilities(measured: DataFrame, mix: Mix) -> DataFrame:
    """source, lang, topic, p, converged and eased of each cell; marked for broadcast if there are max_cells at most."""
    table = stored(cells(measured), "cells")
    if table.limit(mix.max_cells + 1).count() > mix.max_cells:
        p, met, ease = _eased(lambda ease: rake_table(table, mix, ease), mix)
        return p.select(*MARGINS, "p", F.lit(met).alias("converged"), F.lit(ease).alias("eased"))
    small = table.orderBy(*MARGINS).toPandas()
    each, met, ease = _eased(lambda ease: rake(small, mix, ease), mix)
    rows = [(*(None if pd.isna(x) else x for x in row), float(p), met, ease) for row, p in zip(small[list(MARGINS)].itertuples(index=False), each, strict=True)]
    return F.broadcast(table.sparkSession.createDataFrame(rows, "source string, lang string, topic string, p double, converged boolean, eased double"))


def _with_p(rows: DataFrame, p: DataFrame, source: str, lang: str, topic: str) -> DataFrame:
    named = p.select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("p").alias("__p"), F.col("converged").alias("__converged"), F.col("eased").alias("__eased"))
    on = [rows[c].eqNullSafe(named[f"__{m}"]) for m, c in zip(MARGINS, (source, lang, topic), strict=True)]
    return rows.join(named, on[0] & on[1] & on[2], "left").drop(*(f"__{m}" for m in MARGINS))


def calibrated(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """id, source, lang, topic, n_tokens, probability, sampled, converged and eased (both the same in all rows) of each row."""
    measured, _ = measure(df, mix, id_col, text_col, source_col, lang_col)
    out = _with_p(measured, probabilities(measured, mix), *MARGINS)
    p = F.coalesce("__p", F.lit(0.0))
    return out.select("id", *MARGINS, "n_tokens", p.alias("probability"), (F.col("u") < p).alias("sampled"), F.coalesce("__converged", F.lit(True)).alias("converged"), F.coalesce("__eased", F.lit(0.0)).alias("eased"))


def margins(calibrated: DataFrame, mix: Mix) -> DataFrame:
    """margin, category, target (share of the token budget; null for an exponent), expected (share by probabilities) and sampled (share of the sample) of what calibrated() gave."""
    tokens, out = F.col("n_tokens"), []
    for m in MARGINS:
        each = calibrated.groupBy(F.col(m).alias("category")).agg(F.sum(tokens * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), tokens).otherwise(0)).alias("s"))
        all_ = each.agg(F.sum("e").alias("__e"), F.sum("s").alias("__s"))
        target = mix.targets[m]
        named = F.lit(None).cast("double")
        for name, share in target.items() if isinstance(target, dict) else ():
            named = F.when(F.col("category") == name, F.lit(float(share))).otherwise(named)
        ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
        out.append(each.crossJoin(all_).select(F.lit(m).alias("margin"), "category", named.alias("target"), ratio("e", "__e").alias("expected"), ratio("s", "__s").alias("sampled")))  # a row
    return out[0].unionByName(out[1]).unionByName(out[2])


def sample(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows, with all their columns. Texts are not shuffled: the second pass finds each row's cell anew."""
    measured, corpus = measure(df, mix, id_col, text_col, source_col, lang_col)
    p = probabilities(measured, mix)

    @F.pandas_udf("string")
    def topic(column: pd.Series) -> pd.Series:
        rows = pa.RecordBatch.from_arrays([pa.array(column, pa.string())], names=["text"])
        found = [_topic(_groups(part.column(0), mix.topics)[1], corpus) for part in slices(rows, 0)]
        return pd.Series(np.concatenate(found).astype(str) if found else [], dtype=object)

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.col(mix.topic_col).cast("string") if mix.topic_col else topic(text)
    # The row as one value, so that no column name of it can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.select(row, F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), found.alias("topic"), _uniform(F.col(id_col), text, mix.seed).alias("u"))
    return _with_p(rows, p, *MARGINS).where("u < __p").select("row.*")
