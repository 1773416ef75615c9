"""Operators 11 to 13 against brute force, over nulls, repeated rows, ties, hot keys, long texts, clashing names and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import collocations, line_dedup, merkle
from corpusloom.llm import quotient as Q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """The rows of documents, in several partitions, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for c in ("id", "g", "pos", "leaf", "version", "position", "slice", "words", "n", "of", "h1", "key", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11: the manifest


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def manifest(rows):
    leaf = lambda r, text: h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for n, g in enumerate(langs):
        for i, (_, _, mine, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, n)
            cur = mine
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                cur = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for before, after in path:
                cur = h([*before, cur, *after])
            out.append((r[0], mine, trees[g][-1][0], top[-1][0], h(x for b, a in path for x in b + a), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def documents(rng, n):
    rows = [(i, rng.choice(["Some Text", "lower", "ÄÖ Éa", "", None, "x" * 5000]) and f"Text {rng.randint(0, 3)}", rng.choice(["en"] * 8 + ["de", "", None]), rng.choice(["a", None]), rng.choice([1, None])) for i in range(n)]
    rows += [(None, "No Id", "en", None, None), (None, "No Id", "en", None, None), (None, None, None, None, None), (3, "same id", "en", "b", 2), (n, "Z" * 70_000, "en", "b", 70_000)]
    return rows + [(n + 1 + i, "One Each", f"lang{i}", "s", 1) for i in range(20)]


@pytest.mark.parametrize("rise, n", [(4, 600), (1, 90), (2, 200)])
def test_manifest(spark, rise, n):
    rows = documents(random.Random(rise), n)
    made = merkle.Manifest(frame(spark, rows), rise=rise)
    got = sorted(map(tuple, made.proofs().collect()), key=str)
    assert got == manifest(rows)
    assert len(made.trees.tiers) == {4: 1, 1: 3, 2: 2}[rise] and 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_little(spark):
    assert merkle.digests(frame(spark, []), "doc_id").collect() == []
    one = [(5, "A", "en", "s", 1)]
    assert sorted(map(tuple, merkle.digests(frame(spark, one)).collect())) == manifest(one)


def test_van_emde_boas_order():
    for n_levels in range(1, 6):
        places = np.concatenate([merkle.place(n_levels, d) for d in range(n_levels)])
        assert sorted(places) == list(range((8**n_levels - 1) // 7))  # each place is used once
    # A tree of four levels: the upper two come first, then each lower two in one piece.
    assert merkle.place(4, 0)[0] == 0 and merkle.place(4, 1).tolist() == list(range(1, 9))
    for i in (0, 1, 63):
        below = [merkle.place(4, 2)[i], *merkle.place(4, 3)[8 * i : 8 * i + 8]]
        assert below == list(range(9 + 9 * i, 18 + 9 * i))
    leaves = [h([str(i)]) for i in range(77)]
    nodes, root = merkle.layout(leaves, 3)
    block = merkle.Block(nodes, 77, 3, [])
    assert root == levels(leaves)[-1][0]
    for i in range(77):
        assert block.leaf(i) == leaves[i] and block.path(i) == [("".join(b), "".join(a)) for b, a in siblings(levels(leaves), i)]
        assert merkle.folded(leaves[i], block.path(i)) == root


# 12: collocations


def phrases(rows, least, top, share):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = defaultdict(list)
    for p, a in found.items():
        longer = [q for q in found if q[0] == p[0] and len(q) > len(p) and p[1:] in {q[1:3], q[2:4]}]
        if any(100 * found[q] >= share * a for q in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[p[:k]] * f[(p[0], *p[k:])]), k) for k in range(2, len(p)))
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    return sorted((g, i, p.decode(), -a, l, r, total[g], -s) for g, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def prose(rng, n):
    vocabulary = ["New", "york", "city", "the", "of", "über", "日本", "a", "b\x0b", "c;", "x." "y", "\tq", "hot", "hot"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(n)]
    rows = [(i, t, rng.choice(["en", "en", "en", "de", None, "und"]), "s", 1) for i, t in enumerate(texts)]
    return rows + [(None, None, "en", None, None), (1, "", None, None, None), (n, "very long text " * 4000, "en", "s", 1), (n, "very long text " * 4000, "en", "s", 1)]


@pytest.mark.parametrize("least, top, share", [(10, 2000, 50), (3, 7, 90), (1, 50, 101)])
def test_collocations(spark, least, top, share):
    rows = prose(random.Random(least), 150)
    got = collocations.collocations(frame(spark, rows), least=least, top=top, share=share)
    assert sorted(map(tuple, got.collect())) == phrases(rows, least, top, share)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, "a b c", "en", "s", 1)])).collect() == []


def test_scores_past_64_bits(spark):
    # The products of these counts need 30 digits.
    big = 10**12
    df = spark.createDataFrame([(big - 1, big, big + 7)], "a long, l long, r long")
    score = "(cast(1000000 as decimal(38, 0)) * cast(a as decimal(20, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))"
    assert df.selectExpr(score).first()[0] == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


@pytest.mark.parametrize("bits", [1, 2, 7, 15, 21, 22, 33, 42])
@pytest.mark.parametrize("n", [2, 3])
def test_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, min(1 << bits, 30), 2000) + ((1 << bits) - 30 if bits > 6 and j % 2 else 0) for j in range(n)]
    ids = [np.append(x, np.full(700, x[0])) for x in ids]  # one n-gram with a counter of more than a byte
    width = Q.half_width(n, bits)
    counts = Q.counted(*Q.permute(*Q.pack(ids, bits), width), None, width)
    want = Counter(zip(*(x.tolist() for x in ids), strict=True))
    for shard_bits in (0, min(width, 3)):
        parts = [Q.decode(data, shard, shard_bits) for shard, data in Q.shards(counts, width, shard_bits)]
        twice = Q.merged(parts + parts, width)
        back = Q.unpack(*Q.restore(twice.hi, twice.lo, width), n, bits)
        assert {tuple(int(x[i]) for x in back): int(twice.n[i]) for i in range(len(twice))} == {k: 2 * v for k, v in want.items()}


def test_filters_are_compact():
    rng = np.random.default_rng(5)
    n, width = 200_000, Q.half_width(3, 15)
    c = Q.counted(*Q.permute(*Q.pack([rng.integers(0, 1 << 15, n) for _ in range(3)], 15), width), None, width)
    assert len(Q.shards(c, width, 0)[0][1]) < 6 * n  # of 16 bytes for a key and a counter


# 13: lines


def deduplicated(rows, least=20, documents=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [n for n, x in enumerate(lines) if keeper.get(key(x), i) == i]
        starts = [n for n in kept if n - 1 not in kept]
        runs = ",".join(f"{s}+{next(m for m in range(s, len(lines) + 1) if m not in kept) - s}" for s in starts)
        out.append((i, len(lines), len(lines) - len(kept), h(["\n".join(lines[n] for n in kept)]), runs))
    return sorted(out, key=str)


@pytest.mark.parametrize("quantiles", [1000, 6])
def test_lines(spark, monkeypatch, quantiles):
    monkeypatch.setattr(line_dedup, "QUANTILES", quantiles)
    monkeypatch.setattr(line_dedup, "_PARTITION_CUTS", 1)
    rng = random.Random(3)
    shared = [f"This line is SHARED by several documents {i} " for i in range(25)]
    hot = "  A licence line which nearly all documents hold \t"
    rows = []
    for i in range(120):
        lines = rng.choices([*shared, "short", "", " \r", f"own line of document number {i}", "Ärger mit ÜMLAUTEN in dieser Zeile"], k=rng.randint(0, 12))
        rows.append((i, "\n".join([*lines, *([hot, hot.upper()] if i % 10 else [])]), "en", "s", 1))
    rows += [(None, hot + "\n" + shared[0], "en", "s", 1), (None, shared[0], "en", "s", 1), (None, None, None, None, None), (500, "", "en", "s", 0), rows[7], (9, hot.lower(), "en", "s", 1)]
    rows.append((600, "\n".join(f"{hot}{i % 50}" for i in range(3000)), "en", "s", 1))
    got = [tuple(r) for r in line_dedup.digests(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == deduplicated(rows)


def test_lines_of_nothing(spark):
    assert line_dedup.digests(frame(spark, [])).collect() == []
    rows = [(i, "a line of more than twenty code points", "en", "s", 1) for i in range(2)]
    assert sorted(map(tuple, line_dedup.digests(frame(spark, rows)).collect()), key=str) == deduplicated(rows)


def test_lines_without_python(spark):
    plan = line_dedup.digests(frame(spark, [(1, "x", "en", "s", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
