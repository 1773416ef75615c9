"""Operator 1: token counts, with overlap resynchronisation for huge documents.

A long text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced
at a *stable* boundary: a white-space character that follows a character which is none. Both
chunks must have a token boundary there, and the tokens from there to the last such place of the
overlap, one at least, must agree in both. If the overlap holds no two such places, or the chunks disagree, the
overlap is doubled, and the chunk with it. Texts for sentencepiece models are encoded whole: their normaliser may work
across white space, and long texts then need memory in proportion.

Null text: empty (0 tokens). Null id: kept. Repeated rows: one result each. Empty table: none.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.batches import map_columns, texts

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_chunks", T.LongType()),
    ]
)
MEMO_WORDS = 800_000
"""Words whose counts a worker remembers; beyond it, only those of the texts at hand stay."""

Encoded = list[tuple[int, int, int]]
_NOT_WHITE = "\x1c\x1d\x1e\x1f"  # white space for Python alone


def stable(text: str, at: int) -> bool:
    """Whether a token boundary at this place is proven: white space after a character that is none."""
    return 0 < at < len(text) and text[at].isspace() and text[at] not in _NOT_WHITE and not text[at - 1].isspace()


def splice(text: str, encode: Callable[[str], Encoded], chunk: int, overlap: int) -> tuple[list[int], int]:
    """The ids of a text from overlapping chunks, and the number of chunks.

    encode gives (id, start, end) in code points of what it gets. chunk and overlap are in code points.
    """
    ids: list[int] = []
    begin, done, n, size, lap = 0, 0, 1, chunk, overlap
    left = _shifted(encode(text[:size]), 0)
    while True:
        end = min(len(text), begin + size)
        if end == len(text):
            ids += [t for t, s, _ in left if s >= done]
            return ids, n
        start = max(begin + 1, end - lap)
        right = _shifted(encode(text[start : min(len(text), start + size)]), start)
        at = _agreed(text, left, right, start, end)
        if at is None:
            # No proven place: a wider overlap, and a larger chunk to hold it.
            lap *= 2
            if lap >= size:
                size *= 2
                left = _shifted(encode(text[begin : begin + size]), begin)
            continue
        ids += [t for t, s, _ in left if done <= s < at]
        begin, done, left, lap, n = start, at, right, overlap, n + 1


def _shifted(tokens: Encoded, by: int) -> Encoded:
    return [(t, s + by, e + by) for t, s, e in tokens]


def _agreed(text: str, left: Encoded, right: Encoded, start: int, end: int) -> int | None:
    """The first stable place in the overlap from which both chunks have the same tokens, up to the last stable place."""
    places = [i for i in range(start + 1, end) if stable(text, i)]
    if len(places) < 2:
        return None
    first, last = places[0], places[-1]
    crossed = any(s < first < e for _, s, e in left) or any(s < first < e for _, s, e in right)
    proof = [x for x in left if first <= x[1] < last]
    return first if proof and proof == [x for x in right if first <= x[1] < last] and not crossed else None


def separable(spec: dict) -> bool:
    """Whether a tokenizer file drops white space before its merges, so that words between white space are encoded alone."""
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    cut = parts[0] if parts else {}
    added = [t for t in spec.get("added_tokens", []) if re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]]
    return cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") is True and "[^\\s" in cut["pattern"].get("Regex", "") and not added


class Counter:
    """Counts the tokens of texts with the library of a tokenizer file (.json: tokenizers, .model: sentencepiece)."""

    def __init__(self, path: str, chunk: int, overlap: int):
        self.chunk, self.overlap, self.memo = chunk, overlap, {"": 0}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # Its normaliser may work across white space: such texts are always encoded whole.
            self.words, self.encode, self.many = False, None, lambda x: [len(i) for i in model.encode(x, num_threads=1)]
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.words = separable(json.load(f))
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.many = lambda x: [len(e) for e in tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        # Offsets cost time; only huge texts need them.
        def encode(text: str) -> Encoded:
            e = tokenizer.encode(text, add_special_tokens=False)
            return [(t, s, z) for t, (s, z) in zip(e.ids, e.offsets, strict=True)]

        self.encode = encode

    def count(self, rows: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and chunks of each text."""
        n, chunks = [0] * len(rows), [1] * len(rows)
        short = []
        for i, text in enumerate(rows):
            if self.encode and len(text) > self.chunk:
                ids, chunks[i] = splice(text, self.encode, self.chunk, self.overlap)
                n[i] = len(ids)
            else:
                short.append(i)
        if not self.words:
            for i, k in zip(short, self.many([rows[i] for i in short]), strict=True):
                n[i] = k
            return n, chunks
        # White space is dropped and every edge of it is stable, so a text's count is the sum over its words.
        split = [rows[i].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i in short]
        used = {w for words in split for w in words}
        if len(self.memo) > MEMO_WORDS:
            self.memo = {w: self.memo[w] for w in used & self.memo.keys()} | {"": 0}
        new = list(used - self.memo.keys())
        for i in range(0, len(new), 500):
            self._learn(new[i : i + 500])
        get = self.memo.__getitem__
        for i, words in zip(short, split, strict=True):
            n[i] = sum(map(get, words))
        return n, chunks


    def _learn(self, words: list[str]) -> None:
        """Encodes words side by side, parted by spaces; a token belongs to the word in which it starts."""
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.array([s for _, s, _ in self.encode(" ".join(words))], np.int64)
        n = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(words))
        self.memo.update(zip(words, n.tolist(), strict=True))


_counters: dict[tuple, Counter] = {}


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and n_chunks of each row, without added special tokens.

    tokenizer: path of the vocabulary file on every worker. Texts of over chunk code points are
    spliced from overlapping chunks.
    """

    def count(columns):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (tokenizer, chunk, overlap)
        if key not in _counters:
            _counters[key] = Counter(*key)
        rows = columns[1].to_pylist()
        n, chunks = _counters[key].count(rows)
        yield {"id": columns[0], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in rows], "n_tokens": n, "n_chunks": chunks}

    return map_columns(texts(df, id_col, text_col), SCHEMA, count)
