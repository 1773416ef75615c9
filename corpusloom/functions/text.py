"""Column functions for text and tokens (H1-H8, H12, H13) and for labels."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: The precomposed Hangul syllables; each is a first, a middle and perhaps a last letter.
_HANGUL, _FIRST, _MIDDLE, _LAST = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7


@cache
def _accents() -> tuple[str, str, str, str, str]:
    """Code points that become another one, or none, and what they become; those that become several, and these; the ranges of a character class about the latter.

    Accents are dropped code point by code point, as marks move only among marks, and these are dropped. Hangul is computed, so not listed.
    """
    plain = {c: _plain(c) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if unicodedata.decomposition(c) or unicodedata.combining(c)}
    one = sorted((c for c, p in plain.items() if p != c and len(p) <= 1), key=lambda c: not plain[c])  # what goes comes last
    many = sorted(c for c, p in plain.items() if len(p) > 1)
    ranges: list[list[int]] = []
    for code in map(ord, many):
        if ranges and code - ranges[-1][1] <= 64:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    about = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in (*ranges, _HANGUL))
    return "".join(one), "".join(plain[c] for c in one), "".join(many), "\0".join(plain[c] for c in many), about


def _taken_apart(piece: Column) -> Column:
    """A piece of text: what its only character becomes, if that is several ones."""
    _, _, many, parts, _ = _accents()
    code = F.ascii(piece) - _HANGUL[0]
    letter = lambda base, n, i: F.split(F.lit("\0".join(chr(base + j) if base + j != _LAST else "" for j in range(n))), "\0")[i.cast("int")]
    syllable = F.concat(letter(_FIRST, 19, F.floor(code / 588)), letter(_MIDDLE, 21, F.floor(code % 588 / 28)), letter(_LAST, 28, code % 28))
    place = F.position(piece, F.lit(many))
    known = F.split(F.lit(parts), "\0")[(place - 1).cast("int")]
    return F.when(F.length(piece) != 1, piece).when(code.between(0, _HANGUL[1] - _HANGUL[0]), syllable).when(place > 0, known).otherwise(piece)


def _without_accents(text: Column) -> Column:
    one, becomes, _, _, about = _accents()
    apart = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"[{about}]|[^{about}]+"), F.lit(0)), _taken_apart), "")
    whole = F.when(text.rlike(f"[{about}]"), apart).otherwise(text)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(whole, one, becomes))


def normalize_text(text: Column) -> Column:
    """H1: lower case, without accents (compatibility decomposition less combining marks). ASCII passes through."""
    # The lambda gives the lower-cased text a name, so that it is made once.
    return F.transform(F.array(F.lower(text)), _without_accents)[0]


def code_tokens(text: Column) -> Column:
    """H2: identifiers, hexadecimal and decimal numbers, by Unicode's word characters."""
    # Fixed value: what a token is.
    return F.regexp_extract_all(text, F.lit(r"(?U)\b[a-zA-Z_]\w*\b|\b0x[0-9a-fA-F]+\b|\b\d+\b"), F.lit(0))


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """H3: runs of low to high tokens, joined by spaces."""
    grams, all_sizes = tokens, []
    for n in range(1, high + 1):
        if n > 1:  # each run of n - 1 tokens but the last, and the token behind it
            count = F.greatest(F.lit(0), F.size(tokens) - n + 1)
            grams = F.zip_with(F.slice(grams, F.lit(1), count), F.slice(tokens, F.lit(n), count), lambda run, token: F.concat_ws(" ", run, token))
        if n >= low:
            all_sizes.append(grams)
    return F.concat(*all_sizes)


def _joined(parts: list[str]):
    return lambda z: F.concat(*(z[p] for p in parts))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """H4: substrings of low to high characters, after runs of two or more white-space characters became one space.

    The characters are taken apart once, so the work is linear in the text.
    """
    chars = F.split(F.regexp_replace(text, r"\s\s+", " "), "")
    empty = F.array().cast("array<string>")
    all_sizes = []
    for n in range(low, high + 1):
        # Each character with its n - 1 successors, by adding up shifted copies.
        shifted = [F.slice(chars, F.lit(j + 1), F.greatest(F.lit(0), F.size(chars) - n + 1)) for j in range(n)]
        parts = [f"c{j}" for j in range(n)]
        grams = F.transform(F.arrays_zip(*(s.alias(p) for s, p in zip(shifted, parts, strict=True))), _joined(parts))
        all_sizes.append(F.when(F.length(text) > 0, grams).otherwise(empty))
    return F.flatten(F.array(*all_sizes))


def sublinear_tf(tf: Column) -> Column:
    """H5: 1 + ln(tf)."""
    return F.lit(1.0) + F.ln(tf)


def approx_token_len(text: Column) -> Column:
    """H7: a quarter of the characters, 1 at least; null: 0."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def parse_categories(value: Column, strict: bool = False) -> Column:
    """H8: the categories of a bracketed, comma-separated string. strict: quotes inside, next to commas, stay."""
    ends = F.regexp_replace(value, r"""^[\[\]"' ]+|[\[\]"' ]+$""", "")
    trim = (lambda x: F.trim(x)) if strict else (lambda x: F.regexp_replace(x, r"""^[\s"']+|[\s"']+$""", ""))
    return F.filter(F.transform(F.split(ends, ","), trim), lambda x: x != "")


def parse_category_list(values: Column) -> Column:
    """H8 for real lists: the trimmed items."""
    return F.transform(values, lambda x: F.trim(x.cast("string")))


def clip_and_flag(n: Column, limit: int) -> tuple[Column, Column]:
    """The length, cut to a limit, and whether it was over it."""
    return F.least(n, F.lit(limit)), n > limit


def truncate_pad_mask(ids: Column, limit: int, to: Column, pad: int = 0, side: str = "right") -> tuple[Column, Column]:
    """The first `limit` ids, padded to a length on one side, and their mask of ones and zeros."""
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    kept = F.slice(ids, 1, limit)
    missing = F.greatest(F.lit(0), to - F.size(kept))
    padding, zeros = F.array_repeat(F.lit(pad), missing), F.array_repeat(F.lit(0), missing)
    ones = F.array_repeat(F.lit(1), F.size(kept))
    if side == "right":
        return F.concat(kept, padding), F.concat(ones, zeros)
    return F.concat(padding, kept), F.concat(zeros, ones)


def coerce_label(value: Column) -> Column:
    """A label as a whole number, from a number, a numeric string or a JSON object with one entry."""
    text = value.cast("string")
    inner = F.element_at(F.map_values(F.from_json(text, "map<string,string>")), 1)
    return F.coalesce(text.try_cast("int"), inner.try_cast("int"))


def label_name(label: Column) -> Column:
    """The display name of a label."""
    # The two names.
    return F.when(label == 0, "Secure (0)").when(label == 1, "Vulnerable (1)").otherwise(label.cast("string"))


def positive_probability(logit0: Column, logit1: Column) -> Column:
    """H9: the second class's probability by the soft maximum of two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(logit0 - logit1))


def experiment_id(name: Column, at: Column, settings: Column) -> Column:
    """name_YYYYMMDD-HHMMSS, followed by _key-value of each setting (a map)."""
    parts = F.array_join(F.transform(F.map_entries(settings), lambda e: F.concat(e["key"], F.lit("-"), e["value"])), "_")
    return F.concat_ws("_", name, F.date_format(at, "yyyyMMdd-HHmmss"), F.when(parts != "", parts))


def experiment_family(exp_id: Column) -> Column:
    """An experiment's id up to its time; without a time, its first two parts."""
    timed = F.regexp_extract(exp_id, r"^.*?_\d{8}-\d{6}", 0)
    return F.when(timed != "", timed).otherwise(F.substring_index(exp_id, "_", 2))
