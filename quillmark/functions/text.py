"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.constants import KIND_SHORT, STOP_WORDS


def estimate_tokens(text: Column) -> Column:
    """A token for every four characters of a word run, each other mark and each line feed; at least 1, 0 for ''."""
    n = F.regexp_count(text, F.lit(r"[\p{IsAlphabetic}\p{N}_]{1,4}|[^\p{IsAlphabetic}\p{N}_\s]|\n"))
    return F.when(text == "", 0).otherwise(F.greatest(n, F.lit(1)))


def has_word(text: Column, word: str) -> Column:
    """word, not behind an ASCII letter or digit and not before a lower-case one or a digit."""
    return text.rlike(r"(?<![A-Za-z0-9])" + re.sub(r"(\W)", r"\\\1", word) + r"(?![a-z0-9])")


def token_set(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 for two empty ones."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def divergence(a: Column, b: Column) -> Column:
    """Share of places where two texts differ but for ASCII case, with their difference in length."""
    ascii_lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = F.least(F.char_length(a), F.char_length(b))
    chars = lambda c: F.slice(F.split(ascii_lower(c), ""), 1, F.greatest(n, F.lit(1)))
    differ = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise((F.when(n == 0, 0).otherwise(differ) + F.abs(F.char_length(a) - F.char_length(b))) / longest)


def pseudo_days(ts: Column) -> Column:
    """Days on a calendar of 365-day years and 31-day months, as ages are compared on."""
    return F.year(ts) * 365 + F.month(ts) * 31 + F.dayofmonth(ts)


def format_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024 * 1024, F.format_string("%.1fKB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1fMB", F.bround(n / (1024 * 1024), 1)))


def line_count(text: Column) -> Column:
    """A line feed at the end adds no line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.endswith(text, F.lit("\n")).cast("int"))


def truncate_sig(text: Column, n: int) -> Column:
    """At most n bytes in UTF-8 (whole characters), cut before the last ',' or ')' of those, and '...'."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), "\uFFFD+$", "")
    cut = F.when(head.rlike("[,)]"), F.regexp_extract(head, r"(?s)^(.*)[,)]", 1)).otherwise(head)
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)


def keyword_score(text: Column, query: str, weight: float = 0.2) -> Column:
    low, words = F.lower(text), [w for w in query.lower().split()]
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.when(F.contains(low, F.lit(query.lower())), weight).otherwise(F.lit(weight) * hits / max(1, len(words)))


def short_kind(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in KIND_SHORT.items() for x in kv))
    return F.coalesce(F.try_element_at(names, F.lower(kind)), kind)


def normalize_path(path: Column) -> Column:
    """'.' and '..' resolved by name alone; '..' at the root is dropped."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def fnv1a64_hex(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, by 32-bit halves so that no product leaves a long."""
    raw = F.encode(text, "UTF-8")
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    octets = F.when(F.octet_length(raw) == 0, F.array().cast("array<bigint>")).otherwise(octets)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    half = F.lit(2**32).cast("long")

    def step(s, b):
        t = s["lo"].bitwiseXOR(b)
        return F.struct(F.pmod(s["hi"] * 435 + F.shiftleft(t.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8) + F.shiftright(t * 435, 32), half).alias("hi"), F.pmod(t * 435, half).alias("lo"))

    return F.aggregate(octets, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))
