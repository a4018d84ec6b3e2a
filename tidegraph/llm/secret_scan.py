"""Secret scanning: known patterns, plus strings that a primed compressor can't explain.

Known kinds (`assign`, `access`, `hex`) are regular expressions. The kind `novel` comes from
dictionary-primed compression: a candidate is a long run of credential characters shortly after a
sensitive word. zstandard, primed with a dictionary of identifiers, compresses the surrounding text
without and with the candidate; the difference is the candidate's marginal size. Identifiers, paths
and what the surroundings repeat cost few bytes. A random string costs what its own alphabet and
length make it hold, n * log2(size) bits, and some more, as the compressor doesn't know that alphabet;
a candidate that costs LEAST_SHARE of that is reported.
Other copies of a candidate, before or after it, are left out of the surroundings, and every copy of
a reported string is reported.

The dictionary has two parts: the names of Python's own modules, and, if `learn_identifiers` is used,
words that several documents have.

Rows are independent: one pass over the text, no shuffle, and memory is that of one batch; the time
is in proportion to the text. Null and empty texts have no spans; texts are scanned whole. Rows that
repeat are scanned each, an empty table gives an empty one. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import builtins
import keyword
import math
import re
import string
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, map_arrow, schema_with, sliced, texts_of, with_columns

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of any length, kept from 32 on
KINDS = ["assign", "access", "hex", "novel"]

SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|api_?key|private|credential|bearer|auth|"
                       r"access|signature|session|cookie|cert|encrypt|license_?key|webhook|salt|nonce|dsn", re.I | re.A)
LEAST = 16           # characters of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
REACH = 64           # characters after a sensitive word in which a candidate may begin
AROUND = 256         # characters of surroundings on either side
LETTERS = 2_000      # of text that gives the usual frequencies of characters
LEAST_SHARE = 0.95   # of the bits that a random string of the candidate's alphabet and length holds
MOST_WORDS = 5_000   # that a dictionary learns
# forms that may look random and are no secrets: UUIDs, and paths or names of three or more plain parts
HARMLESS = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
                      r"|/?(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4})(?:[/_-](?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4})){2,}")


@cache
def standard_identifiers() -> tuple[str, ...]:
    """Names that code uses: of Python's modules, built-ins and keywords, and of what a few of its
    modules about text, files, networks and logging define; and runs of characters in order."""
    import argparse
    import configparser
    import email.message
    import http.client
    import json
    import logging
    import os
    import socket
    import ssl
    import urllib.request
    names = {*sys.stdlib_module_names, *keyword.kwlist, *dir(builtins), *vars(ssl.SSLContext)}
    for module in (os, json, logging, argparse, configparser, email.message, http.client, socket, urllib.request):
        names |= {n for n in dir(module) if not n.startswith("__")}
    return (*sorted(names), string.digits * 2, string.ascii_lowercase, string.ascii_uppercase, "/usr/share/lib/local/bin/etc/var/home/")


def learn_identifiers(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> tuple[str, ...]:
    """The `most` words of letters and underscores that most of all different texts have, two at least.

    Equal texts count once: each of n copies counts 1/n, so that no text is moved for it."""
    texts = docs.select(column(text_col).alias("text")).filter(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    copies = texts.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]{4,24})"), F.lit(1)))
    words = texts.join(copies, "h", "left").select(F.explode(found).alias("w"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    counted = words.groupBy("w").agg(F.round(F.sum("part")).cast("bigint").alias("n")).filter("n > 1")
    return tuple(r.w for r in counted.orderBy(F.desc("n"), "w").limit(most).collect())


def _primed(identifiers: tuple[str, ...]) -> zstandard.ZstdCompressor:
    """zstandard finds what stands last in a dictionary most cheaply."""
    spellings = [*identifiers[::-1], *(w.upper() + "_" for w in standard_identifiers()[:400])]
    primed = zstandard.ZstdCompressionDict(" ".join(spellings).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)


@cache
def _letters() -> bytes:
    """Names read backwards: the dictionary can't stand in for them, but they give the compressor the
    usual frequencies of characters, which surroundings of a line or two are too short for."""
    names = standard_identifiers()
    return " ".join(n[::-1] for n in names[::max(1, len(names) * 10 // LETTERS)])[:LETTERS].encode()


CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits)


def random_bits(candidate: str) -> float:
    """What a random string over the candidate's kinds of characters holds."""
    have = set(candidate)
    size = sum(len(c) for c in CLASSES if have & set(c)) + len(have - set("".join(CLASSES)))
    return len(candidate) * math.log2(max(size, 2))


def looks_random(candidate: str) -> bool:
    """Letters and digits, or upper and lower case that change as often as by chance."""
    kinds = ["" if not c.isalpha() else "u" if c.isupper() else "l" for c in candidate]
    if not any(kinds):
        return False
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]) if a and b)
    return any(c.isdigit() for c in candidate) or 3 * changes >= len(candidate)


class _Covered:
    """Which places of a text lie inside sorted spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = [a for _, a, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def without(self, start: int, s: str) -> str:
        """The string that begins at `start`, without the spans inside it."""
        out, at = [], start
        for i in range(bisect_left(self.starts, start), bisect_right(self.starts, start + len(s) - 1)):
            out.append(s[max(at, start) - start:max(at, self.starts[i]) - start])
            at = max(at, self.ends[i])
        return "".join([*out, s[at - start:]])


class Scanner:
    """Finds spans in one text after another. One per task; nothing is shared between texts."""

    def __init__(self, learned: tuple[str, ...] = (), least_share: float = LEAST_SHARE):
        self.compressor = _primed((*learned, *standard_identifiers()))
        self.least_share = least_share

    def marginal_bytes(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that the candidate adds to its surroundings."""
        around = _letters() + (before + "\n" + after + "\n").encode("utf-8", "replace")
        size = lambda data: len(self.compressor.compress(data))
        return size(around + candidate.encode()) - size(around)

    def _candidates(self, text: str, assigns: list[tuple[str, int, int]]) -> Iterator[tuple[int, str]]:
        """(start, string) of the long runs after sensitive words, in order."""
        past, ends = 0, [b for _, _, b in assigns]
        for word in SENSITIVE.finditer(text):
            for m in CANDIDATE.finditer(text, max(word.end(), past), word.end() + REACH + 4096):
                if m.start() > word.end() + REACH:
                    break
                start, end = m.span()
                if end == word.end() + REACH + 4096:  # the run may go on
                    end = CANDIDATE.match(text, start).end()
                past = end
                # a name before an assignment's key isn't part of the value
                i = bisect_right(ends, start)
                stop = min(end, assigns[i][1]) if i < len(assigns) else end
                s = text[start:max(start, stop)]
                if len(s) >= LEAST and looks_random(s) and not HARMLESS.fullmatch(s):
                    yield start, s

    def novel(self, text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        covered, strings, seen = _Covered(known), set(), set()
        for start, s in self._candidates(text, [k for k in known if k[0] == "assign"]):
            if s in seen or covered(start, start + len(s)):
                continue
            seen.add(s)
            reach = AROUND + len(s)
            before, after = text[max(0, start - reach):start], text[start + len(s):start + len(s) + reach]
            cost = self.marginal_bytes(before.replace(s, "")[-AROUND:], s, after.replace(s, "")[:AROUND])
            # what is a base span inside the candidate may repeat itself; the rest has to be random
            if 8 * cost >= self.least_share * random_bits(covered.without(start, s)):
                strings.add(s)
        if not strings:
            return []
        search = ahocorasick.Automaton()
        for s in strings:
            search.add_word(s, len(s))
        search.make_automaton()
        # the longest one at each place, and none inside a span that is reported anyway
        places = ((end + 1 - n, end + 1) for end, n in search.iter_long(text))
        return [("novel", a, b) for a, b in places if not covered(a, b)]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then by the order of KINDS."""
        known = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        known += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        known += [("hex", *m.span()) for m in HEX.finditer(text)]
        order = lambda s: (s[1], KINDS.index(s[0]))
        known.sort(key=order)
        return sorted(known + self.novel(text, known), key=order)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, learned: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` (all but the text if None) and `spans`; a column of that name is replaced.

    `learned`: identifiers of `learn_identifiers`.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c != "spans"]
    text = free_name(df, "scanned_text")
    rows = df.select(*map(column, keep), column(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(learned)
        for batch in sliced(batches, 1_000):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(t)] for t in texts_of(batch, text)]
            yield with_columns(batch, spans=pa.array(spans, _SPANS_ARROW)).select([*keep, "spans"])

    return rows.transform(map_arrow, run, schema_with(rows.drop(text), spans=SPANS))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, learned: tuple[str, ...] = ()) -> DataFrame:
    """df with secrets replaced in the text; texts without any stay as they are, null included.

    `length_col`, if given, is set to the new number of code points where a text changed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(learned)
        for batch in sliced(batches, 1_000):
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            new = {i: redacted(t, spans) for i, t in enumerate(texts) if t and (spans := scanner.spans(t))}
            if not new:
                yield batch
                continue
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            columns[text_col] = pa.array([new.get(i, t) for i, t in enumerate(texts)], columns[text_col].type)
            if length_col:
                old = columns[length_col]
                columns[length_col] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return df.transform(map_arrow, run, df.schema)
