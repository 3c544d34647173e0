"""Search patterns of clients, matched in time proportional to the title.

A pattern takes one of three ways:

- `plain`: letters, dots and alternatives alone run in the JVM, where they can neither
  recurse nor backtrack beyond their own length;
- `linear`: everything else that automata can match (groups, classes, repeats, word
  boundaries) runs over Arrow batches with RE2, whose time and memory are bounded for any
  title;
- `bounded`: patterns that need backtracking (lookaround, references to groups, repeats of
  more than 1,000) run in the JVM if they have no repeated group, at most 2 repeats and 8
  alternatives and at most 1,000 characters, on titles of at most 1,000 characters: their
  stack follows the pattern and their time is bounded.

All others are refused: those that don't compile or that mean different things, or
nothing, to the client and here (`{` that begins no repeat, inline flags, Unicode
properties), and backtracking ones beyond those bounds.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOUNDED_TITLE = 1000
_PLAIN = re.compile(r"[^\\()\[\]{}*+?^$]*")
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_OPENS = re.compile(r"\((\?(?::|=|!|<=|<!|<[A-Za-z_]\w*>))?(?!\?)")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z]|0(?!\d)|[1-9]\d*|[dDwWsSbBtnrvf]|[^A-Za-z0-9])", re.S)


class Way(NamedTuple):
    way: str | None  # None: refused
    form: str | None  # what that way runs


class _Refused(Exception):
    pass


def _escape(found: re.Match, in_class: bool) -> str:
    code = found[1]
    if code[0] == "u":
        return f"\\x{{{code[1:]}}}"
    if code[0] == "c":
        return f"\\x{ord(code[1]) % 32:02x}"
    if code == "0":
        return "\\x00"
    if code == "s":
        return "\\s\\v" if in_class else "[\\s\\v]"
    if code == "S" and not in_class:
        return "[^\\s\\v]"
    if code == "b" and in_class:
        return "\\x08"
    return code if ord(code[0]) > 127 else found[0]


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The class that begins at `at`, with `[` in it escaped, and where it ends."""
    out, i = "[", at + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = i
    while i < len(pattern) and (pattern[i] != "]" or i == first):
        if pattern[i] == "\\":
            found = _ESCAPE.match(pattern, i)
            if not found or found[1][0] in "B123456789":
                raise _Refused
            out, i = out + _escape(found, True), found.end()
        else:
            out, i = out + (f"\\{pattern[i]}" if pattern[i] in "[&" else pattern[i]), i + 1
    if i == len(pattern):
        raise _Refused
    return out + "]", i + 1


def _forms(pattern: str) -> tuple[str, bool, bool]:
    """The pattern with only what RE2 and the JVM read alike, whether it needs backtracking, and whether that is bounded."""
    out, i, depth, backtracks, repeats, repeated_group = [], 0, 0, False, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            found = _ESCAPE.match(pattern, i)
            if not found:
                raise _Refused
            backtracks |= found[1].isdigit() and found[1] != "0"
            out.append(_escape(found, False))
            i = found.end()
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif c == "(":
            found = _OPENS.match(pattern, i)
            if not found:
                raise _Refused
            kind = found[1] or ""
            backtracks |= kind in ("?=", "?!", "?<=", "?<!")
            out.append("(" if kind.endswith(">") else found[0])
            i, depth = found.end(), depth + 1
        elif c in "*+?{":
            found = _REPEAT.match(pattern, i)
            if (c == "{" and not found) or not out or out[-1] in ("^", "$", "\\b", "\\B"):
                raise _Refused
            if found:
                backtracks |= max(int(x) for x in (found[1], found[3]) if x) > 1000
            repeats += 1
            repeated_group |= pattern[i - 1 : i] == ")"
            text = found[0] if found else c
            i += len(text)
            if pattern[i : i + 1] == "?":
                text, i = text + "?", i + 1
            out.append(text)
        else:
            depth -= c == ")"
            if depth < 0:
                raise _Refused
            out.append(c)
            i += 1
    if depth:
        raise _Refused
    return "".join(out), backtracks, not repeated_group and repeats <= 2 and pattern.count("|") <= 8 and len(pattern) <= 1000


_NOTHING = pa.array([""])


def _compiles(form: str) -> bool:
    try:
        pc.match_substring_regex(_NOTHING, form, ignore_case=True)
    except pa.ArrowInvalid:
        return False
    return True


@lru_cache(10_000)
def way_of(pattern: str) -> Way:
    """How a pattern is matched."""
    if _PLAIN.fullmatch(pattern):
        return Way("plain", pattern)
    try:
        form, backtracks, bounded = _forms(pattern)
    except _Refused:
        return Way(None, None)
    if backtracks:
        return Way("bounded", form) if bounded else Way(None, None)  # whether it compiles is for the JVM to say
    return Way("linear", form) if _compiles(form) else Way(None, None)


@F.pandas_udf(T.StructType([T.StructField("way", T.StringType()), T.StructField("form", T.StringType())]))
def _ways(pattern: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([way_of(p) if p is not None else Way(None, None) for p in pattern], columns=["way", "form"])


def _in_jvm(pattern: Column) -> Column:
    return F.concat(F.lit("(?iud)(?:"), pattern, F.lit(")"))


def ways(pattern: Column) -> Column:
    """A struct (way, form) of each pattern; way is null where it is refused."""
    found = _ways(pattern)
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), _in_jvm(found["form"]))
    return F.when((found["way"] != "bounded") | compiled.isNotNull(), found).otherwise(F.struct(F.lit(None).cast("string").alias("way"), F.lit(None).cast("string").alias("form")))


@F.arrow_udf(T.BooleanType())
def _linear(title: pa.Array, form: pa.Array) -> pa.Array:
    """Each title against its own form; equal forms of a batch together."""
    codes = form.dictionary_encode()
    index = codes.indices.fill_null(-1).to_numpy()
    order = np.argsort(index, kind="stable")
    edge = np.searchsorted(index[order], np.arange(len(codes.dictionary) + 1))
    out = np.zeros(len(index), bool)
    for k, text in enumerate(codes.dictionary.to_pylist()):
        rows = order[edge[k] : edge[k + 1]]
        out[rows] = pc.match_substring_regex(title.take(pa.array(rows)), text, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
    return pa.array(out)


def matches(title: Column, way: Column, form: Column) -> Column:
    """Whether the title matches; null or false where it is null, or too long for a bounded pattern."""
    jvm = (way == "plain") | ((way == "bounded") & (F.length(title) <= BOUNDED_TITLE))
    linear = way == "linear"
    return F.when(linear, _linear(F.when(linear, title), F.when(linear, form))).otherwise(F.rlike(F.when(jvm, title), _in_jvm(F.when(jvm, form).otherwise(""))))


def title_matches(title: Column, pattern: str) -> Column:
    """The same for one pattern, which must not be refused."""
    way, form = way_of(pattern)
    if way is None:
        raise ValueError(f"invalid or too costly regular expression: {pattern}")
    if way == "linear":
        return _linear(title, F.lit(form))
    found = title.rlike(f"(?iud)(?:{form})")
    return found if way == "plain" else F.when(F.length(title) <= BOUNDED_TITLE, found).when(title.isNotNull(), F.raise_error(F.lit("a title is too long for this regular expression")))
