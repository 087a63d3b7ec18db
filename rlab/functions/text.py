"""Column functions on text: tokens, paths, reports, chunks. All of them are built-in expressions but
``cut_code_tokens``, which scans the bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    """An empty array of texts."""
    return F.array().cast("array<string>")


# The patterns of tokens, parts of identifiers, paths and patches in this module define the results.
def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def code_tokens(text: Column) -> Column:
    """Alphanumeric ASCII runs, cut where a lower-case letter or digit meets a capital, in lower case."""
    return F.transform(_words(text, "[A-Z]+[a-z0-9]*|[a-z0-9]+"), F.lower)


_UPPER, _LOWER = (np.isin(np.arange(256), [*map(ord, chars)]) for chars in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789"))
_FOLDED = np.where(_UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def cut_code_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``code_tokens`` of a batch of texts without nulls, by scans of its bytes: the number of tokens of each text, and all
    tokens in order. No byte of a character outside ASCII is one of ASCII."""
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    upper, lower = _UPPER[data], _LOWER[data]
    word = upper | lower
    starts = word.copy()
    starts[1:] &= ~word[:-1] | (upper[1:] & lower[:-1])
    first = ends[:-1][ends[:-1] < len(data)]  # a text begins a token of its own
    starts[first] = word[first]
    at = np.flatnonzero(starts)
    places = np.concatenate(([0], np.cumsum(word)))  # of each byte among those of words
    offsets = np.append(places[at], places[-1]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLDED[data[word]])])
    return np.diff(np.searchsorted(at, ends)), tokens


def text_tokens(text: Column) -> Column:
    """Identifiers and numbers of the lower-cased text."""
    return _words(F.lower(text), r"[a-zA-Z_]\w*|\d+")


def subtokens(name: Column) -> Column:
    """Parts of an identifier: by underscore, then capitalised words, lower-case runs and acronyms."""
    parts = F.split(F.coalesce(name, F.lit("")), "_")
    found = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit("[A-Z][a-z]*|[a-z]+|[A-Z]+(?=[A-Z]|$)"), 0)))
    return F.transform(found, F.lower)


def word_tokens(text: Column, limit: int | None = None, word_chars: bool = False) -> Column:
    """Runs of ASCII letters (or of word characters), the first ``limit`` of them."""
    found = _words(text, r"\w+" if word_chars else "[a-zA-Z]+")
    return F.slice(found, 1, limit) if limit else found


def path_tokens(path: Column) -> Column:
    """Tokens of a path: cut at slashes, dots, dashes and underscores, then text tokens."""
    parts = F.split(F.coalesce(path, F.lit("")), r"[/\\.\-_]")
    return F.flatten(F.transform(parts, text_tokens))


def split_report(text: Column, head: int = 300) -> Column:
    """struct(summary, description): first non-blank line and the rest. One line stands for both; a blank report gives
    its first ``head`` characters as summary and all of it as description."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    rest = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n")
    summary = F.when(F.size(lines) == 0, F.substring(text, 1, head)).otherwise(F.trim(F.get(lines, 0)))
    description = F.when(F.size(lines) <= 1, text).otherwise(rest)
    return F.struct(summary.alias("summary"), description.alias("description"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def line_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))


def safe_name(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def file_ext(path: Column, mode: str = "basename") -> Column:
    """Extension of a path, or `no_extension`. ``basename``: as of the last path part, a leading dot is no extension;
    ``path``: the same over the whole path with the dot; ``last_dot``: what follows the last dot, null without a dot."""
    if mode == "last_dot":
        return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))
    if mode not in ("basename", "path"):
        raise ValueError(f"unknown mode {mode!r}")
    name = F.substring_index(path, "/", -1) if mode == "basename" else path
    found = F.regexp_extract(name, r"[^./][^/]*(\.[^./]*)$" if mode == "basename" else r"[^/](\.[^./]*)$", 1)
    return F.when(path.isNull(), None).when(found.isin("", "."), "no_extension").otherwise(F.lower(found))


def repo_link(url: Column) -> Column:
    """Scheme, host, owner and repository of a link: its first five parts by slash; no link gives an empty text."""
    return F.coalesce(F.array_join(F.slice(F.split(url, "/"), 1, 5), "/"), F.lit(""))


def join_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def std_repo_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def parse_file_list(text: Column) -> Column:
    """Files of a stringified list (`['a', 'b']`), of names between blanks, or of one name; null gives none. A list that
    does not parse is one name."""
    text = F.trim(text)
    listed = F.from_json(F.translate(text, "'", '"'), "array<string>")
    looks = F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]"))
    return (
        F.when(text.isNull() | (text == ""), empty())
        .when(looks, F.coalesce(F.filter(listed, lambda x: x.isNotNull()), F.array(text)))
        .when(F.contains(text, F.lit(" ")), F.filter(F.split(text, " +"), lambda x: x != ""))
        .otherwise(F.array(text))
    )


def patch_paths(patch: Column) -> Column:
    """Distinct files that a unified diff names on either side."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^(?:--- a/|\+\+\+ b/)(.+?)\t*$"), 1))


def overlap_windows(tokens: Column, size: int, step: int, least_tail: int = 0) -> Column:
    """Windows of ``size`` tokens every ``step``; at most ``size`` tokens are one window. A later window of fewer than
    ``least_tail`` tokens is left out. No tokens: no window."""
    n = F.size(tokens)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    kept = F.filter(starts, lambda s: (s == 0) | (n - s >= least_tail))
    return F.when(n > 0, F.transform(kept, lambda s: F.slice(tokens, s + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def line_chunks(text: Column, n: int = 60, head: int = 2000) -> Column:
    """Chunks of n lines; blank ones are dropped, and if none is left, the first ``head`` characters are the chunk."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(n))
    chunks = F.filter(F.transform(starts, lambda s: F.array_join(F.slice(lines, s, n), "\n")), lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(""))) != "")
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.substring(text, 1, head)))


def pad_ids(ids: Column, size: int, pad: int = 0) -> Column:
    """Exactly ``size`` identifiers: cut, or filled up with ``pad`` on the right."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)


def seeded(seed: int | str, *keys: Column) -> Column:
    """Order-free pseudo-random key of a row: the digest of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
