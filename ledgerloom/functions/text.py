"""Text functions as column expressions: terms, folding, names, excerpts and byte limits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and limits of shortened texts, in bytes.
RESPONSE_MARKER = "\n[assistant response truncated]\n"
RESPONSE_BYTES = 12_000
ADJACENT_MARKER = "\n[adjacent assistant response truncated]\n"
ADJACENT_BYTES = 4_000
END_MARKER = "…[truncated]"
EXCERPT_BYTES = 500
PAGE_BYTES = 12_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def keyword_terms(keywords: list[str]) -> list[str]:
    """All keywords split at Unicode white space."""
    return [t for k in keywords for t in k.split()]


def supports_trigrams(terms: list[str]) -> bool:
    """Whether every term has three code points at least, so that all can be matched as phrases of trigrams."""
    return bool(terms) and all(len(t) >= 3 for t in terms)


def ascii_fold(text: Column) -> Column:
    """A-Z lower-cased and nothing else, as LIKE folds."""
    return F.translate(text, UPPER, LOWER)


def like_contains(text: Column, term: str) -> Column:
    """``text LIKE '%term%'`` with the term's own wild cards taken literally."""
    return F.contains(ascii_fold(text), F.lit(term.translate(str.maketrans(UPPER, LOWER))))


def like_pattern(term: str) -> str:
    """The LIKE pattern of a literal term, escaped by a backslash."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"


def occurrences(text: Column, term: str) -> Column:
    """How often the term stands in the text, overlapping and case-folded. Texts without it are not searched twice."""
    folded = term.lower()
    lowered = F.lower(text)
    quoted = "(?=" + re.sub(r"([^\w\s])", r"\\\1", folded, flags=re.ASCII) + ")" if folded.isascii() else "(?=\\Q" + folded + "\\E)"
    return F.when(F.contains(lowered, F.lit(folded)), F.regexp_count(lowered, F.lit(quoted))).otherwise(0).cast("long")


def strip_wikilink(name: Column) -> Column:
    """``[[ name ]]`` without its brackets."""
    return F.regexp_replace(F.trim(name), r"^\[\[\s*(.*?)\s*\]\]$", "$1")


def wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def slug(source: Column, default: str = "unknown-subject") -> Column:
    """A subject's name from a repository or path: its last part without ``.git``, lower-case letters and digits joined by dashes."""
    base = F.regexp_extract(F.regexp_replace(source, "/$", ""), "([^/]*)/*$", 1)
    s = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(base, r"\.git$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def set_normalize(values: Column) -> Column:
    """Trimmed, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda x: x != "")))


def ordered_set(values: Column) -> Column:
    """Trimmed, non-empty, distinct, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda x: x != ""))


def normalize_types(values: Column) -> Column:
    """Type names as a set, without wikilink brackets."""
    return set_normalize(F.transform(values, strip_wikilink))


def repo_conflict(known: Column, found: Column) -> Column:
    """Whether a repository is named that is not among the known ones."""
    return (F.coalesce(found, F.lit("")) != "") & (F.size(known) > 0) & ~F.exists(known, lambda k: canonical_repo(k) == canonical_repo(found))


def canonical_repo(url: Column) -> Column:
    """Lower-case host/path of scp-like, ssh and http addresses, without user, port and ``.git``; empty for anything else."""
    u = F.trim(url)
    address = F.regexp_replace(u, r"^[^@/]+@([^:/]+):(.*)$", "ssh://$1/$2")
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1)
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"\.git$", "")
    return F.when((host != "") & (path != ""), F.lower(F.concat(host, F.lit("/"), path))).otherwise("")


def glob_pattern(glob: str) -> str | None:
    """The regular expression of a path glob; None if the glob is malformed.

    ``*`` and ``?`` don't cross a slash. A class is ``[...]`` or ``[^...]`` of
    characters and ranges, of one at least. A backslash takes the next character
    as it is, inside of a class as well.
    """
    literal = lambda c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"
    out, at = [], 0

    def single() -> str:
        """A character of a class at ``at``."""
        nonlocal at
        if glob[at : at + 1] in ("", "-", "]"):
            raise IndexError
        at += glob[at] == "\\"
        at += 1
        return glob[at - 1]

    try:
        while at < len(glob):
            c, at = glob[at], at + 1
            if c in "*?":
                out.append("[^/]*" if c == "*" else "[^/]")
            elif c == "\\":
                out.append(literal(glob[at]))
                at += 1
            elif c == "[":
                negated = glob[at : at + 1] == "^"
                at += negated
                ranges = []
                while not ranges or glob[at] != "]":
                    low = high = single()
                    if glob[at] == "-":
                        at += 1
                        high = single()
                    ranges.append((low, high))
                at += 1
                inside = "".join(f"{literal(x)}-{literal(y)}" for x, y in ranges if x <= y)
                out.append(f"[{'^' * negated}{inside}]" if inside else "[\\s\\S]" if negated else "(?!)")
            else:
                out.append(literal(c))
    except IndexError:
        return None
    return "".join(out)


def glob_regex(glob: str) -> Column:
    """Anchored regular expressions of a column of globs; null for malformed ones. Aliases are few: make it a column of theirs before they meet values."""

    def each(globs: pd.Series) -> pd.Series:
        found = [None if g is None else glob_pattern(g) for g in globs]
        return pd.Series([None if r is None else f"\\A(?:{r})\\z" for r in found], dtype=object)

    return F.pandas_udf(each, "string")(glob)


def is_glob(alias: Column) -> Column:
    """Whether an alias has a wild card, a class or an escape."""
    return alias.rlike(r"[*?\[\\]")


def alias_matches(alias: Column, value: Column, regex: Column) -> Column:
    """Whether an alias names a path or repository: equal, the same repository, or by glob (``regex``: the alias's ``glob_regex``)."""
    exact = (alias == value) | ((canonical_repo(alias) == canonical_repo(value)) & (canonical_repo(alias) != ""))
    return (F.coalesce(value, F.lit("")) != "") & (F.coalesce(alias, F.lit("")) != "") & (exact | F.coalesce(F.rlike(value, regex), F.lit(False)))


def join_text_blocks(blocks: Column) -> Column:
    """The texts of an array of (type, text) blocks, joined by line breaks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n")


def format_token_count(n: Column) -> Column:
    """``999 tokens``, ``1.2k tokens``, ``123k tokens``, ``1.2m tokens``: one decimal below a hundred of a unit, none from there."""
    unit = F.when(n < 1_000_000, F.lit(1000.0)).otherwise(1_000_000.0)
    suffix = F.when(n < 1_000_000, "k tokens").otherwise("m tokens")
    x = n / unit
    number = F.when(x >= 100, F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" tokens"))).otherwise(F.concat(number, suffix))


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of B, KiB, MiB and GiB that leaves a number of at least one."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = F.when(n >= F.lit(1024**k), F.format_string(f"%.1f {unit}", n / F.lit(1024**k))).otherwise(out)
    return out


def _prefix(data: bytes, n: int) -> bytes:
    while 0 < n < len(data) and data[n] & 0xC0 == 0x80:
        n -= 1
    return data[: max(n, 0)]


def _suffix(data: bytes, n: int) -> bytes:
    at = max(len(data) - n, 0)
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return data[at:]


def shorten_middle(text: str, limit: int, marker: str = RESPONSE_MARKER) -> str:
    """At most ``limit`` bytes: both ends around a marker, cut between characters."""
    data = text.encode()
    if len(data) <= limit:
        return text
    room = max(limit - len(marker.encode()), 0)
    return _prefix(data, room // 2).decode() + marker + _suffix(data, room - room // 2).decode()


def shorten_end(text: str, limit: int, marker: str = END_MARKER) -> str:
    """At most ``limit`` bytes: the beginning, a marker and a line break, cut between characters; empty if they leave no room."""
    data = text.encode()
    if len(data) <= limit:
        return text
    room = limit - len(marker.encode()) - 1
    return _prefix(data, room).decode() + marker + "\n" if room > 0 else ""


def pages(messages: list[tuple[str, str]], size: int = PAGE_BYTES) -> list[list[tuple[str, str]]]:
    """A dialogue in pages of at most ``size`` bytes of content.

    A message that does not fit goes on in the next page; no character is split,
    so one that is larger than a page has a page of its own. Empty messages are
    left out, and a dialogue without content is one empty page.
    """
    out: list[list[tuple[str, str]]] = []
    room = 0
    for role, content in messages:
        data = content.encode()
        while data:
            part = _prefix(data, room) if out else b""
            if not part:
                if not out or room < size:
                    out.append([])
                    room = size
                part = _prefix(data, room) or data[: len(data.decode()[0].encode())]
            out[-1].append((role, part.decode()))
            data, room = data[len(part) :], max(room - len(part), 0)
    return out or [[]]


def limit_both_ends(text: Column, limit: int = RESPONSE_BYTES, marker: str = RESPONSE_MARKER) -> Column:
    return _limited(lambda t, n: shorten_middle(t, n, marker), text, limit)


def limit_end(text: Column, limit: int) -> Column:
    return _limited(shorten_end, text, limit)


def _limited(how, text: Column, limit: int) -> Column:
    """Only texts above the limit are touched by the function; Spark hands them over in Arrow batches."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else how(t, limit))

    return F.when(F.octet_length(text) <= limit, text).otherwise(F.pandas_udf(each, "string")(text))


def excerpt(body: Column, limit: int = EXCERPT_BYTES) -> Column:
    """The first paragraph that is not a heading, at most ``limit`` bytes, cut between characters."""
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    paragraph = F.filter(F.transform(F.split(body, "\n\n"), lambda p: strip(p)), lambda p: (p != "") & ~p.startswith("#"))

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _prefix(t.encode(), limit).decode())

    first = F.coalesce(F.get(paragraph, F.lit(0)), F.lit(""))
    return F.when(F.octet_length(first) <= limit, first).otherwise(F.pandas_udf(cut, "string")(first))
