"""Secret scanning with trigram indexes over segments of documents.

Each rule is a regular expression. Its syntax tree yields a Boolean query over trigrams that every match
must contain: alternatives become OR, concatenations AND. A segment (some megabytes of texts within one
Arrow batch) gets an inverted index from the rules' trigrams to its documents; a rule's postings are
intersected and united as its query says, and only the candidates left are searched with the regex. A rule
without mandatory trigrams scans every document of the segment. Segments are independent, so the job
is one narrow pass: no shuffle, no state beyond a segment.

Matches are leftmost and non-overlapping per rule; a rule may ask for a least length of the match or of a
group, and matches that fail are dropped after matching. Positions are code points, end exclusive.

Edge cases: a null text is an empty one; null ids and repeated rows pass through, a result row for each;
very long texts form a segment of their own; an empty table gives an empty result; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three kinds that every result counts, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
# Publicly documented credential formats. None is tried from every place of a long run of letters.
FORMAT_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", any_case=True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]+:[^\s/:@]{3,}@"),
)

# A query is True (anything matches), a trigram, ("and", parts) or ("or", parts).
_MOST_STRINGS, _MOST_CHARS = 64, 8


def _join(op: str, parts: list) -> object:
    flat = list(dict.fromkeys(parts))
    if op == "and":
        flat = [p for p in flat if p is not True]
    elif any(p is True for p in flat):
        return True
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _of_strings(strings: set[bytes]) -> object:
    """Query of a text that contains one of these strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)] or [True]) for s in sorted(strings)])


def _fold(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def _class_strings(items: list) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(_fold(value))
        elif op is sre.RANGE and value[1] - value[0] < _MOST_CHARS:
            found |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= _MOST_CHARS else None


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """(all strings that the tree matches, folded, if they are few; a query that holds for each match)."""
    query: list = []
    exact: set[bytes] | None = {b""}
    whole = True

    def flush() -> None:
        nonlocal exact, whole
        query.append(_of_strings(exact))
        exact, whole = {b""}, False

    for op, value in tree:
        strings, sub = None, True
        if op is sre.LITERAL:
            strings = {_fold(value)}
        elif op is sre.IN:
            strings = _class_strings(value)
        elif op is sre.SUBPATTERN:
            strings, sub = _analyse(value[3])
        elif op is sre.BRANCH:
            found = [_analyse(branch) for branch in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*[s for s, _ in found])
            else:
                sub = _join("or", [q if s is None else _join("and", [q, _of_strings(s)]) for s, q in found])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            inner, inner_query = _analyse(body)
            if inner is not None and high <= 4 and len(inner) ** int(high) <= _MOST_STRINGS:
                strings = {b"".join(p) for n in range(low, int(high) + 1) for p in product(sorted(inner), repeat=n)}
            elif low:
                sub = inner_query if inner is None else _of_strings(inner)
        elif op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            strings = {b""}
        if strings is None or len(strings) * len(exact) > _MOST_STRINGS:
            flush()
            query.append(sub)
            if strings is not None:
                exact = strings
        else:
            exact = {a + b for a in exact for b in strings}
            query.append(sub)
    if not whole:
        flush()
        return None, _join("and", query)
    return exact, _join("and", query)


def trigram_query(pattern: str) -> object:
    """What a text must contain, as trigrams of its UTF-8 bytes with A-Z lower-cased, to match at all."""
    exact, query = _analyse(sre_parser.parse(pattern))
    return query if exact is None else _join("and", [query, _of_strings(exact)])


def query_trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*[query_trigrams(q) for q in query[1]])


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def segment_index(texts: list[bytes], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Trigram code -> sorted numbers of the texts that hold it, for the trigrams marked in wanted."""
    joined = np.frombuffer(b"\xff".join(texts).lower(), np.uint8)  # 0xFF is in no UTF-8 text
    if len(joined) < 3:
        return {}
    codes = joined[:-2].astype(np.uint32) << 16
    codes |= joined[1:-1].astype(np.uint32) << 8
    codes |= joined[2:]
    at = np.flatnonzero(wanted[codes])
    ends = np.cumsum([len(t) + 1 for t in texts])
    pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
    codes_at, first = np.unique(pairs >> 32, return_index=True)
    bounds = [*first.tolist(), len(pairs)]
    numbers = pairs & 0xFFFFFFFF
    return {code: numbers[a:b] for code, a, b in zip(codes_at.tolist(), bounds, bounds[1:], strict=False)}


def candidates(query: object, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return index.get(_code(query), np.empty(0, np.int64))
    parts = [candidates(q, index, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    found = parts[0]
    for p in parts[1:]:
        found = np.intersect1d(found, p, assume_unique=True)
    return found


def scan_segment(texts: list[str], rules: list[tuple[Rule, re.Pattern, object]], wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, number of the rule, end), sorted."""
    index = segment_index([t.encode("utf-8", "surrogatepass") for t in texts], wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, regex, query) in enumerate(rules):
        for i in candidates(query, index, len(texts)).tolist():
            for m in regex.finditer(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    return [sorted(spans) for spans in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + FORMAT_RULES, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 4_000_000) -> DataFrame:
    """id and spans: array of (kind, start, end) by start, then in the order of the rules."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        wanted = np.zeros(1 << 24, bool)
        for _, _, query in ready:
            wanted[[_code(t) for t in query_trigrams(query)]] = True
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= segment_bytes):
                    size += len(texts[stop])
                    stop += 1
                found = scan_segment(texts[start:stop], ready, wanted)
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in one] for one in found]
                yield pa.record_batch([batch.column(0).slice(start, stop - start), pa.array(spans, kind)], names=["id", "spans"])
                start = stop

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")
    return found.withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = of(*[r.kind for r in BASE_RULES])
    return found.select(id_col, *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
