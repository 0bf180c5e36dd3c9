"""URL filters by a bit-parallel wildcard automaton (operator 6).

Rules are globs over the canonical URL ``.host/path``.  In a glob, ``**``
stands for any characters, ``*`` for any but a slash, ``?`` for one that is
not a slash; everything else is itself.  Each glob takes one bit per character
plus one for its end, and all globs together are packed into the 64-bit words
of one Shift-And automaton: per character, all states of all rules advance by
one shift, one mask and one mask of self-loops (the wildcards), for a whole
batch of URLs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearhouse.llm.common import table, map_arrow


@dataclass(frozen=True)
class Rule:
    """``rule`` is what the result names; rules that give a verdict by default
    only (``named`` False) count where no named rule fits."""

    verdict: str
    rule: str
    glob: str
    named: bool = True


def site(verdict: str, host: str, path: str) -> Rule:
    """Host and all its subdomains, paths that start with ``path``."""
    return Rule(verdict, host + path, f"*.{host}{path}**")


SITES = (
    site("allow", "org", "/"),
    site("block", "example.org", "/es/"),
    site("block", "example.org", "/en/1"),
    site("allow", "com", "/fr/"),
    site("block", "com", "/de/"),
)
#: The method's own verdict where no site rule fits: hosts with these globs are blocked.
SPAM = tuple(Rule("block", g, f"**{g}**", named=False) for g in ("casino*.", "free-*bets*.", "cheap-*pills*.", "*-win.", "adult*.", "poker*."))


def _tokens(glob: str) -> list[str]:
    out, i = [], 0
    while i < len(glob):
        step = 2 if glob.startswith("**", i) else 1
        out.append(glob[i : i + step])
        i += step
    return out


class Automaton:
    """Shift-And over several words; bit layout: one block of bits per rule.

    State bit k of a rule: its first k units (characters and ``?``) are
    matched.  A wildcard keeps the state before it alive (a self-loop) on the
    characters it may stand for, so it takes no bit of its own.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        units, loops_any, loops_host, starts, ends = [], [], [], [], []
        for r in rules:
            starts.append(len(units))
            units.append(None)  # bit 0: nothing matched yet
            for t in _tokens(r.glob):
                if t == "**":
                    loops_any.append(len(units) - 1)
                elif t == "*":
                    loops_host.append(len(units) - 1)
                else:
                    units.append(t)
            ends.append(len(units) - 1)
        self.words = -(-len(units) // 64) or 1
        alphabet = sorted({u for u in units if u not in (None, "?")} | {"/"})
        self.codes = {c: i + 1 for i, c in enumerate(alphabet)}  # 0: any other character
        self.masks = np.zeros((len(alphabet) + 1, self.words), np.uint64)
        self.loops = np.zeros_like(self.masks)
        self.init, self.ends = np.zeros(self.words, np.uint64), ends

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

        for bit, u in enumerate(units):
            for code in range(len(alphabet) + 1):
                if u is not None and (self.codes[u] == code if u != "?" else code != self.codes["/"]):
                    put(self.masks[code], bit)
        for code in range(len(alphabet) + 1):
            for bit in loops_any:
                put(self.loops[code], bit)
            for bit in loops_host if code != self.codes["/"] else ():
                put(self.loops[code], bit)
        for bit in starts:
            put(self.init, bit)

    def match(self, urls: list[str]) -> np.ndarray:
        """One row per URL, one column per rule: does the whole URL fit?"""
        out = np.zeros((len(urls), len(self.rules)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        for at in range(0, len(order), 2048):
            rows = order[at : at + 2048]
            lengths = np.array([len(urls[i]) for i in rows])
            state = np.tile(self.init, (len(rows), 1))
            for pos in range(lengths[-1] if len(rows) else 0):
                live = int(np.searchsorted(lengths, pos, side="right"))  # rows[live:] still have a character here
                code = np.fromiter((self.codes.get(urls[i][pos], 0) for i in rows[live:]), np.int64, len(rows) - live)
                s = state[live:]
                moved = s << np.uint64(1)
                if self.words > 1:
                    moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[live:] = (moved & self.masks[code]) | (s & self.loops[code])
            for k, bit in enumerate(self.ends):
                out[rows, k] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) == 1
        return out


def host_of(url: str | None) -> tuple[str, str]:
    """(host, path): behind the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; then up to ``?`` or ``#``.  NULL or no ``://``: empty."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[cut:]
    stop = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:stop]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITES + SPAM, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    The longest named rule that fits gives rule and verdict (of equally long
    ones the first listed).  Where none fits, rule is NULL and the verdict is
    that of the first unnamed glob that fits, else ``default``; so a NULL or
    malformed url has empty host and path and the default.  Repeated rows are
    each judged; other columns are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    ranked = sorted((k for k, r in enumerate(rules) if r.named), key=lambda k: -len(rules[k].rule))
    rest = [k for k, r in enumerate(rules) if not r.named]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(rules)
        for b in batches:
            parts = [host_of(u) for u in b.column(1).to_pylist()]
            fits = machine.match([f".{h}{p}" for h, p in parts])
            names, verdicts = [], []
            for row in fits:
                named = next((k for k in ranked if row[k]), None)
                other = next((k for k in rest if row[k]), None)
                names.append(None if named is None else rules[named].rule)
                verdicts.append(rules[named].verdict if named is not None else rules[other].verdict if other is not None else default)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), pa.array(names, pa.string()), pa.array(verdicts)], schema=schema)

    return map_arrow(pages.select("page_id", "url"), run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url")))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), ruled AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
  CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host || path, 'casino[^/]*\.|free-[^/]*bets[^/]*\.|cheap-[^/]*pills[^/]*\.|-win\.|adult[^/]*\.|poker[^/]*\.') THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
"""
