"""URL filter as a sort-merge range join of urls with prefix rules.

A host's canonical key is its labels in reverse, each closed by a dot (``a.example.org`` becomes
``org.example.a.``), so a rule's host and all its subdomains are one interval of keys. Each batch of
urls is sorted by key and swept once together with the sorted rules: a stack holds the rules whose
interval contains the current key, outermost at the bottom, and the rules on the stack whose path
begins the url's path are the ones that fit. The sweep only moves forward on both sides.

Rules go to the tasks in blocks whose bytes are checked; with more than one block a url takes the
longest of the blocks' rules, in the same task. Urls are never shuffled, so no host is a hot key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.llm.text import narrow

BLOCK_BYTES = 16 << 20
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to
    ``?``, ``#`` or the end. Both are empty for null and without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def host_key(host: str) -> str:
    """Labels in reverse, each closed by a dot."""
    return ".".join(reversed(host.split("."))) + "."


@dataclass(frozen=True)
class Rule:
    key: str
    path: str
    text: str
    verdict: str

    @property
    def rank(self) -> tuple:
        """The longest rule wins; among equally long ones the longer host, then block before allow."""
        return len(self.text), len(self.key), self.verdict == "block", self.text


def sweep(keys: list[str], paths: list[str], rules: list[Rule]) -> list[Rule | None]:
    """The best rule of each url; ``rules`` are sorted by key."""
    starts = [r.key for r in rules]
    out: list[Rule | None] = [None] * len(keys)
    stack: list[list[Rule]] = []
    at, previous = 0, None
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        if key != previous:
            previous = key
            while stack and not key.startswith(stack[-1][0].key):
                stack.pop()
            while True:
                # Rules before this key that do not contain it contain no later key either.
                end = bisect.bisect_right(starts, key, at)
                at = _next_containing(starts, key, at, end)
                if at == end:
                    break
                same = bisect.bisect_right(starts, starts[at], at)
                stack.append(rules[at:same])
                at = same
        fitting = [r for level in stack for r in level if paths[i].startswith(r.path)]
        out[i] = max(fitting, key=lambda r: r.rank) if fitting else None
    return out


def _next_containing(starts: list[str], key: str, at: int, end: int) -> int:
    """The first rule in [at, end) whose interval contains ``key``: one of the key's own prefixes."""
    dot = key.find(".")
    while dot >= 0 and at < end:
        prefix = key[:dot + 1]
        found = bisect.bisect_left(starts, prefix, at, end)
        if found < end and starts[found] == prefix:
            return found
        dot = key.find(".", dot + 1)
    return end


def _judge(rules: list[Rule], schema: pa.Schema):
    rules = sorted(rules, key=lambda r: r.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [host_key(h) for h in batch.column("host").to_pylist()]
            best = sweep(keys, batch.column("path").to_pylist(), rules)
            old_rule, old_verdict = (batch.column(c).to_pylist() for c in ("rule", "verdict"))
            names, verdicts = [], []
            for rule, text, verdict in zip(best, old_rule, old_verdict):
                if rule is not None and (text is None or rule.rank > _rank(text, verdict)):
                    text, verdict = rule.text, rule.verdict
                names.append(text)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array(names, pa.string()), pa.array(verdicts, pa.string())], schema=schema)

    return run


def parse_rule(text: str, verdict: str) -> Rule:
    """``host/path``; the path begins with the slash."""
    host, slash, path = text.partition("/")
    return Rule(host_key(host.lower()), slash + path, text, verdict)


def _rank(text: str, verdict: str) -> tuple:
    return parse_rule(text, verdict).rank


def _blocks(rules: DataFrame, block_bytes: int) -> list[list[Rule]]:
    blocks, size = [[]], 0
    for row in rules.where("rule IS NOT NULL AND verdict IS NOT NULL").distinct().orderBy("rule", "verdict").toLocalIterator():
        if blocks[-1] and size + len(row.rule) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append(parse_rule(row.rule, row.verdict))
        size += len(row.rule)
    return blocks


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null where none fits), verdict.

    ``rules`` has columns rule (``host/path``) and verdict (``allow`` or ``block``); a rule fits its host
    and all subdomains where the url's path starts with its path, the longest fitting rule wins,
    among equals block. Null urls and urls without ``://`` have empty host and path and match no rule;
    rules with a null part are left out, repeated rules count once. Urls without a rule get
    ``default``. Empty tables give empty or default results; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    out = narrow(pages, page_id=id_col, url=url_col).select(
        "page_id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"))
    ddl = f"page_id {out.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    for block in _blocks(rules.select("rule", "verdict"), block_bytes):
        out = out.mapInArrow(_judge(block, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
    return out
