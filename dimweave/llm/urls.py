"""URL filter: rules indexed by their rarest literal token, regular expressions run on candidates only.

A rule is a site rule (``host/path``: the host and all its subdomains, paths that start with the
rule's path) or a pattern (``*`` matches anything, matched against host and rest of the url). Every
rule compiles to one regular expression. Its literal tokens are its runs of letters and digits that
must appear in a matching url as whole tokens. ``token_counts`` counts those tokens over all urls, and
each rule is filed under its rarest one. A url's tokens fetch the rules filed under them, and only
those rules run their expression. A rule without any whole token is tried on every url.

The longest site rule that fits decides; without one, the longest pattern that fits decides; without
one, the verdict is ``default``. Of equally long rules the first in text order decides.

Edge cases: a NULL url or one without ``://`` has an empty host and path, no rule and the default
verdict. Repeated rows are judged one by one. An empty table gives an empty result. The result has the
columns asked for by ``keep`` and then ``host, path, rule, verdict``; an input column of one of these
names is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimweave.llm.common import ship_package

TOKEN = r"[A-Za-z0-9]+"
OUTPUT = ("host", "path", "rule", "verdict")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` is block or allow. ``text`` is ``host/path`` of a site rule, else a pattern with ``*``."""

    verdict: str
    text: str
    site: bool = True

    def regex(self) -> str:
        """The expression that host + rest of the url must match from its first character."""
        if self.site:
            return r"(?:[^/?#]*\.)?" + re.escape(self.text)
        return "(?s:" + ".*".join(re.escape(p) for p in self.text.split("*")) + r")\Z"

    def tokens(self) -> list[str]:
        """Runs of letters and digits that a matching url has as whole tokens."""
        runs = re.finditer(TOKEN, self.text)
        if self.site:  # a path may go on after the rule's last run
            return [m[0] for m in runs if m.end() < len(self.text)]
        edges = (len(self.text), "*")
        whole = []
        for m in runs:
            before = self.text[m.start() - 1] if m.start() else ""
            after = self.text[m.end()] if m.end() < edges[0] else ""
            if before != edges[1] and after != edges[1]:
                whole.append(m[0])
        return whole


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest after the host); the host's A-Z are lower-cased."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    rest = rest[len(host):]
    return host.translate(_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0], rest


def token_counts(urls: DataFrame, tokens: Sequence[str], url_col: str = "url") -> dict[str, int]:
    """How many urls hold each of ``tokens``; one row per token of the rules reaches the driver."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(url_col), F.lit(f"({TOKEN})"), 1)))
    counted = urls.select(found.alias("token")).where(F.col("token").isin(list(tokens))).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def index_rules(rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list[UrlRule]], list[UrlRule]]:
    """Rules by their rarest token, and the rules without a token."""
    index: dict[str, list[UrlRule]] = {}
    rest = []
    for rule in rules:
        tokens = rule.tokens()
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def judge_urls(urls: DataFrame, rules: Sequence[UrlRule], keep: Sequence[str] = (), url_col: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` columns, then host, path, rule (a site rule's text or NULL) and verdict of every url.

    The rules are a parameter, so what each task holds is bounded by it and not by the table.
    """
    ship_package(urls.sparkSession)
    index, rest = index_rules(rules, token_counts(urls, sorted({t for r in rules for t in r.tokens()}), url_col))
    keep = [c for c in keep if c not in OUTPUT]
    schema = T.StructType([T.StructField(f"k{i}", urls.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(c, T.StringType()) for c in OUTPUT])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r: re.compile(r.regex()) for r in rules}
        token = re.compile(TOKEN)

        def verdict(url: str | None) -> tuple[str, str, str | None, str]:
            host, path, after = split_url(url)
            subject = host + after
            candidates = dict.fromkeys(r for t in dict.fromkeys(token.findall(subject)) for r in index.get(t, ()))
            # a site rule looks at host and path only, so what follows them cannot match it
            fits = [r for r in [*candidates, *rest] if host and compiled[r].match(host + path if r.site else subject)]
            best = min(fits, key=lambda r: (not r.site, -len(r.text), r.text), default=None)
            return host, path, best.text if best and best.site else None, best.verdict if best else default

        for batch in batches:
            judged = [verdict(u) for u in batch.column(len(keep)).to_pylist()]
            new = [pa.array([j[i] for j in judged], pa.string()) for i in range(len(OUTPUT))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    named = urls.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(url_col).alias("url"))
    judged = named.mapInArrow(judge, schema)
    return judged.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *OUTPUT)
