"""URL rules, each found through its rarest literal token.

A rule is an action and a pattern ``host/path``; ``*`` in the path stands for any
characters. It fits its host and all subdomains where the url's path starts with the
rule's. The rule is indexed by that of its whole tokens which is rarest in the urls at
hand; a url fetches the rules of its own tokens, and only these run their regular
expression. The longest fitting rule decides (then the longer host, then ``block``).

The rules come from the caller, so their index is as small as the caller's list. Urls
are judged where they lie, without a shuffle.

Nulls and ties: a null url, or one without ``://``, has an empty host and path and
fits no rule. Repeated rows give repeated results, an empty table an empty one; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "".join(self.pattern.partition("/")[1:])

    @property
    def rank(self) -> tuple[int, int, bool]:
        return len(self.pattern), len(self.host), self.action == "block"

    def regex(self) -> re.Pattern[str]:
        path = ".*".join(re.escape(x) for x in self.path.split("*")) or r"(?=/|\Z)"
        return re.compile(rf"(?:[^/]*\.)?{re.escape(self.host)}{path}", re.DOTALL)

    def tokens(self) -> set[str]:
        """Tokens that a fitting url has whole: ended by another mark, or by the host."""
        whole = set(TOKEN.findall(self.host))
        for found in TOKEN.finditer(self.path):
            after = self.path[found.end() : found.end() + 1]
            before = self.path[found.start() - 1 : found.start()]
            if after not in ("", "*") and before != "*":
                whole.add(found[0])
        return whole


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, A_TO_Z, A_TO_Z.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(parts: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """In how many urls each token of the rules occurs; as many rows as such tokens."""
    wanted = sorted(set().union(*(rule.tokens() for rule in rules)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = frozenset(wanted), Counter()
        for batch in batches:
            for host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update(known.intersection(TOKEN.findall(f"{host}{path}")))
        yield pa.RecordBatch.from_pydict(
            {"token": pa.array(list(found), pa.string()), "n": pa.array(found.values(), pa.int64())}
        )

    counted = parts.select("host", "path").mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index_rules(rules: list[UrlRule], counts: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Rules by their rarest token; those without any stand under the empty one."""
    index = defaultdict(list)
    for rule in rules:
        rarest = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
        index[rarest].append(rule)
    return dict(index)


def judge_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Per row: the id, ``host``, ``path``, the deciding ``rule`` and the ``verdict``."""
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(
        F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")
    )
    index = index_rules(rules, token_counts(parts, rules) if rules else {})
    shared = pages.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = {t: [(r, r.regex()) for r in found] for t, found in shared.value.items()}
        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths, strict=True):
                subject = f"{host}{path}"
                tokens = {"", *TOKEN.findall(subject)} & known.keys()
                fits = [r for t in tokens for r, regex in known[t] if regex.match(subject)]
                best = max(fits, key=lambda r: r.rank, default=None)
                out.append((best.pattern, best.action) if best else (None, default))
            yield pd.DataFrame(out, columns=["rule", "verdict"], dtype=object)

    judged = parts.withColumn("judged", decide("host", "path"))
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "judged.rule", "judged.verdict"
    )
