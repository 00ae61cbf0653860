"""URL filter: pattern rules indexed by their rarest literal token.

Every rule becomes one anchored regular expression over ``host + path`` and a set of literal tokens that any fitting
URL must hold: the labels of the rule's host and the complete segments of its path (the last segment of a path that
does not end in ``/`` is only a prefix and is no token). The tokens' frequencies are counted over all URLs, each rule
is filed under its rarest token, and a URL runs only the expressions of the rules that its own tokens fetch. Rules
without a token are tried on every URL.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule that names a host; no fitting
rule gives a null rule and the default verdict; repeated rows are judged alike; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read_table

#: Up to this many rules the index is a constant in the plan; a larger one is joined, and Spark picks the join.
INLINE_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        tail = re.escape(self.path) if self.path else "(?:/|$)"
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{tail}" if self.host else rf"^[^/]*{tail}"

    @property
    def tokens(self) -> list[str]:
        segments = self.path.split("/")[:-1]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in segments if x]


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rarest_token_index(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str | None, list[Rule]]:
    """token -> rules filed under it (None: rules without tokens). ``urls`` has a ``tokens`` column."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        found = urls.select(F.explode(F.array_intersect("tokens", F.lit(wanted))).alias("token"))
        counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str | None, list[Rule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(key, []).append(rule)
    return index


def _rule_struct(rule: Rule) -> Column:
    return F.struct(
        F.lit(len(rule.name)).alias("size"), F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.regex).alias("regex")
    )


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """One row per page: key, host, path, rule (null: none fits) and verdict. The longest fitting rule wins."""
    host, path = host_path(F.col(url))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_token_index(urls, rules)
    if len(rules) <= inline_rules:
        best = _inline(index)
        out = urls.withColumn("best", best)
    else:
        out = urls.join(_joined(urls, index), ["host", "path"], "left")
    return out.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _inline(index: dict[str | None, list[Rule]]) -> Column:
    always = [_rule_struct(r) for r in index.get(None, [])]
    tokens = sorted(t for t in index if t is not None)
    lists: list[Column] = [F.array(*always)] if always else []
    if tokens:
        table = F.map_from_arrays(F.lit(tokens), F.array(*[F.array(*[_rule_struct(r) for r in index[t]]) for t in tokens]))
        held = F.array_intersect("tokens", F.lit(tokens))
        lists.append(F.flatten(F.transform(held, lambda t: F.element_at(table, t))))
    if not lists:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,regex:string>")
    line = F.concat("host", "path")
    fitting = F.filter(F.concat(*lists), lambda r: F.regexp_like(line, r["regex"]))
    return F.array_max(fitting)


def _joined(urls: DataFrame, index: dict[str | None, list[Rule]]) -> DataFrame:
    """Best rule per distinct (host, path), by joins on tokens: for rule sets that no plan should hold as a constant."""
    spark = urls.sparkSession
    rows = [(t or "", len(r.name), r.name, r.verdict, r.regex) for t, rs in index.items() for r in rs]
    table = spark.createDataFrame(rows, "token string, size int, rule string, verdict string, regex string")
    places = urls.select("host", "path", F.array_append("tokens", F.lit("")).alias("tokens")).distinct()
    hits = places.select("host", "path", F.explode("tokens").alias("token")).join(table, "token")
    hits = hits.filter(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    return hits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict", "regex")).alias("best"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest
), place AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), placed AS (SELECT row_number() OVER () AS n, * FROM place
), fits AS (
  SELECT n, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM placed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM placed p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
