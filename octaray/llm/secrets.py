"""Secret scans: a trigram inverted index selects the documents on which each rule's regular expression runs.

Every rule's expression is analysed into a Boolean query over trigrams, in disjunctive form: a document can hold a
match only if, for one of the alternatives, it holds all of its trigrams. One pass over the texts gives the postings of
the rules' trigrams, (trigram, document); the queries intersect them, and the candidates, a table of its own whose size
Spark knows, are joined back and verified by the expressions themselves. Rules without mandatory trigrams (runs of
hexadecimal digits) run on every document. All of it is SQL expressions.

Cases: a null or empty text has no spans; texts are scanned whole, whatever their length; repeated rows give equal
results; spans of different rules may overlap and are ordered by start, then rule; an empty table gives no rows; extra
columns stay with ``find_secrets`` unless they are called like its own. U+0001 in a text is read as U+0002, which no
rule matches either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read_table, settle

_parser = re._parser
MARK = "\x01"
#: A literal set larger than this is no longer multiplied out.
MAX_LITERALS = 64


@dataclass(frozen=True)
class SecretRule:
    kind: str
    #: In the common subset of Java's and Python's syntax.
    pattern: str
    #: Matches are dropped unless this group has at least so many characters.
    group: int = 0
    least: int = 1


#: The three base kinds.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds: publicly documented credential formats.
MORE_RULES = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,250}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that a match must hold; an empty set means: no condition."""
    exact, query = _analyse(_parser.parse(pattern))
    return _simplify(_and(query, _grams(exact)))


def _analyse(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """(the strings matched exactly, if they are few; the query)."""
    exact: set[str] | None = {""}
    query: list[frozenset[str]] = [frozenset()]
    for op, arg in items:
        name, part, more = str(op), None, [frozenset()]
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = {chr(v).lower() for _, v in arg}
        elif name == "SUBPATTERN":
            part, more = _analyse(arg[3])
        elif name == "BRANCH":
            each = [_analyse(x) for x in arg[1]]
            if all(e is not None for e, _ in each):
                part = set().union(*(e for e, _ in each))
            more = [q for e, qs in each for q in _and(qs, _grams(e))] if part is None else more
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            inner, inside = _analyse(sub)
            if inner is not None and (low, high) == (0, 1):
                part = inner | {""}
            elif low:
                more = _and(inside, _grams(inner))
        elif name == "AT":
            continue
        query = _and(query, more)
        if part is not None and exact is not None and len(part) * len(exact) <= MAX_LITERALS:
            exact = {a + b for a, b in product(exact, part)}
        else:
            query, exact = _and(query, _grams(exact)), part if part is not None and len(part) <= MAX_LITERALS else None
            exact = {""} if exact is None else exact
            if part is None:
                # What follows starts anew: its literals are still mandatory.
                exact = {""}
    return exact, query


def _grams(strings: set[str] | None) -> list[frozenset[str]]:
    if not strings:
        return [frozenset()]
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]


def _and(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return _simplify([x | y for x, y in product(a, b)])


def _simplify(query: list[frozenset[str]]) -> list[frozenset[str]]:
    return [q for q in dict.fromkeys(query) if not any(p < q for p in set(query))]


def query_trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})


def _any_trigram(trigrams: list[str]) -> str:
    """An expression that finds, at every place of a text, which of the trigrams begins there (group 1)."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in trigrams:
        tree.setdefault(a, {}).setdefault(b, []).append(c)

    def either(parts: list[str]) -> str:
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return f"(?=({either([re.escape(a) + either([re.escape(b) + either([re.escape(c) for c in last]) for b, last in rest.items()]) for a, rest in tree.items()])}))"


def trigram_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """(trigram, key): the postings of the rules' trigrams, letters in lower case. One pass over each text."""
    trigrams = query_trigrams(rules)
    if not trigrams:
        return docs.select(F.lit("").alias("trigram"), key).limit(0)
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_any_trigram(trigrams)), F.lit(1)))
    return docs.select(F.explode(held).alias("trigram"), key)


def candidates(postings: DataFrame, key: str = "doc_id", rules=RULES) -> DataFrame:
    """(key, rule_kinds): of the rules with mandatory trigrams, those whose Boolean query the key's postings satisfy.

    A query's alternatives are conjunctions. Every posting sets its bit in the alternatives that ask for its trigram,
    and an alternative is met where all its bits come together.
    """
    places: dict[str, list[Column]] = {}
    number = 0
    for rule in rules:
        for q in trigram_query(rule.pattern) if _mandatory(rule) else []:
            for i, t in enumerate(sorted(q)):
                # The widest alternative has far fewer trigrams than a long has bits.
                place = F.struct(F.lit(number).alias("part"), F.lit(rule.kind).alias("kind"), F.lit(1 << i).cast("long").alias("bit"), F.lit((1 << len(q)) - 1).cast("long").alias("whole"))
                places.setdefault(t, []).append(place)
            number += 1
    if not places:
        return postings.select(key, F.array().cast("array<string>").alias("rule_kinds")).limit(0)
    index = F.create_map(*[x for t, held in places.items() for x in (F.lit(t), F.array(*held))])
    hits = postings.select(key, F.inline(F.element_at(index, F.col("trigram"))))
    met = hits.groupBy(key, "part", "kind", "whole").agg(F.bit_or("bit").alias("bits")).filter("bits = whole")
    return met.groupBy(key).agg(F.collect_set("kind").alias("rule_kinds"))  # at most one entry for each rule


def _mandatory(rule: SecretRule) -> bool:
    """Whether every match holds some trigram; if not, the rule runs on every document."""
    query = trigram_query(rule.pattern)
    return bool(query) and all(query)


def _with_candidates(docs: DataFrame, text: str, rules) -> tuple[DataFrame, str, str]:
    """``docs`` with the kinds of the rules that they are candidates of; the names of the helper columns.

    Postings are keyed by a hash of the row: rows of equal hash share their postings, which only adds candidates.
    """
    key, kinds = free_name(docs, "posting_key"), free_name(docs, "rule_kinds")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumn(key, F.xxhash64(*plain))
    found = settle(candidates(trigram_postings(keyed, key, text, rules), key, rules))
    return keyed.join(found.withColumnRenamed("rule_kinds", kinds), key, "left"), key, kinds


def _runs(rule: SecretRule, text: Column, kinds: str) -> Column:
    """Whether a rule's expression runs on a text."""
    gate = F.regexp_like(text, F.lit(_gate(rule)))
    return F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)) & gate if _mandatory(rule) else gate


def _gate(rule: SecretRule) -> str:
    """What a kept match must hold; it spares marking texts without one.

    Literals and one run of a set need the length that is left for the run: ``least`` counts the whole match. Any other
    rule is its own gate.
    """
    *lead, last = _parser.parse(rule.pattern)
    run = str(last[0]) == "MAX_REPEAT" and last[1][0] == 1 and rule.pattern.endswith("]+") and len(last[1][2]) == 1
    if rule.group or not run or any(str(op) != "LITERAL" for op, _ in lead):
        return rule.pattern
    return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(lead))},}}"


def _pieces(text: Column, rule: SecretRule) -> Column:
    """The text cut at the matches: elements 0, 2, 4, ... lie between matches, 1, 3, 5, ... are matches."""
    safe = F.translate(text, MARK, "\x02")
    return F.split(F.regexp_replace(safe, rule.pattern, f"{MARK}$0{MARK}"), MARK)


def _kept(match: Column, rule: SecretRule) -> Column:
    return F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _spans(text: Column, rule: SecretRule, rank: int, kinds: str) -> Column:
    """Leftmost non-overlapping matches of one rule, in code points."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("hit"), F.lit([]).cast(SPAN).alias("spans"))

    def step(state, piece):
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.when(state["hit"] & _kept(piece, rule), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), (~state["hit"]).alias("hit"), spans.cast(SPAN).alias("spans"))

    found = F.aggregate(_pieces(text, rule), zero, step)["spans"]
    return F.when(_runs(rule, text, kinds), found).otherwise(F.lit([]).cast(SPAN))


def find_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: structs of start, rank, end and kind, ordered by start, then rule."""
    out, key, kinds = _with_candidates(docs, text, rules)
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = [_spans(whole, r, k, kinds) for k, r in enumerate(rules)]
    return out.withColumn("secret_spans", F.array_sort(F.concat(*spans))).drop(key, kinds)


def redact_secrets(docs: DataFrame, text: str = "text", rules=RULES, mask: str = "<{} removed>") -> DataFrame:
    """``docs`` with every kept match replaced, rule by rule; a null text stays null."""
    out, key, kinds = _with_candidates(docs, text, rules)
    for rule in rules:
        parts = _masked(_pieces(F.col(text), rule), rule, F.lit(mask.format(rule.kind)))
        out = out.withColumn(text, F.when(_runs(rule, F.col(text), kinds), F.array_join(parts, "")).otherwise(F.col(text)))
    return out.select(*docs.columns)


def _masked(pieces: Column, rule: SecretRule, mask: Column) -> Column:
    return F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & _kept(p, rule), mask).otherwise(p))


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans, base = F.col("secret_spans"), F.filter("secret_spans", lambda s: s["rank"] < len(BASE_RULES))

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_digest(find_secrets(docs).drop("text"))


def _oracle() -> str:
    cuts, all_spans = [], []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        cuts.append(f"string_split(regexp_replace(translate(coalesce(text, ''), chr(1), chr(2)), '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p{k}")
        kept = f"length(regexp_extract(p{k}[i], '{pattern}', {r.group})) >= {r.least}"
        start = f"list_sum(list_transform(p{k}[1:i-1], lambda x: length(x)))::BIGINT"
        all_spans.append(
            f"list_transform(list_filter(range(2, len(p{k}) + 1, 2), lambda i: {kept}), "
            f"lambda i: {{'s': {start}, 'r': {k}, 'e': {start} + length(p{k}[i]), 'k': '{r.kind}'}})"
        )
    text = "lambda x: x.k || ':' || x.s || ':' || x.e"
    return f"""
WITH cut AS (SELECT doc_id, {', '.join(cuts)} FROM documents),
found AS (SELECT doc_id, list_sort(list_concat({', '.join(all_spans)})) AS s FROM cut)
SELECT doc_id, len(list_filter(s, lambda x: x.k = 'assign'))::BIGINT AS n_assign, len(list_filter(s, lambda x: x.k = 'access'))::BIGINT AS n_access,
       len(list_filter(s, lambda x: x.k = 'hex'))::BIGINT AS n_hex,
       sha256(array_to_string(list_transform(list_filter(s, lambda x: x.r < 3), {text}), ',')) AS base_sha256,
       array_to_string(list_transform(s, {text}), ',') AS spans
FROM found
"""


OP8_SQL = _oracle()
