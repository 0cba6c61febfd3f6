"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. The trigrams of all rules are
looked up in every text and become postings (trigram, document); a document is a candidate for a rule when it is in the postings of all
trigrams of one of the query's alternatives. Candidates are verified with the expression itself. Rules without mandatory trigrams are
verified on every text. Only documents' keys and small trigrams are in the index; texts move once, to meet their candidates.

A null text counts as empty and holds no secret. Rows with a null id are indexed by a hash of their text; repeated ids share candidates,
which can only add rules to verify. Positions are code points, ends exclusive. Where spans overlap, all of them are reported.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import free, without


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans with one start are listed, then further ones.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+-]{3,64}@"),
)
RULES = BASE + FURTHER

#: Strings that a part of an expression may stand for before the part counts as open, and alternatives of a query.
MOST = 32

Query = frozenset  # of alternatives; an alternative is a frozenset of trigrams that must all occur
ANY: Query = frozenset([frozenset()])


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams (lower case) of which every match of `pattern` contains one whole; ANY if nothing is mandatory."""
    return _both([_of_texts(x) if isinstance(x, frozenset) else x[1] for x in _parts(parser.parse(pattern))])


def _of_texts(texts: frozenset) -> Query:
    return _least(frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


def _least(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(queries: list[Query]) -> Query:
    out = ANY
    for q in sorted(queries, key=len):
        made = _least(frozenset(a | b for a, b in product(out, q)))
        out = made if len(made) <= MOST else out  # leaving a condition out only adds candidates
    return out


def _parts(nodes) -> list:
    """Consecutive parts of an expression: sets of the strings a part may be, or ("open", query) for parts without such a set."""
    out: list = [frozenset([""])]
    for code, arg in nodes:
        for part in _node(code, arg):
            joined = isinstance(part, frozenset) and isinstance(out[-1], frozenset) and frozenset(a + b for a, b in product(out[-1], part))
            if joined and len(joined) <= MOST:
                out[-1] = joined
            else:
                out.append(part)
    return out


def _node(code, arg) -> list:
    if code is op.LITERAL:
        return [frozenset([chr(arg).lower()])]
    if code is op.IN:
        if all(c is op.LITERAL for c, _ in arg):
            return [frozenset(chr(a).lower() for _, a in arg)]
        return [("open", ANY)]
    if code is op.SUBPATTERN:
        return _parts(arg[3])
    if code is op.BRANCH:
        branches = [_parts(b) for b in arg[1]]
        if all(len(b) == 1 for b in branches):
            return [frozenset().union(*(b[0] for b in branches))]
        return [("open", _least(frozenset().union(*(_both([_of_texts(x) if isinstance(x, frozenset) else x[1] for x in b]) for b in branches))))]
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        parts = _parts(inner)
        if (low, high) == (0, 1) and len(parts) == 1:
            return [parts[0] | {""}]
        if low == 0:
            return [("open", ANY)]
        return parts * min(low, 3) + ([] if low == high <= 3 else [("open", ANY)])
    return [("open", ANY)]


def _finder(trigrams: set[str]) -> str:
    """An expression that finds the given trigrams at every place, grouped by first letter."""
    by_first: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by_first.setdefault(t[0], []).append(t[1:])
    quoted = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in s)
    return "(?=(" + "|".join(f"{quoted(a)}(?:{'|'.join(map(quoted, rest))})" for a, rest in by_first.items()) + "))"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind's order, end) of a rule's matches. Texts are cut at the matches; their lengths give the places."""
    pattern = F.lit(rule.pattern)
    cut = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    sizes = F.transform(cut, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), (F.length(x["part"]) >= rule.least).alias("ok")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    at = lambda acc, x: acc["at"] + x["gap"]
    span = lambda acc, x: F.struct(at(acc, x).alias("start"), F.lit(order).alias("kind"), (at(acc, x) + x["whole"]).alias("end"))
    step = lambda acc, x: F.struct(
        (at(acc, x) + F.coalesce(x["whole"], F.lit(0))).alias("at"),
        F.when(x["ok"], F.concat(acc["out"], F.array(span(acc, x)))).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """Every row of `docs` with `out`: an array of (start, kind, end), ordered, `kind` being the number of the rule.

    A column of that name is replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, [out], (id_col, text_col))
    named, held = free(docs, "key"), free(docs, "kinds")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [(t, kind, i, len(alt)) for kind, q in queries.items() if q != ANY for i, alt in enumerate(sorted(q, key=sorted)) for t in sorted(alt)]
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(named, key)

    found = keyed.select(F.col(named).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_finder({t[0] for t in terms})), F.lit(1)))).alias("trigram"))
    wanted = spark.createDataFrame(terms, "trigram string, kind string, alternative int, need int")  # as many rows as the rules have trigrams
    postings = found.join(F.broadcast(wanted), "trigram")
    hits = postings.groupBy("key", "kind", "alternative", "need").agg(F.count_distinct("trigram").alias("have")).where("have = need")
    candidates = hits.groupBy(F.col("key").alias(named)).agg(F.collect_set("kind").alias(held))

    met = keyed.join(candidates.hint("shuffle_hash"), named, "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kinds = F.coalesce(held, F.array().cast("array<string>"))
    parts = []
    for order, rule in enumerate(rules):
        verify = F.array_contains(kinds, rule.kind) if queries[rule.kind] != ANY else text.rlike(rule.pattern)
        parts.append(F.when(verify, _spans(text, rule, order)).otherwise(none))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(F.concat(*parts)).alias(out))


def listed(secrets: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """`kind:start:end`, joined with commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[SECRET]", secrets: str = "secrets") -> DataFrame:
    """Rows of `find_secrets` with each secret, or run of overlapping ones, replaced by `mark`; the column `secrets` is dropped."""
    text = F.col(text_col)
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"])
        .otherwise(F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))))
        .alias("out"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.array_join(F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, F.length(text)))), "")
    clean = F.when(F.size(secrets) == 0, text).otherwise(F.aggregate(secrets, begin, step, end))
    return found.withColumn(text_col, clean).drop(secrets)
