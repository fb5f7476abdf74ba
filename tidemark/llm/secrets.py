"""Secrets in documents through a trigram inverted index, in DataFrame functions only.

Method. Each rule's regular expression is turned into a Boolean query over trigrams: any match must
contain all trigrams of one of its alternatives. The index holds postings (trigram, text key) of the
trigrams that occur in the rules' queries; postings of a text are intersected, and a rule is verified
only on the texts whose postings satisfy its query. A rule without mandatory trigrams (the hex runs)
scans every text. The index is on lower-case text, so it serves rules in either case.

Verification lists leftmost non-overlapping matches: one expression takes the gap before a match and
the match, anchored at the end of the one before, so the lengths of both give code-point offsets.

Scale. A posting key is the hash of the text, so copies share postings, and a collision can only add
a text to verify. Candidate keys are broadcast when at most `BROADCAST_KEYS` of them are counted, and
joined by key otherwise. Texts are read twice and moved only by that second kind of join.

Special cases. Null text is empty and has no spans. Repeated rows each come back. Spans of different
kinds may overlap; all are listed, by start, then in the order of the rules.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, store

BROADCAST_KEYS = 2_000_000
MOST_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: (group of the expression, its least length), checked after matching."""

    name: str
    pattern: str
    least: tuple[int, int] | None = None


#: The three kinds that every scan must report.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 8)),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds, each found by its published prefix.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _pieces(tokens) -> list[list[str]]:
    """Alternatives of an expression, each a list of literal fragments that a match must contain.

    Fragments stand in order; where two fragments are apart anything may lie between them.
    """
    done = [[""]]
    for op, arg in tokens:
        if op is kind.LITERAL:
            some = [[chr(arg)]]
        elif op is kind.IN and all(o is kind.LITERAL for o, _ in arg) and len(arg) <= 8:
            some = [[chr(a)] for _, a in arg]
        elif op is kind.SUBPATTERN:
            some = _pieces(arg[3])
        elif op is kind.BRANCH:
            some = [p for branch in arg[1] for p in _pieces(branch)]
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                some = [[""], *_pieces(inner)]
            elif least:
                some = [[*p, ""] if (least, most) != (1, 1) else p for p in _pieces(inner)]
            else:
                some = [["", ""]]
        else:
            some = [["", ""]]
        if len(done) * len(some) > MOST_ALTERNATIVES:
            some = [["", ""]]
        done = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in done for b in some]
    return done


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams (lower case), all of one of which any match contains; None if a match
    need not contain any."""
    out = set()
    for fragments in _pieces(parser.parse(pattern)):
        low = [f.lower() for f in fragments]
        grams = frozenset(f[i:i + 3] for f in low for i in range(len(f) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted((g for g in out if not any(o < g for o in out)), key=sorted)


def queries(rules=RULES) -> dict[str, list[frozenset[str]] | None]:
    return {r.name: trigram_query(r.pattern) for r in rules}


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def index(texts: DataFrame, grams: list[str]) -> DataFrame:
    """Texts (text) -> postings (gram, key), each once, of the given trigrams."""
    have = F.transform(F.array(F.lower("text")), lambda low: F.filter(
        F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))[0]
    return texts.where(F.length("text") >= 3).select(
        text_key(F.col("text")).alias("key"), F.explode(have).alias("gram")).distinct()


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """Postings -> (key, rules): the indexed rules whose trigram query the text satisfies.

    The set per key is bounded by the trigrams of the rules.
    """
    sets = postings.groupBy("key").agg(F.collect_set("gram").alias("have"))
    met = []
    for name, query in queries(rules).items():
        if query is not None:
            hit = F.lit(False)
            for grams in query:
                hit = hit | (F.size(F.array_except(F.array(*map(F.lit, sorted(grams))), "have")) == 0)
            met.append(F.when(hit, F.lit(name)))
    return sets.select("key", F.array_compact(F.array(*met)).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of one rule as an array of (start, order, end, kind)."""
    shifted = rf"\G(?s)(.*?)({rule.pattern})"
    pick = lambda g: F.regexp_extract_all(text, F.lit(shifted), F.lit(g))
    sizes = F.transform(pick(0), F.length)
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda done, n: F.concat(
        done, F.array(n + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))))
    value = F.transform(pick(2 + rule.least[0]), F.length) if rule.least else F.transform(pick(2), F.length)
    least = rule.least[1] if rule.least else 0
    whole = F.arrays_zip(ends.alias("e"), F.transform(pick(2), F.length).alias("n"), value.alias("v"))
    kept = F.filter(whole, lambda m: m["v"] >= least)
    return F.transform(kept, lambda m: F.struct((m["e"] - m["n"]).alias("start"), F.lit(order).alias("order"),
                                                m["e"].alias("end"), F.lit(rule.name).alias("kind")))


NONE = "array<struct<start:int,order:int,end:int,kind:string>>"


def scan(docs: DataFrame, rules=RULES, column: str = "spans") -> DataFrame:
    """docs with one more column: all spans as an array of (start, order, end, kind), sorted."""
    asked = queries(rules)
    grams = sorted({g for q in asked.values() if q for alt in q for g in alt})
    found = store(candidates(index(docs.select("text"), grams), rules), "secret-candidates")
    key, mark = fresh(docs, "key"), fresh(docs, "rules")
    found = found.select(F.col("key").alias(key), F.col("rules").alias(mark))
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    rows = docs.withColumn(key, text_key(F.col("text"))).join(found, key, "left")
    text, parts = F.coalesce("text", F.lit("")), []
    for order, rule in enumerate(rules):
        # A rule that scans every text looks for one match first; the expression with gaps costs more.
        due = F.array_contains(mark, rule.name) if asked[rule.name] else F.rlike(text, F.lit(rule.pattern))
        parts.append(F.when(F.coalesce(due, F.lit(False)), _spans(text, rule, order)).otherwise(F.array().cast(NONE)))
    return rows.withColumn(column, F.array_sort(F.concat(*parts))).drop(key, mark)


def digest(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """Text with every span, or run of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, lambda a: F.concat(
        a["out"], text.substr(a["at"] + 1, F.length(text))))).otherwise(text)
