"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Each rule's expression yields a Boolean query: alternatives of trigrams that any match must hold. Postings of those trigrams
are intersected, candidates are verified by the expression, and rules without mandatory trigrams scan all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost first and not overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


KEYWORDS = r"(?i:(password|passwd|secret|token|api_?key))"
BASE = (
    Rule("assign", KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@"),
)

Query = frozenset[frozenset[str]]  # any of these sets of trigrams, all of a set
ANY: Query = frozenset([frozenset()])


def _shortest(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(q for q in query if not any(p < q for p in query))


def _both(a: Query, b: Query) -> Query:
    out = _shortest(frozenset(p | q for p in a for q in b))
    return out if len(out) <= MAX_STRINGS else min(a, b, key=len)


def _grams(strings: set[str]) -> Query:
    return _shortest(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)) if strings else ANY


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings that a sequence can match, in lower case, or None; and its query."""
    run: set[str] = {""}
    query, whole = ANY, True

    def cut() -> None:
        nonlocal run, query, whole
        query, run, whole = _both(query, _grams(run)), {""}, False

    for op, arg in nodes:
        exact, own = None, ANY
        if op is sre.LITERAL:
            exact = {chr(arg).lower()}
        elif op is sre.IN and arg[0][0] is not sre.NEGATE:
            size = sum(1 if k is sre.LITERAL else v[1] - v[0] + 1 if k is sre.RANGE else 999 for k, v in arg)
            if size <= 8:
                exact = {chr(c).lower() for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))}
        elif op is sre.SUBPATTERN:
            exact, own = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            own = _shortest(frozenset().union(*(p[1] if p[0] is None else _grams(p[0]) for p in parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner, inner_query = _walk(body)
            if inner is not None and high <= 2:
                exact = set().union(*({"".join(p) for p in product(inner, repeat=n)} for n in range(low, int(high) + 1)))
            elif low:
                own = inner_query if inner is None else _grams(inner)
        if exact is not None and len(exact) * len(run) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
        else:
            cut()
            if exact is not None and len(exact) <= MAX_STRINGS:
                run = exact
            else:
                query = _both(query, own)
    if whole:
        return run, _grams(run)
    cut()
    return None, query


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which any text with a match holds; ANY if none is mandatory."""
    return _walk(sre_parser.parse(pattern))[1]


def postings(docs: DataFrame, id_col: str, text_col: str, grams: list[str]) -> DataFrame:
    """(gram, id): the inverted index of the given trigrams over lower-cased texts."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("low"))
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return low.select("id", F.explode(present).alias("gram"))


def candidates(docs: DataFrame, id_col: str, text_col: str, queries: dict[str, Query]) -> DataFrame:
    """(id, rules): the rules whose query the postings of a text meet; the table of query terms is small by construction."""
    terms = [(rule, f"{rule}{n}", len(grams), gram) for rule, query in queries.items() for n, grams in enumerate(sorted(map(sorted, query))) for gram in grams]
    asked = docs.sparkSession.createDataFrame(terms, "rule string, clause string, need int, gram string")
    met = postings(docs, id_col, text_col, sorted({t[3] for t in terms})).join(F.broadcast(asked), "gram")
    full = met.groupBy("id", "rule", "clause", "need").agg(F.size(F.collect_set("gram")).alias("n")).where("n = need")
    return full.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> in code points: gaps and matches of the expression, added up from the left."""
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    step = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(sized, F.length).alias("size"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        found = F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(step, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(id_col, base_spans, spans): secrets in each text, arrays of (start, kind, end) in code points, end exclusive, ordered
    by start and then by the order of the rules; `base_spans` are those of `base`.

    A null or empty text has none; very long texts are scanned whole; spans that begin at one place stand in the order of the
    rules; every row gives one row, also repeated ones and those with a null id, which are scanned in full; other columns are
    left out, whatever their names; an empty table gives an empty one. Texts meet their candidate rules by id; nothing is gathered but the rules
    of one text."""
    rules = [*base, *more]
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = candidates(docs.select(F.col(id_col).cast("long").alias("id"), text_col).where("id is not null"), "id", text_col, queries)
    met = texts.join(named, "id", "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))

    def ordered(group: tuple[Rule, ...]) -> Column:
        each = [spans(F.col("text"), r) if r.kind not in queries else F.when(F.col("id").isNull() | F.array_contains("rules", r.kind), spans(F.col("text"), r)).otherwise(none) for r in group]
        keyed = F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("n"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    split = met.select(F.col("id").alias(id_col), ordered(base).alias("base_spans"), ordered(more).alias("more_spans"))
    both = F.transform(F.concat("base_spans", "more_spans"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("n"), s["kind"].alias("kind"), s["end"].alias("end")))
    return split.select(id_col, "base_spans", F.transform(F.array_sort(both), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the whole documents table."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    hits = lambda group: f"regexp_extract_all(text, '{pattern}', {group})"
    return f"select doc_id, {number} as n, '{rule.kind}' as kind, string_split_regex(text, '{pattern}') as gaps, {hits(0)} as hits, {hits(rule.group)} as sized, {rule.least} as least from texts"


#: A match begins after the gaps and matches before it; DuckDB counts code points like the contract.
OP7_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_rule_sql(i, r) for i, r in enumerate([*BASE, *MORE]))}),
each as (select *, unnest(range(1, len(hits) + 1)) as i from found where len(hits) > 0),
placed as (
  select doc_id, n, kind, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) as start, length(hits[i]) as size
  from each where length(sized[i]) >= least),
spans as (select doc_id, n, kind, start, kind || ':' || start || ':' || (start + size) as span from placed)
select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, n) filter (where n < {len(BASE)}), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, n), '') as spans
from texts left join spans using (doc_id) group by doc_id
"""
