"""Secret scans with a trigram index, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.trigrams import Query, all_trigrams, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regular expression, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order that ties in position follow. A run of one class
#: that is long enough is the same whether its length is asked for in the pattern or afterwards.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Further public formats of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE


def _satisfied(query: Query, held: F.Column) -> F.Column:
    """Whether the trigrams in the array `held` satisfy a query."""
    parts = [_satisfied(p, held) for p in query.parts]
    if query.op == "any":
        return reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a & b, [*(F.array_contains(held, t) for t in sorted(query.trigrams)), *parts])


def _held(folded: F.Column, trigrams: list[str]) -> F.Column:
    """The given trigrams that a text in lower case holds."""
    return F.filter(F.array(*(F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams)), F.isnotnull)


def _kinds(held: F.Column, rules: tuple[Rule, ...]) -> F.Column:
    """The kinds of the rules whose query the trigrams in `held` satisfy."""
    satisfied = (
        F.when(_satisfied(query, held), F.lit(rule.kind))
        for rule in rules
        if (query := trigram_query(rule.pattern)).op != "every"
    )
    return F.filter(F.array(*satisfied), F.isnotnull)


def postings(docs: DataFrame, trigrams: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The inverted index of the given trigrams: a row (trigram, id) for each text that holds one."""
    folded = docs.select(F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("folded"))
    return folded.select("id", F.explode(_held(F.col("folded"), trigrams)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ids and the rules whose query they satisfy: the posting lists are intersected by id.

    An id has as many trigrams as the rules have at most, however many texts there are.
    """
    held = index.groupBy("id").agg(F.collect_set("trigram").alias("held"))
    found = held.select("id", _kinds(F.col("held"), rules).alias("kinds"))
    return found.where(F.size("kinds") > 0)


def _spans(rule: Rule, order: int, text: F.Column) -> F.Column:
    """All matches of a rule in a text as (start, end, order, kind), in code points.

    The pieces between matches and the matches alternate, so lengths give the positions.
    """
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = (
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    )
    steps = F.arrays_zip(pieces.alias("piece"), matches.alias("found"), measured.alias("measured"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def add(so_far: F.Column, step: F.Column) -> F.Column:
        begin = so_far["at"] + F.length(step["piece"])
        end = begin + F.length(F.coalesce(step["found"], F.lit("")))
        span = F.struct(
            begin.cast("long").alias("start"),
            F.lit(order).alias("rank"),
            end.cast("long").alias("end"),
            F.lit(rule.kind).alias("kind"),
        )
        grown = F.when(F.length(step["measured"]) >= rule.least, F.concat(so_far["spans"], F.array(span)))
        return F.struct(end.alias("at"), F.coalesce(grown, so_far["spans"]).alias("spans"))

    return F.aggregate(steps, start, add)["spans"]


_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def find_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    doc_id: str = "doc_id",
    result: str = "secrets",
) -> DataFrame:
    """`docs` with the array `result` of (start, rank, end, kind), by start and then rule.

    Each rule's matches are those of its pattern from the left without overlap, of which the
    ones are dropped whose group is too short; `end` is exclusive, both count code points.

    A trigram query is derived from each pattern; an index of the trigrams that occur in the
    queries is built over all texts, its posting lists are intersected, and only texts that
    satisfy a rule's query are searched for the rule. Rules without mandatory trigrams search
    every text. As the index goes by id, texts that share an id are searched alike if one of
    them is a candidate; the search itself decides, so every row's result is that of its own
    text. Rows without an id can't be posted and would all be one key: their queries are asked
    of the trigrams of their own text, where they lie. Null and empty texts have no secrets.
    Other columns pass through, except that one called `result` is replaced.
    """
    docs = docs.drop(result)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted(set().union(*(all_trigrams(q) for q in queries.values())))
    full = {kind for kind, query in queries.items() if query.op == "every"}
    content = F.coalesce(F.col(text), F.lit(""))
    if trigrams:
        named = docs.where(F.col(doc_id).isNotNull())
        found = candidates(postings(named, trigrams, text, doc_id), rules)
        found = found.select(F.col("id").alias("__id"), F.col("kinds").alias("__kinds"))
        named = named.join(found.hint("shuffle_hash"), F.col(doc_id) == F.col("__id"), "left").drop("__id")
        own = _kinds(_held(F.lower(F.col(text)), trigrams), rules)
        docs = named.unionByName(docs.where(F.col(doc_id).isNull()).withColumn("__kinds", own))
    else:
        docs = docs.withColumn("__kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast(f"array<{_SPAN}>")
    each = []
    for order, rule in enumerate(rules):
        # A full scan first asks whether there is a match at all.
        wanted = (
            content.rlike(rule.pattern)
            if rule.kind in full
            else F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
        )
        each.append(F.when(wanted, _spans(rule, order, content)).otherwise(none))
    ordered = F.sort_array(F.concat(*each))
    return docs.withColumn(result, ordered).drop("__kinds")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: F.Column, spans: F.Column, mark: str = "[secret]") -> F.Column:
    """A text with its secrets replaced; spans that overlap or touch are replaced by one mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(so_far: F.Column, span: F.Column) -> F.Column:
        between = F.substring(text, (so_far["at"] + 1).cast("int"), (span["start"] - so_far["at"]).cast("int"))
        fresh = span["start"] > so_far["at"]
        begins = fresh | (so_far["at"] == 0)
        return F.struct(
            F.greatest(so_far["at"], span["end"]).alias("at"),
            F.when(begins, F.concat(so_far["out"], between, F.lit(mark))).otherwise(so_far["out"]).alias("out"),
        )

    def finish(done: F.Column) -> F.Column:
        return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, finish)).otherwise(text)
