"""Secret scans: a trigram inverted index picks the candidate documents of each rule, whole texts verify them.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: the strings that a match must
contain (in runs of characters that the expression fixes) give an AND of alternatives, each of which is an AND of trigrams.
The index holds a posting (trigram, document) for each trigram that some query asks for; postings of a document are
intersected by grouping, and a rule is a candidate if its query holds.  Rules without mandatory trigrams scan every text.
Candidates only ever save work: every span comes from the rule's expression on the whole text.  The candidates' table, which carries no text, is counted;
up to ``MAX_CANDIDATES`` rows of it are sent to all executors, so texts aren't shuffled, and a larger one is joined by a shuffle, with the same result.

Spans are leftmost, non-overlapping by kind, in code points with exclusive ends; matches that fail their length rule are
dropped after matching.

Defined results: a null text is empty and has no spans (its redacted text stays null); a document is known by its id and its text, so repeated rows, null ids and texts
under one id get what each would get alone; added columns replace input columns of the same name, all others stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, let, materialize, others

ADDED = ("spans", "redacted")
MAX_CANDIDATES = 500_000
#: Spans are located block by block, as arrays are copied when they grow.
BLOCK = 256
#: Characters of a block that pieces of a text are cut from.
PIECE = 2048
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Runs of fixed characters are followed through alternatives up to so many strings; beyond, the run ends there.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` must have."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github-fine", "github_pat_[A-Za-z0-9_]{82}"),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{24,}"),
    Rule("sendgrid", "SG\\.[A-Za-z0-9_-]{22}\\.[A-Za-z0-9_-]{43}"),
    Rule("npm", "npm_[A-Za-z0-9]{36}"),
    Rule("pypi", "pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("google-oauth", "ya29\\.[0-9A-Za-z_-]{20,}"),
    Rule("slack-hook", "hooks\\.slack\\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]{20,}"),
    Rule("mailgun", "key-[0-9a-zA-Z]{32}"),
    Rule("bearer", "Bearer\\x20+[A-Za-z0-9_.~+/-]{24,}=*"),
    Rule("url-password", "://[A-Za-z0-9_.~-]+:[^\\x00-\\x20/@:]{6,}@"),
)
RULES = BASE_RULES + MORE_RULES


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def required(regex: str) -> list[list[frozenset[str]]]:
    """The query: an AND of lists of alternatives, each an AND of trigrams; empty if nothing is mandatory."""
    query: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        sets = {trigrams(s.lower()) for s in strings}
        if sets and all(sets):
            query.append(sorted(sets, key=sorted))
        return {""}

    def exact(items: Sequence) -> set[str] | None:
        """All strings that the items match, if they are few."""
        found = {""}
        for op, arg in items:
            step = one(op, arg)
            if step is None or len(found) * len(step) > MAX_STRINGS:
                return None
            found = {a + b for a, b in product(found, step)}
        return found

    def one(op, arg) -> set[str] | None:
        if op is C.LITERAL:
            return {chr(arg)}
        if op is C.SUBPATTERN:
            return exact(arg[3])
        if op is C.BRANCH:
            parts = [exact(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.IN and all(o is C.LITERAL for o, _ in arg):
            return {chr(a) for _, a in arg}
        if op is C.MAX_REPEAT and arg[1] != C.MAXREPEAT and arg[1] <= 4:
            inner = exact(arg[2])
            return None if inner is None else set().union(*({"".join(p) for p in product(inner, repeat=n)} for n in range(arg[0], arg[1] + 1)))
        return None

    def walk(items: Sequence, strings: set[str]) -> set[str]:
        for op, arg in items:
            step = one(op, arg)
            # what may be empty ends a run unless the run stays short: its trigrams would only weaken the query
            if step is not None and len(strings) * len(step) <= MAX_STRINGS and ("" not in step or min(map(len, strings)) < 3):
                strings = {a + b for a, b in product(strings, step)}
                continue
            strings = flush(strings)
            if op is C.SUBPATTERN:
                strings = walk(arg[3], strings)
            elif op is C.MAX_REPEAT and arg[0] > 0:
                flush(walk(arg[2], {""}))
            elif step is not None and "" not in step and len(step) <= MAX_STRINGS:
                strings = step
        return strings

    flush(walk(list(_parser.parse(regex)), {""}))
    return query


def index(documents: DataFrame, wanted: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """Postings (id, th, t) of the wanted trigrams, by their number."""
    text = column(text_col)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = let(low, lambda x: F.array_compact(F.array(*[F.when(F.contains(x, F.lit(t)), F.lit(n)) for n, t in enumerate(wanted)])))
    return documents.select(column(id_col).alias("id"), F.xxhash64(text).alias("th"), F.explode(hits).alias("t"))


def candidates(documents: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame:
    """(id, th, rules): the numbers of the rules whose queries hold; documents with none are left out."""
    queries = {n: q for n, r in enumerate(rules) if (q := required(r.regex))}
    wanted = sorted({t for q in queries.values() for alternatives in q for s in alternatives for t in s})
    number = {t: n for n, t in enumerate(wanted)}
    postings = index(documents, wanted, id_col, text_col)
    has = F.col("has")

    def holds(query: list[list[frozenset[str]]]) -> Column:
        met = F.lit(True)
        for alternatives in query:
            some = F.lit(False)
            for s in alternatives:
                asked = F.array(*[F.lit(number[t]) for t in sorted(s)])
                some = some | (F.size(F.array_intersect(asked, has)) == len(s))
            met = met & some
        return met

    found = F.array_compact(F.array(*[F.when(holds(q), F.lit(n)) for n, q in queries.items()]))
    return postings.groupBy("id", "th").agg(F.collect_set("t").alias("has")).select("id", "th", found.alias("rules")).where(F.size("rules") > 0)


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's spans in a text."""
    whole, gaps = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    part = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length) if rule.group else None
    none = F.array().cast(SPANS)

    def start(at: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.array(F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end")))
        return F.struct(end.cast("bigint").alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def located(m: Column) -> Column:
        lengths = F.transform(m, lambda x: F.length(x))
        zipped = F.arrays_zip(lengths.alias("len"), F.transform(gaps, lambda g: F.length(g)).alias("gap"), (part if part is not None else lengths).alias("part"))

        def blocks(steps: Column) -> Column:
            def block(acc: Column, b: Column) -> Column:
                done = F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), start(acc["at"]), step)
                return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))

            return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), start(F.lit(0)), block, lambda acc: acc["out"])

        return let(F.slice(F.transform(zipped, lambda x: F.struct(x["len"].alias("len"), x["gap"].alias("gap"), x["part"].alias("part"))), 1, F.size(m)), blocks)

    return let(whole, lambda m: F.when(F.size(m) == 0, none).otherwise(located(m)))


def narrowed(rule: Rule) -> Rule:
    """A rule that is one repeated class may count its own length: its runs are maximal, so short ones can be left out at once."""
    parsed = list(_parser.parse(rule.regex))
    if rule.group == 0 and len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT and parsed[0][1][:2] == (1, C.MAXREPEAT) and rule.regex.endswith("]+"):
        return Rule(rule.kind, rule.regex[:-1] + f"{{{rule.least},}}", 0, rule.least)
    return rule


def redact(text: Column, spans: Column, mark: str) -> Column:
    """The text with every run of overlapping or touching spans replaced by the mark.  ``spans`` are sorted; runs are told by the
    furthest end so far, and each piece between runs is cut once.  Both go in blocks, of spans and of the text's characters: a list grows by a block at a time, and a
    piece is cut from the blocks that it lies in, so a long text of many secrets costs little more than its length."""
    kind = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(kind)

    def state(start: Column, end: Column, out: Column) -> Column:
        return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), out.cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        done = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        grown = state(acc["start"], F.greatest(acc["end"], s["end"]), acc["out"])
        return F.when(acc["start"].isNull(), state(s["start"], s["end"], acc["out"])).when(s["start"] <= acc["end"], grown).otherwise(state(s["start"], s["end"], F.concat(acc["out"], done)))

    def block(acc: Column, b: Column) -> Column:
        done = F.aggregate(F.slice(spans, b * BLOCK + 1, BLOCK), state(acc["start"], acc["end"], none), step)
        return let(done, lambda d: state(d["start"], d["end"], F.concat(acc["out"], d["out"])))

    last = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
    nothing = state(F.lit(None), F.lit(None), none)
    merged = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), nothing, block, last)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda i: F.substr(text, i * PIECE + 1, F.lit(PIECE)))

    def cut(m: Column, blocks: Column) -> Column:
        def between(begin: Column, end: Column) -> Column:
            first = F.floor(begin / PIECE).cast("int")
            held = F.slice(blocks, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
            return F.substr(F.array_join(held, ""), (begin - first * PIECE + 1).cast("int"), (end - begin).cast("int"))

        def piece(s: Column, i: Column) -> Column:
            return F.concat(between(F.coalesce(F.get(m, i - 1)["end"], F.lit(0)), s["start"]), F.lit(mark))

        return F.concat(F.array_join(F.transform(m, piece), ""), between(F.try_element_at(m, F.lit(-1))["end"], F.length(text).cast("bigint")))

    return F.when(F.size(spans) == 0, text).otherwise(let(merged, lambda m: let(parts, lambda b: cut(m, b))))


def scan(documents: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with ``spans`` (start, number of the rule, end; sorted) and ``redacted``, the text without them."""
    raw = column(text_col)
    found = materialize(candidates(documents, rules, id_col, text_col), "candidates")
    picked = F.broadcast(found) if found.count() <= MAX_CANDIDATES else found
    text_at, id_at, hash_at = fresh([*documents.columns, *ADDED, "id", "th", "rules"], "key_text", "key_id", "key_hash")
    keyed = documents.select("*", raw.alias(text_at), column(id_col).alias(id_at), F.xxhash64(raw).alias(hash_at))
    joined = keyed.alias("d").join(picked.alias("c"), F.col(f"d.{id_at}").eqNullSafe(F.col("c.id")) & (F.col(f"d.{hash_at}") == F.col("c.th")), "left")
    text, none = F.coalesce(F.col(f"d.{text_at}"), F.lit("")), F.array().cast(SPANS)
    parts = []
    for n, rule in enumerate(rules):
        spans = matches(text, narrowed(rule), n)
        parts.append(F.when(F.array_contains("c.rules", n), spans).otherwise(none) if required(rule.regex) else spans)
    kept = [F.col("d.`" + c.replace("`", "``") + "`") for c in documents.columns if c.lower() not in ADDED]
    out = joined.select(*kept, F.col(f"d.{text_at}").alias(text_at), F.sort_array(F.concat(*parts)).alias("spans"))
    redacted = F.when(F.size("spans") > 0, redact(F.col(text_at), F.col("spans"), mark)).otherwise(F.col(text_at))
    return out.withColumn("redacted", redacted).drop(text_at)


def spans_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
