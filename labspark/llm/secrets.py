"""Secret scan with an inverted trigram index.

Each rule's regular expression yields a Boolean trigram query (an OR of ANDs). Texts are posted under
the trigrams of these queries, by the hash of the text, so copies are posted once. Counting a text's
postings per clause intersects them; a text is a candidate of a rule if a clause has all its trigrams.
Only candidates are searched with the rule's expression. A rule without mandatory trigrams (hex
runs) is searched in every text.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import join_checked, written
from labspark.tables import fresh

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    import sre_parse

#: kind -> (regular expression, group that must be long enough, its least length); this order breaks ties.
BASE_RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
}
_PEM = r"PRIVATE\x20KEY-----"
#: After the first line of a key: all up to its END line, if no other line of five dashes comes before; without one,
#: headers and lines up to the last of base64. Possessive, so that long bodies need neither stack nor second tries.
_PEM_BODY = (r"(?:[^-]*+(?:-{1,4}[^-]++)*+-{5,9}END\x20[A-Z\x20]*" + _PEM
             + r"|(?:(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z-]+:\x20[^\n]*)++\n)?[A-Za-z0-9+/=\x20\t\r\n\\]*[A-Za-z0-9+/=]{40}"
             r"(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/=]+[\x20\t]*(?:\r?\n|$))?)?")
#: What the method adds.
MORE_RULES = {
    "private_key": (r"-----BEGIN\x20[A-Z\x20]*" + _PEM + _PEM_BODY, 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
}
RULES = {**BASE_RULES, **MORE_RULES}
_MAX_STRINGS = 64


def in_sql(pattern: str) -> str:
    """A rule's expression for engines without possessive repeats; what is possessive here has one way to match."""
    return pattern.replace("*+", "*").replace("++", "+")


def _with_trigrams(clauses: list[frozenset], strings: set[str]) -> list[frozenset]:
    """Each clause joined with the trigrams of each of the strings."""
    found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [a | b for a in clauses for b in found]


def _strings(tree) -> tuple[list[frozenset], set[str] | None]:
    """Of a parsed expression: clauses that any match meets (an OR of ANDs), and all its strings if few.

    With the strings known, the clauses are still empty; else the clauses hold what is mandatory.
    """
    clauses, run, whole = [frozenset()], {""}, True  # run: the possible strings since the last unknown part
    for op, arg in tree:
        name, inner, part = str(op), [frozenset()], None
        if name == "AT":
            continue
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "IN" and len(arg) <= 8 and all(str(kind) == "LITERAL" for kind, _ in arg):
            part = {chr(value).lower() for _, value in arg}
        elif name == "SUBPATTERN":
            inner, part = _strings(arg[3])
        elif name == "BRANCH":
            options = [_strings(option) for option in arg[1]]
            if all(strings is not None for _, strings in options):
                part = set().union(*[strings for _, strings in options])
            else:
                inner = [c for found, strings in options
                         for c in (found if strings is None else _with_trigrams(found, strings))]
        elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
            _, once = _strings(arg[2])
            part = None if once is None else once | {""}
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            inner, once = _strings(arg[2])
            inner = inner if once is None else _with_trigrams(inner, once)
        if part is not None and len(run) * len(part) <= _MAX_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        clauses = [a | b for a in _with_trigrams(clauses, run) for b in inner]
        run, whole = part or {""}, False
    return (clauses, run) if whole else (_with_trigrams(clauses, run), None)


def trigram_query(pattern: str) -> list[frozenset] | None:
    """An OR of ANDs of lower-case trigrams that every match contains; None if a match need contain none."""
    clauses, strings = _strings(sre_parse.parse(pattern))
    clauses = clauses if strings is None else _with_trigrams(clauses, strings)
    least = [c for c in set(clauses) if not any(d < c for d in clauses)]
    return None if frozenset() in least else sorted(least, key=sorted)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches that are long enough.

    The pieces between matches give the places: code points, end exclusive.
    """
    matches = F.regexp_extract_all(text, F.lit(f"(?:{pattern})" if not pattern.startswith("(?i)") else pattern), 0)
    tested = F.regexp_extract_all(text, F.lit(pattern), group)
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,long:boolean>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), tested.alias("t"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"),
            (F.length(x["t"]) >= least).alias("long")))).alias("out"))

    return F.filter(F.aggregate(zipped, state, add, lambda s: s["out"]), lambda s: s["long"])


def candidates(docs: DataFrame, rules=RULES) -> tuple[DataFrame, list[str]]:
    """(text hash, names of the rules whose trigram query the text meets), and the rules that scan fully."""
    queries = {kind: trigram_query(pattern) for kind, (pattern, _, _) in rules.items()}
    full = [kind for kind, q in queries.items() if q is None]
    clauses = [(kind, n, tri, len(clause)) for kind, q in queries.items() if q
               for n, clause in enumerate(q) for tri in sorted(clause)]
    trigrams = sorted({c[2] for c in clauses})
    text = F.coalesce("text", F.lit(""))
    lowered = docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
    posted = lowered.select("key", F.explode(F.array_compact(F.array(*[
        F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))).alias("trigram")).distinct()
    query = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed long")
    # the query table is fixed by the rules
    met = posted.join(F.broadcast(query), "trigram").groupBy("key", "kind", "clause", "needed").agg(
        F.count(F.lit(1)).alias("n")).where("n = needed")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds")), full  # at most one entry per rule


def scan(docs: DataFrame, rules=RULES, keep: list[str] | None = None, name: str = "found") -> DataFrame:
    """Add ``name``: array of (start, end, kind), by start, then the order of the rules.

    ``docs`` needs a text (null: empty); other columns stay (``keep`` names fewer; one called ``name`` is replaced). Each kind is searched
    on its own, so spans of different kinds may overlap. Empty tables and texts: no spans.
    """
    wanted, full = candidates(docs, rules)
    wanted = written(wanted, "candidates")
    columns = [c for c in keep or docs.columns if c != name]
    whole, key, kinds = fresh(docs, "_text", "_key", "_kinds")
    keyed = docs.withColumn(whole, F.coalesce("text", F.lit(""))).withColumn(key, F.xxhash64(whole))
    joined = join_checked(keyed, wanted.withColumnsRenamed({"key": key, "kinds": kinds}), key, "left", wanted.count())
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,long:boolean>>")
    found = []
    for kind, (pattern, group, least) in rules.items():
        # a rule without trigrams has its first test in place; the others were chosen by the index
        chosen = F.col(whole).rlike(pattern) if kind in full else F.array_contains(kinds, kind)
        found.append(F.when(chosen, _spans(F.col(whole), kind, pattern, group, least)).otherwise(empty))
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(rules) for x in (kind, i)])
    ranked = F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"),
                                                              s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select(*columns, F.transform(F.sort_array(ranked), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias(name))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced (overlapping spans by one mark); n_chars follows."""
    whole, spans = fresh(docs, "_whole", "_spans")
    hits = scan(docs.withColumn(whole, F.coalesce("text", F.lit(""))), rules, name=spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(s: Column, x: Column) -> Column:
        first = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(first, F.concat(
            s["out"], F.col(whole).substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
            ).otherwise(s["out"]).alias("out"))

    cleaned = F.aggregate(spans, start, cut, lambda s: F.concat(
        s["out"], F.col(whole).substr(s["at"] + 1, F.length(whole))))
    text = F.when(F.size(spans) > 0, cleaned).otherwise(F.col("text"))
    changed = hits.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(
            F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
