"""Entities, their status and their relations in a table of documents.

Span finding and the pairing of spans run in Python (Arrow batches, one small function per text), because greedy
non-overlap and match offsets have no built-in counterpart.  Status, pattern relations, order and counts
are DataFrame operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labspark import clinical_terms as ct
from labspark import schemas
from labspark.catalog import local_table
from labspark.functions.names import strip_blanks

#: Spans and characters of clauses that a Python worker holds as objects before it hands them over.
HELD_SPANS = 8_192
HELD_CHARS = 1 << 20


# ---------------------------------------------------------------------------------------
# Spans
# ---------------------------------------------------------------------------------------
class _Lexicon:
    """Terms and pattern rules as one engine that proposes and resolves entity spans.

    Every proposal is (rank, start, end): the place of its term or rule in the list of priorities.
    Terms are found by an Aho-Corasick automaton, which sees all occurrences in one pass whatever the
    number of terms.  Lower ranks win, then earlier places.
    """

    def __init__(self, terms: Sequence[tuple[str, str, str]],
                 rules: Sequence[tuple[str, str, str, str, float]], overlap: bool):
        ordered = list(terms) if overlap else sorted(terms, key=lambda t: -len(t[0]))
        self.terms = [t for t in ordered if t[0]]
        self.rules = [(re.compile(r[0]), *r[1:]) for r in rules]
        self.overlap = overlap
        ranks: dict[str, int] = {}
        for rank, (term, _, _) in enumerate(self.terms):
            ranks.setdefault(term, rank)
        self.automaton = ahocorasick.Automaton()
        for term, rank in ranks.items():
            self.automaton.add_word(term, (rank, len(term)))
        if ranks:
            self.automaton.make_automaton()
        self.any_terms = bool(ranks)

    def _proposals(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        if self.any_terms:
            found = [(rank, last + 1 - size, last + 1) for last, (rank, size) in self.automaton.iter(text)]
        for i, rule in enumerate(self.rules, len(self.terms)):
            found += [(i, *m.span()) for m in rule[0].finditer(text)]
        return sorted(found)

    def _described(self, text: str, rank: int, start: int, end: int) -> tuple:
        if rank < len(self.terms):
            term, kind, standard = self.terms[rank]
            return term, kind, start, end, standard, ct.TERM_CONFIDENCE
        pattern, kind, entity, standard, confidence = self.rules[rank - len(self.terms)]
        match = pattern.match(text, start)
        groups = match.groups(default="")
        parts = {"whole": match[0], "first": groups[0] if groups else match[0],
                 "core": groups[match.lastindex - 1] if (match.lastindex or 0) >= 2 else match[0]}
        return (entity.format(**parts), kind, start, end, standard.format(**parts), confidence)

    def spans(self, text: str) -> list[tuple]:
        """Accepted spans by place.

        With overlap only identical spans exclude each other; without, spans that share a character.
        """
        accepted: list[tuple[int, int, int]] = []
        kept: set[tuple[int, int]] = set()
        taken: list[int] = []  # starts and ends of accepted spans, in order
        for rank, start, end in self._proposals(text):
            if self.overlap:
                free = (start, end) not in kept
                kept.add((start, end))
            else:
                # free if the span lies between an end and the next start
                at = bisect_right(taken, start)
                free = at % 2 == 0 and (at == len(taken) or end <= taken[at])
                if free:
                    taken[at:at] = (start, end)
            if free:
                accepted.append((rank, start, end))
        found = [self._described(text, *span) for span in accepted]
        return sorted(found, key=itemgetter(2))


def _rules(patterns: Sequence[tuple[str, str, str]],
           sizes: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str, float]]:
    """Pattern rules as data: expression, type, how entity and standard name read, confidence."""
    named = [(p, kind, "{whole}", prefix + "_{core}", ct.PATTERN_CONFIDENCE)
             for p, kind, prefix in patterns]
    measured = [(p, "imaging_finding", "{first}" + unit, "lesion_size_{first}" + unit, ct.SIZE_CONFIDENCE)
                for p, unit in sizes]
    return named + measured


def _piece(marks: list[int], start: int, end: int) -> int:
    """Number of the piece between separators that holds [start, end), -1 when one is inside."""
    before = bisect_left(marks, start)
    return before if bisect_left(marks, end) == before else -1


class _Reader:
    """Cuts a text into clauses and sentences and places its spans in them."""

    def __init__(self, lexicon: _Lexicon, clause_separators: str, sentence_separators: str):
        self.lexicon = lexicon
        self.clause_mark = re.compile("[" + re.escape(clause_separators) + "]")
        self.sentence_mark = re.compile("[" + re.escape(sentence_separators) + "]")

    def clauses(self, body: str) -> tuple[list[tuple[int, str, list[tuple]]], list[int]]:
        """(clause number, clause, its spans with sentence number and place in the clause), and the sentence marks."""
        overlap = self.lexicon.overlap
        found = self.lexicon.spans(body)
        if not found:
            return [], []
        marks = [m.start() for m in self.clause_mark.finditer(body)]
        sentences = [m.start() for m in self.sentence_mark.finditer(body)]
        out: list[tuple[int, str, list[tuple]]] = []
        current, clause, first_at = -2, "", 0
        for span in found:
            entity, _, start, end, _, _ = span
            clause_no = _piece(marks, start, end)
            if clause_no < 0:
                clause = body if overlap else body[max(0, start - 10):end + 6]
                at = start if overlap else clause.find(entity)
            elif clause_no != current:
                left = marks[clause_no - 1] + 1 if clause_no else 0
                right = marks[clause_no] if clause_no < len(marks) else len(body)
                clause = body[left:right]
                if overlap:  # places count from the first occurrence of this text
                    first_at = body.find(clause)
                else:
                    clause = clause.strip()
            if clause_no < 0 or clause_no != current:
                out.append((clause_no, clause, []))
                current = clause_no if clause_no >= 0 else -2
            if clause_no >= 0:
                at = start - first_at if overlap else clause.find(entity)
                at = at if overlap or at >= 0 else len(clause) // 2
            out[-1][2].append((*span, _piece(sentences, start, end), at))
        return out, sentences


def _clause_batches(reader: _Reader, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`span_clauses` for batches of (key, text).

    Texts become Python strings one at a time, and what is found leaves as soon as there are HELD_SPANS spans or HELD_CHARS
    characters of it, so the memory of a worker does not follow the number of rows in a batch.
    """
    list_type = schema.field("spans").type
    span_fields = list(list_type.value_type)

    def packed(rows: list[tuple], spans: list[tuple], offsets: list[int]) -> pa.RecordBatch:
        items = pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*spans), span_fields)], fields=span_fields)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=list_type)],
            schema=schema)

    rows, spans, offsets, chars = [], [], [0], 0
    for batch in batches:
        for key, body in zip(batch.column(0), batch.column(1)):
            key, body = key.as_py(), body.as_py()
            if not body:
                continue
            for clause_no, clause, inside in reader.clauses(body)[0]:
                rows.append((key, clause_no, clause))
                spans += inside
                offsets.append(len(spans))
                chars += len(clause)
                if len(spans) >= HELD_SPANS or chars >= HELD_CHARS:
                    yield packed(rows, spans, offsets)
                    rows, spans, offsets, chars = [], [], [0], 0
    if rows:
        yield packed(rows, spans, offsets)


def span_clauses(docs: DataFrame, terms: Sequence[tuple[str, str, str]] | None = None,
                 patterns: Sequence[tuple[str, str, str]] | None = None,
                 doc_id: str = "doc_id", text: str = "text", overlap: bool = False,
                 sizes: Sequence[tuple[str, str]] = (),
                 clause_separators: str = ct.CLAUSE_SEPARATORS,
                 sentence_separators: str = ct.SENTENCE_SEPARATORS) -> DataFrame:
    """One row per clause that holds entities: its text once, and its entity spans.

    ``overlap=False`` keeps the longest term at every place; ``overlap=True`` keeps all
    occurrences.  ``in_clause_at`` is the place that status rules compare triggers with.  The
    rare span that crosses a clause separator gets a row of its own with ``clause_no`` -1 and
    its surroundings as the clause.
    """
    if terms is None:
        terms = ct.term_list(ct.CLINICAL_TERMS)
    if patterns is None:
        patterns = () if overlap else ct.CLINICAL_PATTERNS
    rules = _rules(() if overlap else patterns, sizes if overlap else ())
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        *schemas.struct(schemas.SPAN_CLAUSES).fields[1:]])
    arrow_schema = to_arrow_schema(schema)

    def clauses_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(_Lexicon(terms, rules, overlap), clause_separators, sentence_separators)
        return _clause_batches(reader, batches, arrow_schema)

    return docs.select(doc_id, text).mapInArrow(clauses_of, schema)


def spans_of(clauses: DataFrame) -> DataFrame:
    """One row per entity span."""
    return clauses.select("doc_id", "clause_no", F.inline("spans"))


def extract_spans(docs: DataFrame, *arguments, **options) -> DataFrame:
    """One row per entity span of the documents; takes what :func:`span_clauses` takes."""
    return spans_of(span_clauses(docs, *arguments, **options))


def in_reading_order(spans: DataFrame) -> DataFrame:
    """Add ``place``: the number of the entity in its document, by start (from 1)."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "entity")
    return spans.withColumn("place", F.row_number().over(order).cast("long"))


def by_confidence(triples: DataFrame) -> DataFrame:
    """Add ``place``: the rank of the triple in its document, most confident first."""
    order = Window.partitionBy("doc_id").orderBy(
        F.desc("confidence"), "subject_entity", "relation", "object_entity")
    return triples.withColumn("place", F.row_number().over(order).cast("long"))


# ---------------------------------------------------------------------------------------
# Clauses and sentences
# ---------------------------------------------------------------------------------------
def _separator_class(separators: str) -> str:
    return "[" + separators.replace("\n", "\\n") + "]"


def split_pieces(docs: DataFrame, separators: str = ct.CLAUSE_SEPARATORS, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Numbered non-blank pieces between separators, without surrounding blanks."""
    pieces = F.posexplode(F.split(F.col(text), _separator_class(separators), -1))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), pieces.alias("piece_no", "raw"))
        .withColumn("piece", strip_blanks(F.col("raw")))
        .filter(F.col("piece") != "")
    )


def piece_offsets(docs: DataFrame, separators: str = ct.CLAUSE_SEPARATORS,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their [start, end) in the text, in place: no shuffle."""
    cut = F.split(F.col(text), _separator_class(separators), -1)
    placed = F.aggregate(
        cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, raw: F.struct((acc["at"] + F.char_length(raw) + 1).alias("at"),
                                  F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"])
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(
            F.arrays_zip(placed.alias("start"), cut.alias("raw"))).alias("piece_no", "p"))
        .select("doc_id", "piece_no", F.col("p.start").alias("start"),
                (F.col("p.start") + F.char_length("p.raw")).alias("end"),
                strip_blanks(F.col("p.raw")).alias("piece"))
        .filter(F.col("piece") != "")
    )


# ---------------------------------------------------------------------------------------
# Status
# ---------------------------------------------------------------------------------------
def _places(text: str, words: Sequence[str]) -> list[Column]:
    """0-based first place of each word, null when absent."""
    return [F.nullif(F.instr(F.col(text), w), F.lit(0)) - 1 for w in words]


def _first_place(text: str, words: Sequence[str]) -> Column:
    return F.array_min(F.array(*_places(text, words)))


def entity_status(clauses: DataFrame, negation: Sequence[str] = tuple(ct.NEGATION_TRIGGERS),
                  uncertainty: Sequence[str] = tuple(ct.UNCERTAINTY_TRIGGERS),
                  history: Sequence[str] = tuple(ct.HISTORY_TRIGGERS)) -> DataFrame:
    """Spans of :func:`span_clauses` rows with negation, uncertainty and history marks.

    A negation or uncertainty trigger must start before the entity in its clause; a history
    trigger may be on either side within half the clause (at least 15 characters).  Triggers
    are searched once per clause, and nothing is shuffled.
    """
    # a select of its own: beside an explode, columns are computed for every exploded row
    searched = clauses.select(
        "doc_id", "clause_no", "spans", F.char_length("clause").alias("__len"),
        _first_place("clause", negation).alias("__negation"),
        _first_place("clause", uncertainty).alias("__uncertainty"),
        F.array_compact(F.array(*_places("clause", history))).alias("__history")
    ).select("doc_id", "clause_no", "__len", "__negation", "__uncertainty", "__history", F.explode("spans").alias("s"))
    at = F.col("s.in_clause_at")
    reach = F.greatest(F.floor(F.col("__len") / 2), F.lit(15))
    return searched.select(
        "doc_id", "clause_no", "s.*",
        F.coalesce(F.col("__negation") < at, F.lit(False)).alias("negation_status"),
        F.coalesce(F.col("__uncertainty") < at, F.lit(False)).alias("uncertain_status"),
        F.exists("__history", lambda p: F.abs(p - at) <= reach).alias("history_status"))


def note_status(clauses: DataFrame, negation: Sequence[str] = tuple(ct.NOTE_NEGATION_TRIGGERS),
                history: Sequence[str] = tuple(ct.NOTE_HISTORY_TRIGGERS)) -> DataFrame:
    """Second status variant: flagged entities only, with the deciding trigger and the clause.

    The first listed trigger found before the entity decides.
    """
    def found(words: Sequence[str]) -> Column:
        return F.filter(F.array(*[
            F.struct(F.lit(w).alias("word"), place.alias("at"))
            for w, place in zip(words, _places("clause", words))]),
            lambda p: p["at"].isNotNull())

    def first(places: str, limit: Column) -> Column:
        return F.get(F.filter(places, lambda p: p["at"] < limit), F.lit(0))

    # a select of its own: beside an explode, columns are computed for every exploded row
    searched = clauses.select(
        "doc_id", "clause_no", "clause", "spans", found(negation).alias("__negation"),
        found(history).alias("__history"))
    # across a whole text (span over a separator, alone in its row) a stronger separator in between cancels
    across = F.get("spans", F.lit(0))["in_clause_at"]
    from_ = first("__negation", across)["at"]
    between = F.substring(F.col("clause"), from_ + 1, F.greatest(across - from_, F.lit(0)))
    exploded = searched.select(
        "doc_id", strip_blanks(F.col("clause")).alias("source_sentence"), "spans", "__negation", "__history",
        F.when(F.col("clause_no") < 0, F.coalesce(between.rlike("[。；]"), F.lit(False))).otherwise(
            F.lit(False)).alias("__cancelled")
    ).select("doc_id", "source_sentence", "__negation", "__history", "__cancelled", F.explode("spans").alias("s"))
    at = F.col("s.in_clause_at")
    marked = exploded.withColumns({
        "__n": first("__negation", at)["word"],
        "__h": first("__history", at + F.char_length("s.entity"))["word"]})
    return (
        marked.withColumn("negation_trigger", F.when(~F.col("__cancelled"), F.col("__n")))
        .filter(F.col("negation_trigger").isNotNull() | F.col("__h").isNotNull())
        .select("doc_id", "s.entity", "s.entity_type", "s.start", "s.end", "s.standard_name",
                F.col("negation_trigger").isNotNull().alias("negation_status"),
                F.col("__h").isNotNull().alias("history_status"),
                "source_sentence", "negation_trigger", F.col("__h").alias("history_trigger"))
    )


# ---------------------------------------------------------------------------------------
# Triples
# ---------------------------------------------------------------------------------------
class _Pairing:
    """Finds the related names of one text by a sweep over the mentions of each sentence."""

    def __init__(self, relations: dict, negation: Sequence[str], located: str):
        self.relations = [(i, name, tuple(words), types) for i, (name, (words, types)) in enumerate(relations.items())]
        self.negation, self.located = tuple(negation), located
        self.kinds = {k for _, _, _, types in self.relations for pair in types for k in pair}

    def triples(self, body: str, reader: _Reader) -> list[tuple]:
        """(subject, subject entity, relation, object, object entity, confidence, sentence, first place), each once."""
        clauses, marks = reader.clauses(body)
        sentences: dict[int, list[tuple]] = {}
        for i, (_, _, spans) in enumerate(clauses):
            for entity, kind, start, _, standard, _, sentence_no, at in spans:
                if sentence_no >= 0 and kind in self.kinds:
                    sentences.setdefault(sentence_no, []).append((kind, entity, standard, start, i, at))
        best: dict[tuple, tuple] = {}
        negated: dict[int, int] = {}
        for number, mentions in sorted(sentences.items()):
            left = marks[number - 1] + 1 if number else 0
            right = marks[number] if number < len(marks) else len(body)
            open_ = self._open(body[left:right].strip(), {m[0] for m in mentions})
            if not open_:
                continue
            # distinct names with their first and last place: what the pairs are made of
            names: dict[str, dict[tuple, list[int]]] = {}
            for kind, entity, standard, start, i, at in mentions:
                if i not in negated:
                    places = [p for p in map(clauses[i][1].find, self.negation) if p >= 0]
                    negated[i] = min(places, default=len(body))
                places = names.setdefault(kind, {}).setdefault((entity, standard, negated[i] < at), [start, start])
                places[0], places[1] = min(places[0], start), max(places[1], start)
            for confidence, relation_no, name, types in open_:
                for s_kind, o_kind in types:
                    for s, (s_first, s_last) in names.get(s_kind, {}).items():
                        for o, (o_first, o_last) in names.get(o_kind, {}).items():
                            if (s[2] or o[2]) if name == self.located else (s[2] and o[2]):
                                continue
                            near, far = min(s_first, o_first), max(s_last, o_last)
                            if s_kind == o_kind:  # the earlier mention is the subject
                                if s_first >= o_last:
                                    continue
                                near, far = s_first, o_last
                            found = ((number, near, far, relation_no), s[1], o[1], confidence)
                            key = (s[0], name, o[0])
                            if key not in best or found < best[key]:
                                best[key] = found
        return [(subject, s, name, obj, o, confidence, order[0], order[1], order[2], order[3])
                for (s, name, o), (order, subject, obj, confidence) in best.items()]

    def _open(self, sentence: str, kinds: set[str]) -> list[tuple]:
        """(confidence, number, name, type pairs) of the relations that the sentence may hold."""
        short = len(sentence.replace(" ", "")) <= ct.SHORT_SENTENCE
        open_ = []
        for number, name, words, types in self.relations:
            types = [t for t in types if t[0] in kinds and t[1] in kinds]
            if types:
                if any(w in sentence for w in words):
                    open_.append((ct.TRIGGER_CONFIDENCE, number, name, types))
                elif short:
                    open_.append((ct.SHORT_CONFIDENCE, number, name, types))
        return open_


def extract_triples(docs: DataFrame, terms: Sequence[tuple[str, str, str]] | None = None,
                    patterns: Sequence[tuple[str, str, str]] | None = None, relations: dict | None = None,
                    negation: Sequence[str] = tuple(ct.NEGATION_TRIGGERS), located: str = ct.LOCATED,
                    clause_separators: str = ct.CLAUSE_SEPARATORS, sentence_separators: str = ct.SENTENCE_SEPARATORS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Relations between entities of one sentence, each once per document; documents are read once.

    The pass that finds spans also pairs them: a sentence without a trigger that is not short is left before any pair
    is made, and mentions are first reduced to distinct names, so a name repeated a thousand times is one name
    with its first and last place. A text gives each triple once; only those are grouped by document, for rows that
    share a doc_id.
    """
    if terms is None:
        terms = ct.term_list(ct.CLINICAL_TERMS)
    rules = _rules(ct.CLINICAL_PATTERNS if patterns is None else patterns, ())
    relations = relations or ct.RELATIONS
    key = docs.schema[doc_id].dataType
    fields = [("doc_id", key), *[(n, T.StringType()) for n in (
        "subject", "subject_entity", "relation", "object", "object_entity")], ("confidence", T.DoubleType()),
        *[(n, T.IntegerType()) for n in ("sentence_no", "first_at", "last_at", "relation_no")]]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    arrow_schema = to_arrow_schema(schema)

    def triples_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(_Lexicon(terms, rules, False), clause_separators, sentence_separators)
        pairing = _Pairing(relations, negation, located)
        for batch in batches:
            rows = [(k, *triple) for k, body in zip(batch.column(0).to_pylist(), batch.column(1)) if body.is_valid
                    for triple in pairing.triples(body.as_py(), reader)]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    order = F.struct("sentence_no", "first_at", "last_at", "relation_no")
    found = docs.select(doc_id, text).mapInArrow(triples_of, schema)
    return (
        found.groupBy("doc_id", "subject_entity", "relation", "object_entity")
        .agg(F.min(F.struct(order.alias("o"), "subject", "object", "confidence")).alias("w"))
        .select("doc_id", F.col("w.subject").alias("subject"), "subject_entity", "relation",
                F.col("w.object").alias("object"), "object_entity",
                F.col("w.confidence").alias("confidence"),
                F.col("w.o.sentence_no").alias("sentence_no"), F.col("w.o.first_at").alias("first_at"))
    )


def _labelled(pairs: Column, relation: str) -> Column:
    return F.transform(pairs, lambda z: F.struct(
        z["s"].alias("subject"), F.lit(relation).alias("relation"), z["o"].alias("object")))


def pattern_triples(docs: DataFrame, terms: Sequence[tuple[str, str, str]] | None = None,
                    relations: Sequence[tuple[str, str, bool]] | None = None,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Relations by pattern: first and last group are subject and object (or reversed).

    Short words with digits are left out; each (subject, relation, object) once per document.
    """
    relations = relations or ct.NOTE_RELATIONS
    terms = terms or ct.term_list(ct.NOTE_TERMS)
    # (?dU): '.' stops only at a newline, classes are Unicode
    found = []
    for relation, pattern, reverse in relations:
        last = re.compile(pattern).groups
        left = F.regexp_extract_all(F.col(text), F.lit("(?dU)" + pattern), F.lit(1))
        right = F.regexp_extract_all(F.col(text), F.lit("(?dU)" + pattern), F.lit(last))
        subject, obj = (right, left) if reverse else (left, right)
        found.append(_labelled(F.arrays_zip(subject.alias("s"), obj.alias("o")), relation))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.inline(F.concat(*found)))

    def plain(word: str) -> Column:
        return ~(F.col(word).rlike(r"(?U)\d") & (F.char_length(word) <= 3))

    standard = local_table(
        docs.sparkSession, [(t, s) for t, _, s in terms],
        "term string, standard string")
    named = rows.filter(plain("subject") & plain("object")).distinct()
    for word in ("subject", "object"):
        named = (
            named.join(standard, F.col(word) == F.col("term"), "left")
            .withColumn(f"{word}_standard", F.coalesce("standard", word))
            .drop("term", "standard")
        )
    return named.withColumn("confidence", F.lit(ct.NOTE_CONFIDENCE))


# ---------------------------------------------------------------------------------------
# Whole-document jobs and summaries
# ---------------------------------------------------------------------------------------
def analyze_clinical(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(entities with status, triples) of every document."""
    entities = entity_status(span_clauses(docs, **columns))
    return entities, extract_triples(docs, **columns)


def analyze_notes(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, triples, flagged entities) by the second variant."""
    clauses = span_clauses(docs, ct.term_list(ct.NOTE_TERMS), overlap=True, sizes=ct.NOTE_SIZES,
                           clause_separators=ct.NOTE_SEPARATORS, **columns)
    return spans_of(clauses), pattern_triples(docs, **columns), note_status(clauses)


def document_summary(docs: DataFrame, entities: DataFrame, triples: DataFrame,
                     doc_id: str = "doc_id") -> DataFrame:
    """Entity, status and triple counts per document, zeros included."""
    per_entity = entities.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entity_count"),
        F.count_if("negation_status").alias("negation_count"),
        F.count_if("uncertain_status").alias("uncertain_count"),
        F.count_if("history_status").alias("history_count"))
    per_triple = triples.groupBy("doc_id").agg(F.count(F.lit(1)).alias("triple_count"))
    counts = ["entity_count", "negation_count", "uncertain_count", "history_count",
              "triple_count"]
    return (
        docs.select(F.col(doc_id).alias("doc_id"))
        .join(per_entity, "doc_id", "left").join(per_triple, "doc_id", "left")
        .select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )


def type_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
