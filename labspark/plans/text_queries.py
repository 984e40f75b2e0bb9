"""Registered queries over documents.

The tables hold invented prose, so the dictionaries here are made of its syllables; the clinical
dictionaries run over the same documents in ``clinical_notes_summary``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark import clinical_terms as ct
from labspark import schemas
from labspark.operators import fusion, learning, text
from labspark.plans.registry import ORACLE, query, spread, table, values_sql
from labspark.sources import readers

# Term dictionary, triggers and separators of these queries.
TERMS = [
    ("ention", "disease_or_lesion", "t_ention"), ("tion", "disease_or_lesion", "t_tion"),
    ("there", "anatomical_site", "t_there"), ("heon", "anatomical_site", "t_heon"),
    ("und", "drug", "t_und"), ("que", "examination", "t_que"), ("ing", "symptom", "t_ing"),
    ("eau", "imaging_finding", "t_eau"),
]
NEGATION, UNCERTAINTY, HISTORY = ["not", "hat ", "que"], ["with", "von"], ["was", "les", "ha"]
CLAUSES, SENTENCES = ".\n,;", ".\n"
RELATIONS = {
    "位于": (["the ", "la "], [("disease_or_lesion", "anatomical_site"),
                             ("imaging_finding", "anatomical_site")]),
    "治疗": (["der", "re"], [("drug", "disease_or_lesion"), ("drug", "symptom")]),
    "提示": (["on", "an "], [("examination", "disease_or_lesion"),
                            ("examination", "imaging_finding")]),
    "伴有": (["er ", "es "], [("disease_or_lesion", "disease_or_lesion"),
                             ("disease_or_lesion", "symptom")]),
}
_BY_LENGTH = sorted(TERMS, key=lambda t: -len(t[0]))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = text.span_clauses(
        _docs(spark, sf_dir), TERMS, (), clause_separators=CLAUSES,
        sentence_separators=SENTENCES)
    return text.entity_status(clauses, NEGATION, UNCERTAINTY, HISTORY)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.extract_triples(
        _docs(spark, sf_dir), TERMS, (), RELATIONS, NEGATION, clause_separators=CLAUSES,
        sentence_separators=SENTENCES)


# SQL side: the longest term is cut out first and masked, so shorter terms cannot overlap it.
def _spans_sql(source: str, key: str) -> str:
    """Entity spans of column s of ``source`` by successive masking; start is 0-based."""
    steps, parts, current = [], [], source
    for i, (term, kind, standard) in enumerate(_BY_LENGTH):
        steps.append(
            f"x{i} AS (SELECT {key}, unnest(string_split(s, '{term}')) AS piece, "
            f"generate_subscripts(string_split(s, '{term}'), 1) AS k, "
            f"len(string_split(s, '{term}')) AS parts FROM {current} WHERE contains(s, '{term}'))")
        parts.append(
            f"SELECT * EXCLUDE (parts, k) FROM (SELECT {key}, '{term}' AS entity, "
            f"'{kind}' AS entity_type, '{standard}' AS standard_name, CAST(sum(length(piece)) OVER "
            f"(PARTITION BY {key} ORDER BY k) + (k - 1) * {len(term)} AS INTEGER) AS start, "
            f"parts, k FROM x{i}) WHERE k < parts")
        steps.append(
            f"m{i} AS (SELECT * REPLACE (replace(s, '{term}', repeat(chr(1), {len(term)})) AS s) "
            f"FROM {current})")
        current = f"m{i}"
    return ", ".join(steps) + ", spans AS (" + " UNION ALL ".join(parts) + ")"


@query("text_entities", f"""
WITH d AS (SELECT doc_id, text AS s FROM documents), {_spans_sql('d', 'doc_id')}
SELECT doc_id, entity, entity_type, standard_name, start,
  CAST(start + length(entity) AS INTEGER) AS "end" FROM spans""")
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entities with offsets, longest first, without overlap."""
    return text.extract_spans(_docs(spark, sf_dir), TERMS, ()).select(
        "doc_id", "entity", "entity_type", "standard_name", "start", "end")


@query("text_entities_overlapping", " UNION ALL ".join(f"""
SELECT doc_id, '{t}' AS entity, '{k}' AS entity_type, count(*) - 1 AS n FROM (
  SELECT doc_id, unnest(string_split(text, '{t}')) FROM documents) GROUP BY 1
HAVING count(*) > 1""" for t, k, _ in TERMS))
def text_entities_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity counts of the variant that keeps overlapping terms."""
    spans = text.extract_spans(_docs(spark, sf_dir), TERMS, overlap=True)
    return spans.groupBy("doc_id", "entity", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def _trigger_sql(words: list[str], test: str) -> str:
    return "(" + " OR ".join(
        f"(contains(clause, '{w}') AND {test.format(at=f'''(strpos(clause, '{w}') - 1)''')})"
        for w in words) + ")"


_status_sql = f"""c AS (
  SELECT doc_id, cid, raw AS s, length(raw) AS len, sentence_no,
    regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS clause
  FROM (
    SELECT doc_id, sentence_no, unnest(regexp_split_to_array(sentence, '[,;]')) AS raw,
      sentence_no * 100000 + generate_subscripts(regexp_split_to_array(sentence, '[,;]'), 1) AS cid
    FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS sentence,
        generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) - 1 AS sentence_no
      FROM documents))),
{_spans_sql('c', 'doc_id, cid, clause, sentence_no')},
e AS (
  SELECT *, {_trigger_sql(NEGATION, '{at} < pos')} AS negation_status,
    {_trigger_sql(UNCERTAINTY, '{at} < pos')} AS uncertain_status,
    {_trigger_sql(HISTORY, 'abs({at} - pos) <= greatest(length(clause) // 2, 15)')}
      AS history_status
  FROM (SELECT *, strpos(clause, entity) - 1 AS pos FROM spans))"""


@query("text_status", f"""
WITH {_status_sql}
SELECT doc_id, entity, count(*) AS n, count(*) FILTER (WHERE negation_status) AS n_negated,
  count(*) FILTER (WHERE uncertain_status) AS n_uncertain,
  count(*) FILTER (WHERE history_status) AS n_history
FROM e GROUP BY 1, 2""")
def text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negated, uncertain and past mentions per document and entity."""
    return _status(spark, sf_dir).groupBy("doc_id", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("negation_status").alias("n_negated"),
        F.count_if("uncertain_status").alias("n_uncertain"),
        F.count_if("history_status").alias("n_history"))


_pairs_sql = " UNION ALL ".join(
    f"SELECT '{name}' AS relation, '{s}' AS st, '{o}' AS ot, "
    + " OR ".join(f"contains(sentence, '{w}')" for w in words) + " AS told, x.* FROM x"
    for name, (words, pairs) in RELATIONS.items() for s, o in pairs)


@query("text_triples", f"""
WITH {_status_sql},
sen AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS sentence,
          generate_subscripts(regexp_split_to_array(text, '[.\\n]'), 1) - 1 AS sentence_no
        FROM documents),
m AS (SELECT *, cid * 1000000 + start AS place FROM e),
names AS (SELECT doc_id, sentence_no, entity, entity_type, standard_name, negation_status,
            min(place) AS f, max(place) AS l FROM m GROUP BY ALL),
x AS (SELECT a.doc_id, a.sentence_no, a.entity AS subject_entity, b.entity AS object_entity,
        a.standard_name AS subject, b.standard_name AS object, a.entity_type AS aty,
        b.entity_type AS bty, a.negation_status AS an, b.negation_status AS bn,
        a.f AS af, b.l AS bl, sen.sentence
      FROM names a JOIN names b USING (doc_id, sentence_no) JOIN sen USING (doc_id, sentence_no)),
t AS (SELECT *, CASE WHEN told THEN CAST(0.88 AS DOUBLE)
        WHEN length(replace(trim(sentence), ' ', '')) <= 15 THEN CAST(0.72 AS DOUBLE) END
        AS confidence
      FROM ({_pairs_sql})
      WHERE aty = st AND bty = ot AND (st <> ot OR af < bl) AND NOT (an AND bn)
        AND NOT (relation = '{ct.LOCATED}' AND (an OR bn)))
SELECT doc_id, subject_entity, relation, object_entity, any_value(subject) AS subject,
  any_value(object) AS object, arg_min(confidence, sentence_no) AS confidence,
  min(sentence_no) AS sentence_no
FROM t WHERE confidence IS NOT NULL GROUP BY 1, 2, 3, 4""")
def text_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between entities of one sentence, once per document."""
    triples = _triples(spark, sf_dir)
    return triples.select(
        "doc_id", "subject_entity", "relation", "object_entity", "subject", "object",
        "confidence", "sentence_no")


@query("text_clauses", """
WITH raw AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n,;]')) AS raw,
    generate_subscripts(regexp_split_to_array(text, '[.\n,;]'), 1) AS k FROM documents),
p AS (SELECT doc_id, k, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS p, length(raw) AS n,
    sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) - 1 AS start FROM raw)
SELECT doc_id, count(*) AS n_pieces, CAST(sum(length(p)) AS BIGINT) AS n_chars,
  max(length(p)) AS longest, CAST(sum(start) AS BIGINT) AS sum_start,
  CAST(max(start + n) AS INTEGER) AS last_end FROM p WHERE p <> '' GROUP BY 1""")
def text_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause counts, lengths and places."""
    pieces = text.piece_offsets(_docs(spark, sf_dir), CLAUSES)
    return pieces.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum(F.char_length("piece")).alias("n_chars"),
        F.max(F.char_length("piece")).alias("longest"), F.sum("start").alias("sum_start"),
        F.max("end").alias("last_end"))


PATTERN_RELATIONS = [
    ("near", r"(tion|ing) .{0,12}(the|de) [^\s.]{0,10}(and|es)", True),
    ("state", r"(und|que).{0,8}(der|le|en)", False),
]


@query("text_pattern_triples", r"""
WITH r AS (
  SELECT doc_id, unnest(regexp_extract_all(text, p1, 3)) AS subject, 'near' AS relation,
    unnest(regexp_extract_all(text, p1, 1)) AS object
  FROM documents, (SELECT '(tion|ing) [^\n]{0,12}(the|de) [^\s.]{0,10}(and|es)' AS p1)
  UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(text, p2, 1)), 'state',
    unnest(regexp_extract_all(text, p2, 2))
  FROM documents, (SELECT '(und|que)[^\n]{0,8}(der|le|en)' AS p2))
SELECT DISTINCT doc_id, subject, relation, object,
  CASE WHEN subject IN ('tion', 'ing', 'und', 'que') THEN 't_' || subject ELSE subject END
    AS subject_standard,
  CASE WHEN object IN ('tion', 'ing', 'und', 'que') THEN 't_' || object ELSE object END
    AS object_standard, CAST(0.92 AS DOUBLE) AS confidence
FROM r""")
def text_pattern_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations found by pattern, subject and object in either order."""
    return text.pattern_triples(_docs(spark, sf_dir), TERMS, PATTERN_RELATIONS)


@query("text_summary", f"""
WITH {_status_sql},
s AS (SELECT doc_id, count(*) AS entity_count,
        count(*) FILTER (WHERE negation_status) AS negation_count,
        count(*) FILTER (WHERE uncertain_status) AS uncertain_count,
        count(*) FILTER (WHERE history_status) AS history_count FROM e GROUP BY 1),
triples AS (SELECT doc_id, count(*) AS triple_count FROM ({ORACLE['text_triples']}) GROUP BY 1)
SELECT doc_id, coalesce(entity_count, 0) AS entity_count,
  coalesce(negation_count, 0) AS negation_count, coalesce(uncertain_count, 0) AS uncertain_count,
  coalesce(history_count, 0) AS history_count, coalesce(triple_count, 0) AS triple_count
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN triples USING (doc_id)""")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity, status and triple counts of every document, zeros included."""
    docs, entities = _docs(spark, sf_dir), _status(spark, sf_dir)
    triples = _triples(spark, sf_dir)
    return text.document_summary(docs, entities, triples).select(
        "doc_id", "entity_count", "negation_count", "uncertain_count", "history_count", "triple_count")


@query("text_entities_ranked", f"""
WITH d AS (SELECT doc_id, text AS s FROM documents), {_spans_sql('d', 'doc_id')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS place, entity, start
FROM spans""")
def text_entities_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every document in reading order."""
    return text.in_reading_order(text.extract_spans(_docs(spark, sf_dir), TERMS, ())).select(
        "doc_id", "place", "entity", "start")


@query("text_type_distribution", f"""
WITH d AS (SELECT doc_id, text AS s FROM documents), {_spans_sql('d', 'doc_id')}
SELECT entity_type, count(*) AS n FROM spans GROUP BY 1""")
def text_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.type_distribution(text.extract_spans(_docs(spark, sf_dir), TERMS, ()))


@query("text_case_flags", f"""
WITH {_status_sql}
SELECT doc_id AS case_id, count(*) FILTER (WHERE negation_status) AS negation_count,
  CASE WHEN bool_or(negation_status) THEN TRUE END AS has_negated_finding,
  NOT arg_min(negation_status, CASE WHEN standard_name = 't_heon' THEN cid * 1000000 + start END)
    AS distant_metastasis
FROM e GROUP BY 1""")
def text_case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negation features per case; one term plays the part of distant metastasis."""
    entities = _status(spark, sf_dir).withColumnRenamed("doc_id", "case_id").withColumn(
        "standard_name", F.when(F.col("standard_name") == "t_heon", "distant_metastasis")
        .otherwise(F.col("standard_name")))
    return fusion.nlp_flags(entities)


def _note_sql() -> str:
    """Every occurrence of every term per line, and the first listed trigger before it."""
    def trigger(words: list[str], limit: str) -> str:
        return "CASE " + " ".join(
            f"WHEN contains(clause, '{w}') AND strpos(clause, '{w}') - 1 < {limit} THEN '{w}'"
            for w in words) + " END"

    spans = " UNION ALL ".join(f"""
SELECT doc_id, '{t}' AS entity, clause, first_at, line_start + {len(t)} * (i - 1)
    + list_sum(list_transform(ps[1:i], lambda x: length(x))) AS start
FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM (
  SELECT *, string_split(clause, '{t}') AS ps FROM lines WHERE contains(clause, '{t}')))"""
                               for t, _, _ in TERMS)
    return f"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS clause,
    generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
lines AS (
  SELECT doc_id, clause, strpos(text, clause) - 1 AS first_at,
    sum(length(clause) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(clause) - 1 AS line_start
  FROM cut),
spans AS ({spans}),
marked AS (
  SELECT *, {trigger(NEGATION, "start - first_at")} AS negation_trigger,
    {trigger(HISTORY, "start - first_at + length(entity)")} AS history_trigger FROM spans)
SELECT doc_id, entity, negation_trigger, history_trigger, count(*) AS n,
  CAST(min(start) AS INTEGER) AS first_start
FROM marked WHERE negation_trigger IS NOT NULL OR history_trigger IS NOT NULL GROUP BY 1, 2, 3, 4"""


@query("note_status", _note_sql())
def note_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second status variant: flagged entities with the deciding triggers."""
    docs = _docs(spark, sf_dir)
    clauses = text.span_clauses(docs, TERMS, overlap=True, clause_separators="\n")
    flagged = text.note_status(clauses, NEGATION, HISTORY)
    return flagged.groupBy("doc_id", "entity", "negation_trigger", "history_trigger").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


# Notes with clinical terms, sizes, triggers and relations, and their counts: entities, negated,
# uncertain, past, relations.
NOTES = [
    ("右肺上叶见肺结节，大小约15mm，提示肺癌可能。", 4, 0, 0, 0, 3),
    ("患者否认高血压、糖尿病，无发热。", 3, 3, 0, 0, 0),
    ("既往有冠心病病史，长期服用阿司匹林。", 2, 0, 0, 1, 1),
    ("未见远处转移。", 1, 1, 0, 0, 0),
    ("普通文字，没有术语。", 0, 0, 0, 0, 0),
]


@query("clinical_notes_summary", f"""
SELECT doc_id, entity_count, negation_count, uncertain_count, history_count, triple_count
FROM documents JOIN {values_sql([(i, *n[1:]) for i, n in enumerate(NOTES)],
                                "note, entity_count, negation_count, uncertain_count, history_count, triple_count")}
  ON note = doc_id % {len(NOTES)}""")
def clinical_notes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clinical dictionaries, patterns and relations: every document gets one of the notes."""
    note = F.element_at(F.array(*[F.lit(n[0]) for n in NOTES]), (F.col("doc_id") % len(NOTES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", note.alias("text"))
    entities, triples = text.analyze_clinical(docs)
    return text.document_summary(docs, entities, triples).select(
        "doc_id", "entity_count", "negation_count", "uncertain_count", "history_count", "triple_count")


@query("dialogue_counts", r"""
SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS skipped FROM (
  SELECT regexp_replace(text, '\s', '', 'g') <> '' AND turn > 0 AS kept FROM conversations)""")
def dialogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and skipped dialogue records, parsed from keyed JSON texts."""
    record = F.struct(F.col("text").alias("self_report"), F.when(
        F.col("turn") > 0, F.col("role")).otherwise(" ").alias("diagnosis"))
    key = F.concat_ws("-", "conv_id", "turn")
    texts = table(spark, sf_dir, "conversations").select(
        F.to_json(F.create_map(key, record)).alias("value"))
    return readers.dialogue_counts(readers.dialogues(
        readers.parse_keyed_json(texts, schemas.DIALOGUE, "record_id")))


@query("text_triples_ranked", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id
    ORDER BY confidence DESC, subject_entity, relation, object_entity) AS place,
  subject_entity, relation, object_entity, confidence FROM ({ORACLE['text_triples']})""")
def text_triples_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of every document, the most confident first."""
    triples = _triples(spark, sf_dir)
    return text.by_confidence(triples).select(
        "doc_id", "place", "subject_entity", "relation", "object_entity", "confidence")


@query("class_distribution", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.class_balance(table(spark, sf_dir, "documents"), "lang")
