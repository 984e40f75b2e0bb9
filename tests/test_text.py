import itertools
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from labspark import clinical_terms as ct
from labspark import schemas
from labspark.operators import text

NOTE = ("患者既往有高血压病史5年，规律服用阿司匹林。昨日复查CT示：右肺上叶可见一大小约12mm的肺结节，"
        "未见明显远处转移，不考虑肺癌，建议随访。")


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans_of(df):
    return [(r["entity"], r["start"], r["end"], r["entity_type"], r["standard_name"],
             r["confidence"]) for r in df.orderBy("doc_id", "start").collect()]


def test_entities_golden(spark):
    docs = docs_of(spark, "右肺上叶可见一大小约12mm的肺结节")
    assert spans_of(text.extract_spans(docs)) == [
        ("右肺上叶", 0, 4, "anatomical_site", "right_upper_lobe", 0.95),
        ("大小约12mm", 7, 14, "imaging_finding", "lesion_size_mm", 0.80),
        ("肺结节", 15, 18, "disease_or_lesion", "lung_nodule", 0.95)]


def test_later_type_of_a_repeated_term_wins(spark):
    assert spans_of(text.extract_spans(docs_of(spark, "淋巴结肿大")))[0][3] == "imaging_finding"


def test_spans_never_overlap(spark):
    terms = [("ab", "t", "AB"), ("abc", "t", "ABC"), ("bca", "t", "BCA"), ("aa", "t", "AA"),
             ("c", "t", "C")]
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc \n") for _ in range(60)) for _ in range(30)]
    found = text.extract_spans(docs_of(spark, *texts), terms, ()).collect()
    for i, body in enumerate(texts):
        # brute force: longest first, all places, no shared character
        taken, want = set(), set()
        for term in sorted([t for t, _, _ in terms], key=lambda t: -len(t)):
            for at in range(len(body)):
                place = set(range(at, at + len(term)))
                if body.startswith(term, at) and not place & taken:
                    taken |= place
                    want.add((at, at + len(term)))
        assert {(r["start"], r["end"]) for r in found if r["doc_id"] == i} == want
    for r in found:
        body = texts[r["doc_id"]]
        assert r["clause_no"] == body[:r["start"]].count("\n")


@pytest.mark.parametrize("body,entity,negated,uncertain,history", [
    ("未见明显远处转移", "远处转移", True, False, False),
    ("不考虑肺癌", "肺癌", True, True, False),
    ("患者既往有高血压病史5年", "高血压", False, False, True),
    ("肺癌，无发热", "肺癌", False, False, False),
    ("肺癌，无发热", "发热", True, False, False)])
def test_status_golden(spark, body, entity, negated, uncertain, history):
    docs = docs_of(spark, body)
    terms = [(entity, "x", "x")]
    got = text.entity_status(text.span_clauses(docs, terms, ())).first()
    assert (got["negation_status"], got["uncertain_status"], got["history_status"]) == (
        negated, uncertain, history)


def test_status_matches_brute_force(spark):
    rng = random.Random(11)
    words = ["肺癌", "发热", "无", "未见", "可能", "既往", "术后", "，", "。", "\n", " ", "x" * 9, "自"]
    texts = ["".join(rng.choice(words) for _ in range(40)) for _ in range(25)]
    docs = docs_of(spark, *texts)
    got = text.entity_status(text.span_clauses(docs)).collect()
    assert len(got) > 50
    for r in got:
        body = texts[r["doc_id"]]
        context = None
        at = 0
        for piece in re.split("[" + ct.CLAUSE_SEPARATORS + "]", body):
            if at <= r["start"] and r["end"] <= at + len(piece):
                context = piece.strip()
            at += len(piece) + 1
        if context is None:
            context = body[max(0, r["start"] - 10):r["end"] + 6]
        where = context.find(r["entity"])
        where = where if where >= 0 else len(context) // 2

        def before(triggers):
            return any(0 <= context.find(t) < where for t in triggers)

        near = any(t in context and abs(context.find(t) - where) <= max(len(context) // 2, 15)
                   for t in ct.HISTORY_TRIGGERS)
        assert r["negation_status"] == before(ct.NEGATION_TRIGGERS)
        assert r["uncertain_status"] == before(ct.UNCERTAINTY_TRIGGERS)
        assert r["history_status"] == near


def triples_of(df):
    return [(r["subject"], r["relation"], r["object"], r["confidence"]) for r in
            sorted(df.collect(), key=lambda r: (
                r["doc_id"], -r["confidence"], r["sentence_no"], r["first_at"]))]


def test_triples_golden(spark):
    docs = docs_of(spark, "CT示右肺上叶肺结节")
    _, triples = text.analyze_clinical(docs)
    assert triples_of(triples) == [
        ("ct_scan", "提示", "lung_nodule", 0.88), ("lung_nodule", "位于", "right_upper_lobe", 0.88)]
    _, none = text.analyze_clinical(docs_of(spark, "右肺上叶可见一大小约12mm的肺结节"))
    assert triples_of(none) == []


def test_triples_match_pairwise_brute_force(spark):
    rng = random.Random(4)
    words = ["肺癌", "高血压", "发热", "阿司匹林", "CT", "右肺上叶", "无", "示", "服用", "引起", "，", "。",
             "伴", "z" * 6]
    texts = ["".join(rng.choice(words) for _ in range(25)) for _ in range(25)]
    docs = docs_of(spark, *texts)
    entities, triples = text.analyze_clinical(docs)
    mentions = [r.asDict() for r in entities.orderBy("doc_id", "start").collect()]
    got = {(r["doc_id"], r["subject_entity"], r["relation"], r["object_entity"], r["confidence"])
           for r in triples.collect()}
    want = {}
    for d, body in enumerate(texts):
        parts = re.split("[" + ct.SENTENCE_SEPARATORS + "]", body)
        for n, sentence in enumerate(parts):
            here = [m for m in mentions if m["doc_id"] == d and m["sentence_no"] == n]
            for i, a in enumerate(here):
                for b in here[i + 1:]:
                    for relation, (triggers, pairs) in ct.RELATIONS.items():
                        for s, o in pairs:
                            if (a["entity_type"], b["entity_type"]) == (s, o):
                                x, y = a, b
                            elif (b["entity_type"], a["entity_type"]) == (s, o):
                                x, y = b, a
                            else:
                                continue
                            key = (d, x["entity"], relation, y["entity"])
                            neg = (x["negation_status"], y["negation_status"])
                            if key in want or all(neg) or (relation == ct.LOCATED and any(neg)):
                                continue
                            if any(t in sentence for t in triggers):
                                want[key] = 0.88
                            elif len(sentence.strip().replace(" ", "")) <= 15:
                                want[key] = 0.72
    assert got == {(*k, v) for k, v in want.items()} and len(got) > 40


def test_note_variant(spark):
    body = "右肺上叶存在结节1.5cm。否认高血压；既往糖尿病史，白细胞升高"
    entities, triples, flagged = text.analyze_notes(docs_of(spark, body, "CT显示肺炎"))
    names = {(r["entity"], r["start"]) for r in entities.filter("doc_id = 0").collect()}
    assert {("右肺上叶", 0), ("结节", 6), ("1.5cm", 8), ("高血压", 16), ("白细胞", 27)} <= names
    got = {(r["doc_id"], r["subject"], r["relation"], r["object"], r["subject_standard"])
           for r in triples.collect()}
    assert got == {(0, "结节", "位于", "右肺上叶", "nodule"), (0, "白细胞", "状态", "升高", "wbc"),
                   (1, "CT", "提示", "肺炎", "ct_scan")}
    flags = {r["entity"]: r for r in flagged.collect()}
    assert flags["高血压"]["negation_trigger"] == "否认"
    assert flags["糖尿病"]["history_trigger"] == "既往"
    assert flags["糖尿病"]["source_sentence"] == "既往糖尿病史，白细胞升高"
    assert "结节" not in flags


def test_note_status_measures_from_the_first_equal_clause(spark):
    body = "肺炎无发热。x。肺炎无发热"
    _, _, flagged = text.analyze_notes(docs_of(spark, body))
    # the second clause equals the first one, so its entities are measured from the first place
    assert {(r["entity"], r["start"]) for r in flagged.collect()} == {
        ("发热", 3), ("肺炎", 8), ("发热", 11)}


def test_pieces_and_offsets(spark):
    body = " a b，，c\n d 。"
    got = [(r["piece_no"], r["start"], r["end"], r["piece"]) for r in text.piece_offsets(
        docs_of(spark, body)).orderBy("piece_no").collect()]
    assert got == [(0, 0, 4, "a b"), (2, 6, 7, "c"), (3, 8, 11, "d")]
    assert all(body[s:e].strip() == p for _, s, e, p in got)


def test_summaries(spark):
    docs = docs_of(spark, NOTE, "nothing")
    entities, triples = text.analyze_clinical(docs)
    summary = {r["doc_id"]: r for r in text.document_summary(docs, entities, triples).collect()}
    assert summary[1]["entity_count"] == 0 and summary[1]["triple_count"] == 0
    assert summary[0]["entity_count"] == entities.count()
    assert summary[0]["negation_count"] >= 2
    kinds = {r["entity_type"]: r["n"] for r in text.type_distribution(entities).collect()}
    assert sum(kinds.values()) == summary[0]["entity_count"]
    assert ("aspirin", "治疗") in {(r["subject"], r["relation"]) for r in triples.collect()}


def test_large_term_lists_cost_little_more():
    """100,000 terms against 150 on the same texts; all occurrences, also terms inside terms."""
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    terms = list({"".join(rng.choice(letters) for _ in range(rng.randrange(5, 14))) for _ in range(100_000)})
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(400)) for _ in range(150)]

    def seconds(count):
        lexicon = text._Lexicon([(t, "k", t) for t in terms[:count]], [], False)
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            found = [lexicon.spans(t) for t in texts]
            best = min(best, time.perf_counter() - start)
        return best, found

    (few, _), (many, found) = seconds(150), seconds(100_000)
    assert many < 2 * few + 0.3
    known = set(terms)
    for body, spans in zip(texts, found):
        assert all(body[s[2]:s[3]] == s[0] and s[0] in known for s in spans)
        covered = {i for s in spans for i in range(s[2], s[3])}
        for at in range(len(body)):  # what is left has no whole term without a taken character
            for n in range(5, 14):
                if body[at:at + n] in known:
                    assert covered & set(range(at, at + n))
    assert text._Lexicon([], [], True).spans("abc") == []
    inside = text._Lexicon([("bc", "k", "1"), ("abcd", "k", "2"), ("c", "k", "3")], [], True)
    assert sorted(s[:1] + s[2:4] for s in inside.spans("abcd")) == [("abcd", 0, 4), ("bc", 1, 3), ("c", 2, 3)]


def test_triples_equal_all_pairs_of_spans(spark):
    """The sweep against every pair of entities with status, on texts with many mentions of few names."""
    rng = random.Random(9)
    terms = [("aa", "x", "A"), ("bb", "x", "B"), ("cc", "y", "C"), ("dd", "y", "D"), ("aab", "z", "E")]
    relations = {"r1": (["t1"], [("x", "y"), ("x", "x")]), ct.LOCATED: (["t2 "], [("x", "y"), ("z", "x")])}
    words = ["aa", "bb", "cc", "dd", "aab", "no", "t1", "t2", ",", ".", "q"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(0, rows[1][1]), (None, "aa t1 cc"), (500, None), (501, ""), (502, "aa t1 " * 2000 + "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["subject_entity"], r["relation"], r["object_entity"]): (
        r["confidence"], r["sentence_no"], r["first_at"]) for r in text.extract_triples(
        docs, terms, (), relations, ["no"], clause_separators=",.", sentence_separators=".").collect()}
    entities = text.entity_status(text.span_clauses(
        docs, terms, (), clause_separators=",.", sentence_separators="."), ["no"], ["zzz"], ["zzz"]).collect()
    bodies = [(i, t) for i, t in rows if t]
    want = {}
    for key in {i for i, _ in bodies}:
        for body in {t for i, t in bodies if i == key}:
            if key == 0:
                continue  # two texts share this id; checked for presence only
            mine = [e for e in entities if e["doc_id"] == key]
            for number, sentence in enumerate(body.split(".")):
                names = {}
                for e in mine:
                    if e["sentence_no"] == number:
                        names.setdefault((e["entity"], e["entity_type"], e["negation_status"]), []).append(e["start"])
                plain = sentence.strip()
                for no, (relation, (triggers, types)) in enumerate(relations.items()):
                    confidence = ct.TRIGGER_CONFIDENCE if any(t in plain for t in triggers) else (
                        ct.SHORT_CONFIDENCE if len(plain.replace(" ", "")) <= ct.SHORT_SENTENCE else None)
                    for (s, o) in itertools.product(names, names):
                        if confidence is None or (s[1], o[1]) not in types:
                            continue
                        if (s[2] or o[2]) if relation == ct.LOCATED else (s[2] and o[2]):
                            continue
                        same = s[1] == o[1]
                        first, last = names[s], names[o]
                        if same and min(first) >= max(last):
                            continue
                        near = min(first) if same else min(first + last)
                        far = max(last) if same else max(first + last)
                        place = ((number, near, far, no), confidence)
                        triple = (key, s[0], relation, o[0])
                        want[triple] = min(want.get(triple, place), place)
    assert {k: (v[1], v[0][0], v[0][1]) for k, v in want.items()} == {k: v for k, v in got.items() if k[0] != 0}
    assert any(k[0] == 0 for k in got)
    assert text.extract_triples(docs.limit(0), terms, (), relations).count() == 0


def test_found_spans_leave_in_small_batches(spark, monkeypatch):
    """What a worker holds is bounded by spans and characters, not by the rows of a batch."""
    monkeypatch.setattr(text, "HELD_SPANS", 50)
    monkeypatch.setattr(text, "HELD_CHARS", 500)
    schema = to_arrow_schema(schemas.struct(schemas.SPAN_CLAUSES))
    texts = ["ab, ab ab." * 10, None, "", "x" * 600 + "ab"] * 50
    given = pa.RecordBatch.from_arrays([pa.array(range(200), schema.field("doc_id").type), pa.array(texts)], ["doc_id", "text"])
    for overlap in (False, True):
        reader = text._Reader(text._Lexicon([("ab", "t", "AB")], [], overlap), ",.", ".")
        found = list(text._clause_batches(reader, iter([given, given]), schema))
        sizes = [sum(map(len, batch.column("spans").to_pylist())) for batch in found]
        assert sum(sizes) == 2 * 50 * 31 and max(sizes) < 50 + 2
        assert max(sum(map(len, batch.column("clause").to_pylist())) for batch in found) < 500 + 603
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert text.extract_spans(docs, [("ab", "t", "AB")], (), clause_separators=",.").count() == 50 * 31


def test_triggers_are_searched_once_per_clause(spark):
    """No search in a clause, and no clause that is not asked for, is left above the explode of its spans."""
    clauses = text.span_clauses(docs_of(spark, NOTE))
    flagged = text.note_status(clauses)
    for status in (text.entity_status(clauses).select("doc_id", "negation_status", "history_status"),
                   flagged.select("doc_id", "entity", "negation_trigger", "history_trigger")):
        plan = status._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan[:plan.index("Generate")], plan[plan.index("Generate"):]
        assert "clause#" not in above and "instr(clause#" in below
        assert "clause#" not in below[:below.index("Project")]


def test_note_status_over_a_separator(spark):
    """A term over a separator looks in the whole text, and a full stop between trigger and term cancels."""
    terms = [("a，b", "t", "AB"), ("cd", "t", "CD")]
    docs = docs_of(spark, "否认xx a，b，cd", "否认xx。 a，b", "既往a，b", "否认cd。a，b。cd")
    found = text.note_status(text.span_clauses(docs, terms, overlap=True, clause_separators="，。"), ["否认"], ["既往"])
    assert {(r["doc_id"], r["entity"], r["start"], r["negation_trigger"], r["history_trigger"], r["source_sentence"])
            for r in found.collect()} == {
        (0, "a，b", 5, "否认", None, "否认xx a，b，cd"), (2, "a，b", 2, None, "既往", "既往a，b"), (3, "cd", 2, "否认", None, "否认cd")}
