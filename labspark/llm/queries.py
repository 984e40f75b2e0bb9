"""The registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import (
    ann, html, infill, lm, mixing, neardup, packing, quality, secrets, sentencepieces, sharding, urls, whitening)
from labspark.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return add


def _sharding_sql() -> str:
    """CRC-32 byte by byte, row numbers, and the Feistel rounds walked until they are in range."""
    def crc_entry(n: int) -> int:
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        return n

    def once(source: str) -> str:
        """The relation (x, v, a, n) after one pass of all rounds over v."""
        text = f"SELECT x, a, n, v // a AS l, v % a AS r FROM {source}"
        for mult, add, last in sharding.round_keys(17):
            text = f"SELECT x, a, n, r AS l, r AS old, l AS ll, (r * {mult} + {add}) % {sharding.PRIME} AS m FROM ({text})"
            text = (f"SELECT x, a, n, old AS l, (ll + m * ((m + {last}) % {sharding.PRIME}) % {sharding.PRIME}) % a AS r"
                    f" FROM ({text})")
        return f"SELECT x, l * a + r AS v, a, n FROM ({text})"

    return f"""
WITH RECURSIVE crc AS (SELECT {[crc_entry(n) for n in range(256)]}::UBIGINT[] AS entries),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce(
    [4294967295::UBIGINT] || list_transform(range(1, strlen(coalesce(text, '')) + 1),
      lambda i: ('0x' || substr(h, 2 * i - 1, 2))::UBIGINT),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM d),
start AS (SELECT x, x AS v, CAST(ceil(sqrt(n)) AS BIGINT) AS a, n FROM o),
walk(x, v, a, n) AS ({once("start")} UNION ALL {once("(SELECT * FROM walk WHERE v >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % 16)::INTEGER AS shard, (v // 16)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, o.x AS row_number FROM o JOIN walk ON walk.x = o.x AND walk.v < walk.n"""


@query("op2_sharding", _sharding_sql())
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.into_shards(rows, ["doc_id", "text_crc32", "size"], 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _secret_sql() -> str:
    """Spans from the texts between matches and the matches, per kind."""
    def found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
        p = secrets.in_sql(pattern).replace("'", "''")
        return f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, place AS start, place + length(ms[k]) AS "end" FROM (
  SELECT *, coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS place FROM (
    SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
      SELECT rid, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs,
        string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}'))))
WHERE length(gs[k]) >= {least}"""

    every = " UNION ALL ".join(found(i, k, *rule) for i, (k, rule) in enumerate(secrets.RULES.items()))
    base = ", ".join(f"'{k}'" for k in secrets.BASE_RULES)
    joined = """coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank){}, '')"""
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({every})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256({joined.format(f" FILTER (WHERE kind IN ({base}))")}) AS base_sha256, {joined.format("")} AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid"""


@query("op3_secrets", _secret_sql())
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(list(secrets.BASE_RULES)))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("found"), kind).alias(f"n_{kind}") for kind in secrets.BASE_RULES],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def _quality_sql() -> str:
    """Line rules by lists of words; repeated windows by grouping them."""
    def texts(words: list[str]) -> str:
        return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

    blank = r"[ \x09-\x0D]"
    marks = "|".join(f"[{m}][{m}]+" if m != "^" else r"\^\^+" for m in "!?#*$%&|<>=_~^")
    menu = "|".join(quality.MENU_WORDS)
    ends = texts(sorted(quality.ENDS))
    tokens = texts([w for w in quality.MENU_WORDS if " " not in w])
    item = r"^[ \t]*([-*+•·‣–—]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[ \t]"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '{blank}+'), lambda x: x <> '') AS ws FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (
  SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM (
  SELECT rid, i, unnest(range(0, 8)) AS j FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, line, k, list_filter(string_split_regex(line, '{blank}+'), lambda x: x <> '') AS ws,
    string_split_regex(line, '[ \t]') AS tokens FROM (
  SELECT rid, unnest(string_split(t, chr(10))) AS line,
    generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)),
judged AS (SELECT *, CASE
    WHEN len(ws) = 0 THEN NULL
    WHEN len(list_filter({texts(quality.BOILERPLATE)}, lambda p: contains({lower('line')}, p))) > 0 THEN 'boilerplate'
    WHEN seps >= {quality.LEAST_SEPARATORS} AND 3 * seps >= len(ws) - seps THEN 'navigation'
    WHEN len(ws) <= 4 AND regexp_full_match(trim({lower('line')}, chr(13)), '[ \t]*({menu})[ \t]*[:.>]*[ \t]*') THEN 'navigation'
    WHEN len(ws) <= {quality.MENU_LINE} AND entries >= 2 AND 2 * entries >= len(ws) THEN 'navigation'
    WHEN len(ws) >= 10 AND 2 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > len(ws) THEN 'boilerplate'
    WHEN len(list_filter(tokens, lambda x: regexp_matches(x, '({marks})[.,;:]?$')))
      > CAST({quality.MOST_MARKED} AS DOUBLE) * len(ws) THEN 'punctuation'
    WHEN len(ws) >= {quality.LEAST_WORDS} AND worded > 1 AND NOT list_contains({ends}, right(ws[-1], 1))
      AND NOT regexp_matches(coalesce(following, ''), '^{blank}*\\p{{Ll}}') AND NOT regexp_matches(line, '{item}') THEN 'punctuation'
    END AS rule, strlen(array_to_string(ws, '')) AS held,
    row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS again FROM (
  SELECT *, len(list_filter(tokens, lambda x: x IN ('|', '>', '>>', '/', '»', '›', '·', '•'))) AS seps,
    len(list_filter(ws, lambda x: list_contains({tokens}, {lower("regexp_replace(x, '[:.>,|]+$', '')")}))) AS entries,
    lead(line) OVER (PARTITION BY rid ORDER BY k) AS following,
    count(*) FILTER (WHERE len(ws) > 0) OVER (PARTITION BY rid) AS worded FROM lines)),
per AS (SELECT rid, count(*) FILTER (WHERE again AND held > 0) AS n_dup_lines,
    coalesce(sum(held) FILTER (WHERE rule IS NULL), 0) AS good, sum(held) AS held,
    count(*) FILTER (WHERE rule = 'punctuation') AS n_bad_punctuation,
    count(*) FILTER (WHERE rule = 'navigation') AS n_navigation,
    count(*) FILTER (WHERE rule = 'boilerplate') AS n_boilerplate FROM judged GROUP BY rid),
f AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, good, held, n_bad_punctuation, n_navigation, n_boilerplate
  FROM w JOIN per USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN held > 0 THEN good / CAST(held AS DOUBLE) ELSE 0 END AS kept_share FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_share >= CAST({quality.LEAST_KEPT} AS DOUBLE) AS kept, kept_share,
  n_bad_punctuation, n_navigation, n_boilerplate FROM b"""


@query("op4_quality", _quality_sql())
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document, and the lines that failed each rule."""
    return quality.assess(table(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    """Blocks by row numbers per stratum, placed by the cycle schedules of every set of remaining strata."""
    values = ", ".join(f"('{n}', {q})" for n, q in mixing.WEIGHTS.items())
    return f"""
WITH RECURSIVE listed(stratum, q) AS (VALUES {values}),
weights AS (SELECT DISTINCT coalesce(source, '{mixing.NO_SOURCE}') AS stratum, coalesce(q, {mixing.OTHER_WEIGHT}) AS q
  FROM documents LEFT JOIN listed ON source = stratum),
ranked AS (
  SELECT doc_id, source, coalesce(source, '{mixing.NO_SOURCE}') AS stratum,
         md5(coalesce(text, '')) AS digest FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id NULLS FIRST) - 1 AS rnk FROM ranked),
sizes AS (
  SELECT stratum, any_value(q) AS q, ceil(count(*) / ({mixing.BLOCK_ROWS}.0 * any_value(q)))::BIGINT AS last_cycle
  FROM placed JOIN weights USING (stratum) GROUP BY stratum),
phases AS (
  SELECT e AS phase_end, coalesce(lag(e) OVER (ORDER BY e), 0) AS phase_begin,
         (SELECT sum(q) FROM sizes WHERE last_cycle >= e)::BIGINT AS total
  FROM (SELECT DISTINCT last_cycle AS e FROM sizes)),
based AS (
  SELECT *, coalesce(sum((phase_end - phase_begin) * total) OVER (
    ORDER BY phase_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM phases),
pool AS (
  SELECT phase_end, total, list({{'s': stratum, 'q': q}} ORDER BY stratum) AS members
  FROM based JOIN sizes ON last_cycle >= phase_end GROUP BY phase_end, total),
walk(phase_end, total, members, place, done, chosen) AS (
  SELECT phase_end, total, members, 0::BIGINT, list_transform(members, lambda m: 0::BIGINT), NULL::BIGINT FROM pool
  UNION ALL
  SELECT phase_end, total, members, place + 1,
         list_transform(range(1, len(members) + 1), lambda i: done[i] + (i = pick)::BIGINT), pick
  FROM (SELECT *, list_sort(list_filter(list_transform(range(1, len(members) + 1), lambda i: {{
          'due': ((done[i] + 1) * total + members[i].q - 1) // members[i].q, 'q': -members[i].q, 's': members[i].s, 'i': i,
          'open': done[i] < members[i].q AND (done[i] * total) // members[i].q <= place}}),
          lambda c: c.open))[1].i AS pick FROM walk WHERE place < total)),
schedule AS (
  SELECT phase_end, total, members[chosen].s AS stratum, members[chosen].q AS q, place - 1 AS place,
         done[chosen] - 1 AS idx FROM walk WHERE place > 0),
blocks AS (
  SELECT doc_id, source, placed.stratum, rnk // {mixing.BLOCK_ROWS} AS block, rnk % {mixing.BLOCK_ROWS} AS "offset",
         (rnk // {mixing.BLOCK_ROWS}) // q AS cycle, (rnk // {mixing.BLOCK_ROWS}) % q AS idx
  FROM placed JOIN sizes USING (stratum))
SELECT doc_id, source, b.stratum, b.block::BIGINT AS block,
       (base + (cycle - phase_begin) * p.total + s.place)::BIGINT AS slot, b."offset"::INTEGER AS "offset",
       (base + (cycle - phase_begin) * p.total + (b.idx * p.total) // s.q)::BIGINT AS "release",
       (base + (cycle - phase_begin) * p.total + ((b.idx + 1) * p.total + s.q - 1) // s.q)::BIGINT AS deadline
FROM blocks b JOIN based p ON cycle >= phase_begin AND cycle < phase_end
JOIN schedule s ON s.phase_end = p.phase_end AND s.stratum = b.stratum AND s.idx = b.idx"""


@query("op5_mixing", _mixing_sql())
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a stream that holds the target weights."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    return mixing.mix(rows, ["digest", "doc_id"]).select(
        "doc_id", "source", "stratum", "block", "slot", "offset", "release", "deadline")


def _url_sql() -> str:
    def rule_of(host: str, path: str, what: int) -> str:
        ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
        return "CASE " + " ".join(
            f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}')"
            f" THEN '{(h + p, v)[what]}'" for v, h, p in ordered) + " END"

    def parts(url: str, group: int) -> str:
        return f"coalesce(regexp_extract({url}, '^.*?://([^/?#]*)([^?#]*)([^#]*)', {group}, 's'), '')"

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    attr = r"""trim(regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1)
      || regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2)
      || regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3))""".format
    node = f"CASE WHEN contains({{0}}, '://') THEN {lower(parts('{0}', 1))} || {parts('{0}', 2)} || {parts('{0}', 3)} END".format
    return f"""
WITH RECURSIVE nodes AS (
  SELECT page_id, url, html, {lower(parts('url', 1))} AS host, {parts('url', 2)} AS path, {node('url')} AS node FROM pages),
tags AS (
  SELECT url, host, path, node, unnest(regexp_extract_all(html, '(?is)(<link\\b[^>]*>|<meta\\b[^>]*>)', 1)) AS tag FROM nodes),
links AS (
  SELECT url, host, path, node, replace(CASE WHEN lower(tag) LIKE '<link%' THEN {attr(tag='tag', name='href')}
    ELSE regexp_extract({attr(tag='tag', name='content')}, '(?is)url\\s*=\\s*[''"]?([^''"]*)', 1) END, '&amp;', '&') AS link
  FROM tags WHERE (lower(tag) LIKE '<link%' AND regexp_matches(lower({attr(tag='tag', name='rel')}), '(^|\\s)canonical(\\s|$)'))
     OR (lower(tag) LIKE '<meta%' AND lower({attr(tag='tag', name='http-equiv')}) = 'refresh')),
targets AS (
  SELECT node, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN split_part(url, '://', 1) || '://' || host || link
    WHEN regexp_matches(link, '^[?#]') THEN regexp_extract(url, '^([^?#]*)', 1) || link
    ELSE split_part(url, '://', 1) || '://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || link
    END AS target FROM links WHERE link <> ''),
edges AS (
  SELECT node AS u, {node('target')} AS v FROM targets),
sym AS (
  SELECT u, v FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v UNION SELECT v, u FROM edges
  WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v),
reach(node, other) AS (SELECT u, u FROM sym UNION SELECT r.node, s.v FROM reach r JOIN sym s ON s.u = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
ruled AS (
  SELECT root, bool_or(coalesce({rule_of(lower(parts("'x://' || node", 1)), parts("'x://' || node", 2), 1)}, '') = 'block') AS blocked
  FROM roots GROUP BY root)
SELECT page_id, host, path, {rule_of('host', 'path', 0)} AS rule,
       coalesce({rule_of('host', 'path', 1)}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict,
       coalesce(roots.root, n.node) AS alias_root,
       CASE WHEN {rule_of('host', 'path', 0)} IS NOT NULL THEN 'rule' WHEN blocked THEN 'alias' ELSE 'default' END AS via
FROM nodes n LEFT JOIN roots ON roots.node = n.node LEFT JOIN ruled ON ruled.root = roots.root"""


@query("op9_url_filter", _url_sql())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge_pages(table(spark, sf_dir, "pages"))


@query("op6_near_duplicates")
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; keep marks the one that stays."""
    return neardup.classes(table(spark, sf_dir, "documents"))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences."""
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(parts)


@query("op7_ppm")
def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and PPM score of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


_INFILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, units, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(units[:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@query("op11_infill", _INFILL_SQL)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and reordered for filling in the middle, and rebuilt from that."""
    rows = infill.restored(infill.infill(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with begin and end ids, and decoded again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the first 16 whitened components."""
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)
