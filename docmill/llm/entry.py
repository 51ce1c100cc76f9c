"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import chat, decontamination, katz, mixing, neardup, sharding, topk, toxicity, urls, warc
from docmill.llm.shared import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT -1L AS conv_id, x.turn, x.role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)",
        args={"said": said},
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_conversations(chat.format_conversations(rows))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.training_order(mixed).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")
    )


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_top_k": op10_top_k,
}
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS opens,
    replace(text, '\', '\\') AS doubled
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
lengths AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(doubled, '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '', '')) AS n_chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_chars + CASE WHEN opens = 1 THEN 9 + length(role) + 8 + 8 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id
"""

ORACLE_SQL["op6_sharding"] = f"""
WITH rows AS (
  SELECT doc_id, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS h,
    CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes
  FROM documents),
up AS (SELECT *, d, h >> (60 - d) AS bucket FROM rows, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS d)),
sums AS (
  SELECT d, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM up GROUP BY d, bucket
  HAVING sum(n_bytes) <= {sharding.LIMIT_BYTES} OR min(h) = max(h)),
found AS (
  SELECT up.doc_id, up.n_bytes, up.d, up.bucket, shard_bytes, shard_docs,
    row_number() OVER (PARTITION BY up.doc_id ORDER BY up.d) AS nth
  FROM up JOIN sums USING (d, bucket))
SELECT doc_id, n_bytes, 's' || CASE WHEN d > 0 THEN lpad(bin(bucket), d, '0') ELSE '' END AS shard,
  d AS depth, shard_bytes, shard_docs
FROM found WHERE nth = 1
"""

ORACLE_SQL["op9_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sources),
weighed AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
    CASE nth % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS slope FROM ranked),
limits AS (SELECT *, (2 * source_size)::DOUBLE / w AS top FROM weighed),
levels AS (
  SELECT *, row_number() OVER (ORDER BY top, source NULLS LAST) AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS here
  FROM limits WINDOW before AS (ORDER BY top, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT here AS level FROM levels WHERE here <= top ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_size, slope, round(least((2 * source_size)::DOUBLE, w * level), 6) AS target FROM levels, level),
laid AS (
  SELECT r.*, source_size, target, slope,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY k, doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, CAST(round(target - passes * source_size) AS BIGINT) AS rest FROM laid),
placed AS (
  SELECT *, least(begins::DOUBLE / target, 1.0::DOUBLE) AS part,
    CAST(passes * size + least(greatest(rest - begins, 0), size) AS BIGINT) AS taken FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  CASE WHEN passes > 0 OR rest > begins THEN round(2 * part / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)), 9) END AS position
FROM placed
"""

ORACLE_SQL["op5_decontamination"] = r"""
WITH spelt AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM asked WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM spelt, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, t)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM spelt LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE_SQL["op7_near_duplicates"] = r"""
WITH RECURSIVE spelt AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[i:i + 3], ' ')) AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM spelt WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM spelt UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

ORACLE_SQL["op10_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL["op1_warc"] = r"""
WITH rows AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM rows),
named AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS nth FROM digests)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND nth > 1 AND last IS NOT NULL THEN last END AS refers_to
FROM named
"""


def _url_sql() -> str:
    """The URL filters in SQL: the rules by cases, and a step for each level of the tree."""
    rules = sorted(urls.RULES, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0])))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    case = lambda nth: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[nth]}'" for f in fits) + " END"
    shape = "CASE WHEN regexp_full_match({0}, '[0-9]+') THEN '*' WHEN regexp_matches({0}, '^[0-9]+\\.') THEN '*' || regexp_extract({0}, '^[0-9]+(\\..*)$', 1) ELSE {0} END"
    depth, z = urls.DEPTH, f"{urls.MERGE_Z}::DOUBLE"
    raw = [*(f"parts[{i + 2}]" for i in range(depth - 1)), f"CASE WHEN len(parts) > {depth} THEN array_to_string(parts[{depth + 1}:], '/') END"]
    segments = ", ".join(f"{shape.format(f'({x})')} AS s{i}" for i, x in enumerate(raw))
    steps = ""
    for i in range(depth):
        steps += f"""
v{i} AS MATERIALIZED (SELECT host, n{i}, s{i}, count(*) AS n FROM t{i} WHERE s{i} IS NOT NULL GROUP BY ALL),
w{i} AS MATERIALIZED (SELECT host, n{i} FROM v{i} GROUP BY ALL HAVING count(*) >= {urls.VARIABLE_DISTINCT} AND count(*) >= {urls.VARIABLE_SHARE} * sum(n)),
t{i + 1} AS MATERIALIZED (SELECT x.*, x.n{i} || '/' || CASE WHEN w.n{i} IS NOT NULL THEN '*' ELSE s{i} END AS n{i + 1} FROM t{i} x LEFT JOIN w{i} w ON x.host = w.host AND x.n{i} = w.n{i}),"""
    share = lambda good, n, parent: (
        f"round(CASE WHEN {n} > 0 AND abs({good} / greatest({n}, 1) - {parent}) > {z} * sqrt({parent} * (1 - {parent}) / greatest({n}, 1))"
        f" THEN ({good} + {urls.SMOOTHING}::DOUBLE * {parent}) / ({n} + {urls.SMOOTHING}::DOUBLE) ELSE {parent} END, 9)"
    )
    for i in range(depth + 1):
        parent = f"n{i - 1}" if i else "''"
        steps += f"""
a{i} AS MATERIALIZED (SELECT host, {parent} AS parent, n{i} AS node, sum(n) AS n, sum(good) AS good, any_value(p) AS p FROM l{i} WHERE n{i} IS NOT NULL GROUP BY host, {parent}, n{i} HAVING sum(n) > 0),
b{i} AS MATERIALIZED (SELECT host, parent, CAST(round(good / n * {urls.SHARES}) AS INTEGER) AS bin, sum(n) AS n, sum(good) AS good, any_value(p) AS p FROM a{i} GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT *, lag(n) OVER w AS m, lag(good) OVER w AS h FROM b{i} WINDOW w AS (PARTITION BY host, parent ORDER BY bin)),
d{i} AS MATERIALIZED (SELECT *, sum(CASE WHEN m IS NOT NULL AND abs(good / n - h / m) > {z} * sqrt((good + h) / (n + m) * (1 - (good + h) / (n + m)) * (1 / n + 1 / m)) THEN 1 ELSE 0 END) OVER (PARTITION BY host, parent ORDER BY bin) AS branch FROM c{i}),
e{i} AS MATERIALIZED (SELECT host, parent, branch, sum(n) AS n, sum(good) AS good, any_value(p) AS p FROM d{i} GROUP BY ALL),
f{i} AS MATERIALIZED (SELECT d.host, d.parent, d.bin, {share("e.good", "e.n", "e.p")} AS share FROM d{i} d JOIN e{i} e USING (host, parent, branch)),
g{i} AS MATERIALIZED (SELECT a.host, a.node, f.share FROM a{i} a JOIN f{i} f ON a.host = f.host AND a.parent = f.parent AND CAST(round(a.good / a.n * {urls.SHARES}) AS INTEGER) = f.bin),
l{i + 1} AS MATERIALIZED (SELECT x.* REPLACE (coalesce(g.share, x.p) AS p) FROM l{i} x LEFT JOIN g{i} g ON x.host = g.host AND x.n{i} = g.node),"""
    steps = steps.replace("\na0 AS", f"""
l0 AS MATERIALIZED (SELECT *, coalesce((SELECT sum(good) / nullif(sum(n), 0) FROM t{depth}), 1.0::DOUBLE) AS p FROM t{depth}),
a0 AS""")
    last = ", ".join(f"n{i}" for i in range(depth, -1, -1))
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS MATERIALIZED (SELECT *, {case(1)} AS rule, {case(2)} AS ruling FROM parts),
paths AS (SELECT host, path, string_split(path, '/') AS parts, count(ruling)::DOUBLE AS n, (count(*) FILTER (ruling = 'allow'))::DOUBLE AS good FROM ruled GROUP BY host, path),
t0 AS MATERIALIZED (SELECT host, path, n, good, '' AS n0, {segments} FROM paths),{steps}
named AS MATERIALIZED (SELECT *, coalesce({last}) AS template FROM l{depth + 1}),
wide AS MATERIALIZED (SELECT template, sum(n) AS n, sum(good) AS good FROM named GROUP BY template HAVING sum(n) > 0),
pure AS (SELECT x.host, x.path, x.template, CASE WHEN a.host IS NULL AND w.n IS NOT NULL THEN {share("w.good", "w.n", "l0.p")} ELSE x.p END AS purity FROM named x JOIN l0 ON l0.host = x.host AND l0.path = x.path
  LEFT JOIN a0 a ON a.host = x.host LEFT JOIN wide w ON w.template = x.template)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN purity < {urls.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM ruled JOIN pure USING (host, path)
"""


ORACLE_SQL["op8_url_filters"] = _url_sql()
