"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.llm import discriminant, html_blocks, line_dedup, packing, phrases, quality_rules, repair, simhash, spans, token_counts, topk, toxicity, warc
from tallyglass.llm.common import read

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""


def op1(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive(read(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_RULES = {"base": "base_failed", "symbols": "10 * n_symbols > n_words", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}


_RULES["any"] = " OR ".join(f"({c})" for c in _RULES.values())


def _host_rate_sql(rule: str) -> str:
    return f"""SELECT host FROM (SELECT h.host, (h.f_{rule} + t.p_{rule} * (1 / greatest(1e-6, least(1 - 1e-6, b)) - 1)) / (h.n + (1 / greatest(1e-6, least(1 - 1e-6, b)) - 1)) AS rate FROM hosts h,
      (SELECT p_{rule}, CASE WHEN p_{rule} > 0 AND p_{rule} < 1 AND n - squares / n - (hosts - 1) > 0 THEN ((q_{rule} - n * p_{rule} * p_{rule}) / (p_{rule} * (1 - p_{rule})) - (hosts - 1)) / (n - squares / n - (hosts - 1)) ELSE 0 END AS b FROM totals) t)
      WHERE rate > {quality_rules.HOST_LIMITS[rule]}"""


QUALITY_CTES = f"""t AS (SELECT doc_id, source AS host, {WORDS_SQL} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM SOURCE_TABLE),
  win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM t WHERE len(w) >= 8),
  rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM win) WHERE c > 1),
  cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
  m AS (SELECT t.doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(l) AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id),
  b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
  hosts AS (SELECT host, count(*)::DOUBLE AS n, {', '.join(f"count(*) FILTER ({c})::DOUBLE AS f_{r}" for r, c in _RULES.items())} FROM b GROUP BY host),
  totals AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS squares, {', '.join(f"sum(f_{r}) / sum(n) AS p_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in _RULES)} FROM hosts),
  bad AS ({" UNION ".join(_host_rate_sql(r) for r in _RULES)})"""
OP2_SQL = "WITH " + QUALITY_CTES.replace("SOURCE_TABLE", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM b.host) AS kept FROM b"""


def op2(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3(spark: SparkSession, d: str) -> DataFrame:
    made = spans.encode_digests(read(spark, d, "documents"), "piece_bpe_32k.model")
    return made.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP4_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS t FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.t, c.t)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def op4(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(read(spark, d, "embeddings"), every=100, k=10)


def op5(spark: SparkSession, d: str) -> DataFrame:
    made = simhash.near_duplicates(read(spark, d, "documents"), radius=4, width=4)
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


LINES_CTES = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM SOURCE_TABLE),
  k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  x AS (SELECT k.*, g.keeper IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)"""
OP6_SQL = "WITH " + LINES_CTES.replace("SOURCE_TABLE", "documents") + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id"""


def op6(spark: SparkSession, d: str) -> DataFrame:
    made = line_dedup.dedup_lines(read(spark, d, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(read(spark, d, "documents"), "byte_bpe_50k.json", 512)


def op8(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), "word_bpe_49k.json", end_id=2, length=4096)


def op9(spark: SparkSession, d: str) -> DataFrame:
    return html_blocks.extract(read(spark, d, "pages"))


def op10(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(read(spark, d, "documents"), read(spark, d, "labels"))


OP11_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, text FROM documents),
q AS (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM p),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM q),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
s AS (SELECT k.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
e AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE around IS NULL OR 100 * around < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT z.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""


def op11(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(read(spark, d, "documents"), width=3, least=10, top=2000, inside=50)


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_BYTE = f"list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: {_CRC_STEP})"
#: Parser states 0 nothing, 1 s, 2 whole turns, 3 user waiting. Moves over one row: from, inserts, action, initial needed, to, cost.
_MOVES_SQL = """(SELECT i.a AS a, i.n AS n, o.act, o.init, o.z AS z, 5 * i.n + o.cost AS cost FROM
    (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 2), (0, 2, 2), (1, 2, 2), (2, 2, 2), (3, 2, 3)) i(a, n, b)
    JOIN (VALUES (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 3, 0), (1, 'K', 'u', 3, 0), (2, 'K', 'u', 3, 0), (3, 'K', 'a', 2, 0),
      (0, 'R', '', 3, 1), (1, 'R', '', 3, 1), (2, 'R', '', 3, 1), (3, 'R', '', 2, 1)) o(b, act, init, z, cost) ON o.b = i.b)"""
OP12_SQL = rf"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda r, b: {_CRC_BYTE}), 4294967295::BIGINT) % 20 AS code FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE code WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
r AS (SELECT conv_id, turn, role, text, row_number() OVER w AS pos, lag(role[1:1]) OVER w || role[1:1] AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, role[1:1] AS init, CASE WHEN seen = '' THEN 'b' WHEN again THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM r),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
p AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS state, '000000000000' AS way FROM g
  UNION ALL SELECT conv_id, pos, state, way FROM (SELECT p.conv_id, f.pos, m.z AS state, min(lpad((p.way[1:12]::BIGINT + m.cost + CASE WHEN f.fault = 't' AND m.act <> 'D' THEN 5 ELSE 0 END)::VARCHAR, 12, '0') || p.way[13:] || repeat('I', m.n) || m.act) AS way
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1 JOIN {_MOVES_SQL} m ON m.a = p.state AND (m.init = '' OR m.init = f.init) AND (m.act = 'D' OR f.fault IN ('t', '-')) GROUP BY 1, 2, 3)),
e AS (SELECT p.conv_id, min(lpad((way[1:12]::BIGINT + 5 * n_more)::VARCHAR, 12, '0') || way[13:] || repeat('I', n_more)) AS way FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.pos
    JOIN (VALUES (0, 0), (0, 2), (1, 2), (2, 0), (3, 1)) t(state, n_more) ON t.state = p.state GROUP BY 1),
x AS (SELECT conv_id, way[13:] AS audit, unnest(range(1, length(way) - 11)) AS i FROM e),
y AS (SELECT conv_id, i, audit[i:i] AS act, length(replace(audit[1:i], 'I', '')) AS pos FROM x),
v AS (SELECT y.conv_id, i, act, f.role, f.text, f.init, act = 'K' AND f.init = 's' AS head FROM y LEFT JOIN f ON act <> 'I' AND f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.pos = y.pos WHERE act <> 'D'),
o AS (SELECT *, count(*) FILTER (NOT head) OVER (PARTITION BY conv_id ORDER BY i) % 2 AS odd FROM v),
z AS (SELECT conv_id, string_agg(CASE WHEN act = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS lines FROM o GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.way[1:12]::BIGINT, 0) AS cost, coalesce(e.way[13:], '') AS audit, sha256(coalesce(z.lines, '')) AS repaired_sha256
FROM every a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


def op12(spark: SparkSession, d: str) -> DataFrame:
    return repair.damaged_and_repaired(read(spark, d, "conversations"))


def op13(spark: SparkSession, d: str) -> DataFrame:
    return discriminant.quality(read(spark, d, "documents"), read(spark, d, "labels"), limit=0.3)


QUERIES = {"op1_seekable_warc": op1, "op2_host_quality": op2, "op3_piece_spans": op3, "op4_exact_top_k": op4, "op5_covering_simhash": op5, "op6_hashed_line_dedup": op6,
           "op7_two_tier_token_counts": op7, "op8_histogram_packing": op8, "op9_line_block_text": op9, "op10_subword_toxicity": op10,
           "op11_automaton_collocations": op11, "op12_parsed_repair": op12, "op13_quadratic_discriminant": op13}
ORACLES = {"op1_seekable_warc": OP1_SQL, "op2_host_quality": OP2_SQL, "op4_exact_top_k": OP4_SQL, "op6_hashed_line_dedup": OP6_SQL, "op11_automaton_collocations": OP11_SQL, "op12_parsed_repair": OP12_SQL}
