"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: counts by two tokenizers, one of them sent twice, then the documents that
    the second counts shorter leave the first."""
    from .common import new_path, stored
    from .token_counts import TokenRollup, count_tokens

    counted = stored(count_tokens(_docs(spark, sf_dir)), "counted")
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    insert = counted.select(F.lit("insert").alias("op"), "*")
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k", "byte_bpe_50k"):
        rollup.apply(f"insert-{version}", insert.where(F.col("version") == version))
    now = rollup.present().groupBy("doc_id").pivot("version", ["byte_bpe_50k", "byte_bpe_multi_50k"]).agg(F.max("n_tokens"))
    shorter = now.where("byte_bpe_multi_50k < byte_bpe_50k").select("doc_id", F.lit("byte_bpe_50k").alias("version"))
    rollup.apply("retire", shorter.select(F.lit("delete").alias("op"), "*", *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_tokens", "long"))]))
    return rollup.totals()


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_rows, train_field

    docs = _docs(spark, sf_dir)
    return pii_rows(docs, train_field(docs))


def op3_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_matches

    return benchmark_matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import document_paths, scan_licenses

    return scan_licenses(document_paths(_docs(spark, sf_dir)))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoding_rows

    return encoding_rows(_docs(spark, sf_dir))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(_docs(spark, sf_dir))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_rows

    return simhash_rows(_docs(spark, sf_dir), words=3, max_bits=2)


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train_quality

    docs = _docs(spark, sf_dir)
    return score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_docs(spark, sf_dir))


def op10_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score, train

    docs = _docs(spark, sf_dir)
    return score(docs, train(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_docs(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the seeded rule, then repaired at the least cost."""
    from .conversations import damaged, repair

    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict without the rule's name, which depends on the order that the sample suggests."""
    from .rules import rule_cascade

    return rule_cascade(_docs(spark, sf_dir)).drop("rejected_by")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _hilbert_sql(dims: int = 4, bits: int = 4) -> str:
    """Common table expressions that give each cell its index on the Hilbert curve, a step of the transform each."""
    xs = [f"x{i}" for i in range(dims)]
    out = [f"h0 AS (SELECT cell, {', '.join(f'(cell >> {bits * (dims - 1 - i)}) & {2**bits - 1} AS {x}' for i, x in enumerate(xs))} FROM (SELECT DISTINCT cell FROM rows6))"]
    n = 0
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i, x in enumerate(xs):
            first = f"CASE WHEN {x} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, xor(x0, {x}) & {p}) END"
            own = f"CASE WHEN {x} & {q} <> 0 THEN {x} ELSE xor({x}, xor(x0, {x}) & {p}) END"
            cols = [f"{first} AS x0" if y == "x0" else f"{own} AS {y}" if y == x and i else y for y in xs]
            out.append(f"h{n + 1} AS (SELECT cell, {', '.join(cols)} FROM h{n})")
            n += 1
    for i in range(1, dims):
        out.append(f"h{n + 1} AS (SELECT cell, {', '.join(f'xor(x{i}, x{i - 1}) AS x{i}' if y == f'x{i}' else y for y in xs)} FROM h{n})")
        n += 1
    t = "0"
    for b in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN {xs[-1]} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    out.append(f"h{n + 1} AS (SELECT cell, {', '.join(f'xor({x}, {t}) AS {x}' for x in xs)} FROM h{n})")
    places = [(b, x) for b in range(bits - 1, -1, -1) for x in xs]
    index = " + ".join(f"((({x} >> {b}) & 1) << {len(places) - 1 - k})" for k, (b, x) in enumerate(places))
    out.append(f"curve AS (SELECT cell, {index} AS h FROM h{n + 1})")
    return ",\n".join(out)


def _cuts_sql(column: str) -> str:
    """A code from 0 to 15 by the share of rows before a value in sort order: how many cuts are not above it."""
    return f"""{column}_cuts AS (SELECT code, min({column}) AS cut FROM (SELECT {column}, CAST(floor(coalesce(sum(c) OVER (ORDER BY {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 16 / (SELECT count(*) FROM base6)) AS BIGINT) AS code
  FROM (SELECT {column}, count(*) AS c FROM base6 GROUP BY 1)) WHERE code > 0 GROUP BY 1)"""


#: CRC-32 (the reflected polynomial 0xEDB88320), a table made by its rule and a step a byte.
_CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
OP6_SQL = f"""
WITH RECURSIVE bits8 AS (SELECT n AS i, n::BIGINT AS x, 0 AS k FROM range(256) t(n) UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM bits8 WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits8 WHERE k = 8),
raw6 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, hex(encode(coalesce(text, ''))) AS hx FROM documents),
base6 AS (SELECT doc_id, source, lang, CAST(length(hx) // 2 + 16 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: (instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM raw6, crc),
{_cuts_sql("source")},
{_cuts_sql("lang")},
span AS (SELECT min(doc_id) AS lo, max(doc_id) - min(doc_id) + 1 AS n FROM base6),
rows6 AS (SELECT doc_id, size, text_crc32, CAST((((SELECT count(*) FROM source_cuts WHERE cut <= source) * 16 + (SELECT count(*) FROM lang_cuts WHERE cut <= lang)) * 16
  + least(15, greatest(0, length(ltrim(bin(size), '0')) - 5))) * 16 + (doc_id - lo) * 16 // n AS BIGINT) AS cell FROM base6, span),
{_hilbert_sql()},
total AS (SELECT count(*) AS n, CAST(pow(2, greatest(0, ceil(log2(greatest(1, count(*) / 20000.0))))) AS BIGINT) AS runs FROM rows6),
placed AS (SELECT doc_id, size, text_crc32, h, n, row_number() OVER (ORDER BY h, ((((doc_id % 4294967296) * 40503 + text_crc32) >> 8) % runs), doc_id, text_crc32, size) - 1 AS place FROM rows6 JOIN curve USING (cell), total),
cut6 AS (SELECT *, place * 40 // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(place - (shard * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(h AS INTEGER) AS h FROM cut6
"""


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
each AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS everywhere FROM each GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(everywhere) AS lang_total FROM kept GROUP BY 1),
cells AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN cells USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (everywhere + 5)) // (lang_total + 5 * v) AS q
  FROM totals t JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(any_value(value), 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL (SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM p WHERE n > 0 AND p > q QUALIFY r <= 50))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


OP13_SQL = """
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
windows AS (SELECT id, unnest(list_transform(range(len(ws) - 4), lambda i: ws[i + 1 : i + 5])) AS g, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY 1),
base AS (SELECT doc_id, t, ws, lines, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered c USING (id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND n_dup_lines * 10 > 3 * len(lines))
  OR len(list_filter(ws, lambda x: regexp_matches(x, '\\p{L}'))) * 2 < n_words
  OR length(regexp_replace(t, '\\P{Lu}', '', 'g')) * 2 > length(regexp_replace(t, '\\P{L}', '', 'g'))
  OR len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•·]'))) * 10 > 9 * len(lines)
  OR len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) * 10 > 3 * len(lines)) AS kept FROM failed
"""


def _op12_sql() -> str:
    """A recursive step a row; each state is (cost, audit, repaired rows), compared in that order."""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    moved = lambda s, cost, edit, row=None: f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', r := {f'list_append({s}.r, {row})' if row else f'{s}.r'})"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    never = "struct_pack(c := 1000000000::BIGINT, a := '', r := []::VARCHAR[])"
    when = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE {never} END"
    closing = lambda inner: f"SELECT * REPLACE ({least('u', *(moved(x, 2, 'I', chr(39) + 'user:' + chr(39)) for x in 'nsa'))} AS u, {least('a', moved('u', 2, 'I', chr(39) + 'assistant:' + chr(39)))} AS a) FROM ({inner})"
    own, user, reply = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    go = "NOT (blank OR repeat)"
    keep = lambda s, i: when(f"{go} AND left(role, 1) = '{i}'", moved(s, "cut", "K", own))
    rerole = lambda s, row: when(go, moved(s, "2 + cut", "R", row))
    step = f"""SELECT conv, rn, {moved('n', 3, 'D')} AS n, {least(moved('s', 3, 'D'), keep('n', 's'))} AS s,
  {least(moved('u', 3, 'D'), *(x for s in 'nsa' for x in (keep(s, 'u'), rerole(s, user))))} AS u, {least(moved('a', 3, 'D'), keep('u', 'a'), rerole('u', reply))} AS a
  FROM (SELECT f.*, w.n, w.s, w.u, w.a FROM walk w JOIN faults f ON f.conv = w.conv AND f.rn = w.rn + 1)"""
    return f"""
WITH RECURSIVE bits8 AS (SELECT n AS i, n::BIGINT AS x, 0 AS k FROM range(256) t(n) UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM bits8 WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS tab FROM bits8 WHERE k = 8),
keyed AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(k)), lambda i: ascii(k[i + 1])::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
hurt AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS rn FROM hurt),
marked AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY rn) > 1 AS again, right(rtrim(text, {white}), 1) NOT IN ('.', '!', '?') AS open,
  lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY rn) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM placed),
faults AS (SELECT conv, turn, rn, role, text, blank, NOT blank AND again AS repeat, CAST(NOT blank AND NOT again AND open AS BIGINT) AS cut, odd FROM marked),
walk AS (SELECT conv, 0::BIGINT AS rn, n, s, struct_pack(c := 2::BIGINT, a := 'I', r := ['user:']) AS u, struct_pack(c := 4::BIGINT, a := 'II', r := ['user:', 'assistant:']) AS a FROM (SELECT DISTINCT conv, struct_pack(c := 0::BIGINT, a := '', r := []::VARCHAR[]) AS n, {never} AS s FROM keyed)
  UNION ALL ({closing(closing(step))})),
best AS (SELECT conv, arg_max({least('n', 'a')}, rn) AS b FROM walk GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(repeat) AS duplicate, coalesce(sum(cut), 0) AS truncated, count_if(odd) AS illegal FROM faults GROUP BY conv)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  b.c AS cost, b.a AS audit, sha256(array_to_string(b.r, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) k JOIN best USING (conv) LEFT JOIN counts USING (conv)
"""


def _op4_sql() -> str:
    from .licenses import MIN_COSINE, TEMPLATES, template_words

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    listed = [(n, lic, template_words(t)) for n, (lic, t) in enumerate((lic, t) for lic in sorted(TEMPLATES) for t in TEMPLATES[lic])]
    notices = ", ".join(f"({n}, {quoted(lic)}, {len(ws)}, {off}, {quoted(w)})" for n, lic, ws in listed for off, w in enumerate(ws))
    return f"""
WITH files AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN (doc_id // 1000) || '/LICENSE.' || doc_id WHEN doc_id % 10 = 0 THEN (doc_id // 1000) || '/' || (doc_id // 10) || '/LICENSE.' || doc_id
  ELSE (doc_id // 1000) || '/' || (doc_id // 10) || '/' || doc_id || '.txt' END AS path FROM documents),
seq AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '\\.(\\s|$)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: w <> '') AS ws FROM files),
places(notice, license, m, off, word) AS (VALUES {notices}),
notices AS (SELECT notice, license, m, word, count(*) AS tf FROM places GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM seq) WHERE word IN (SELECT word FROM notices) GROUP BY 1),
idf AS (SELECT word, ln(((SELECT count(*) FROM files) + 1.0) / (coalesce(df, 0) + 1.0)) + 1 AS idf FROM (SELECT DISTINCT word FROM notices) LEFT JOIN df USING (word)),
raw AS (SELECT notice, license, m, word, (1 + ln(tf)) * idf AS y FROM notices JOIN idf USING (word)),
y AS (SELECT notice, license, m, word, y / sqrt(sum(y * y) OVER (PARTITION BY notice)) AS y FROM raw),
anchors AS (SELECT notice, word FROM (SELECT notice, word, 1 - coalesce(sum(y * y) OVER (PARTITION BY notice ORDER BY round(y * y, 12) DESC, word DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM y) WHERE rest >= {MIN_COSINE} * {MIN_COSINE} - 1e-6),
hits AS (SELECT doc_id, ws, i, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM seq) WHERE ws[i + 1] IN (SELECT word FROM anchors)),
windows AS (SELECT doc_id, notice, ws[greatest(i - off, 0) + 1 : greatest(i - off, 0) + m] AS ws FROM hits JOIN anchors USING (word) JOIN places USING (notice, word)),
kinds AS (SELECT notice, ws, row_number() OVER () AS kind FROM (SELECT DISTINCT notice, ws FROM windows)),
x AS (SELECT kind, notice, word, (1 + ln(count(*))) * coalesce(any_value(idf), 1.0) AS x FROM (SELECT kind, notice, unnest(ws) AS word FROM kinds) LEFT JOIN idf USING (word) GROUP BY 1, 2, 3),
lic AS (SELECT DISTINCT notice, license FROM notices),
cos AS (SELECT kind, any_value(license) AS license, round(sum(x * coalesce(y, 0)) / sqrt(sum(x * x)), 9) AS cosine FROM x LEFT JOIN (SELECT notice, word, y FROM y) y USING (notice, word) JOIN lic USING (notice) GROUP BY kind HAVING round(sum(x * coalesce(y, 0)) / sqrt(sum(x * x)), 9) >= {MIN_COSINE}),
own AS (SELECT doc_id, max(struct_pack(c := cosine, l := license)) AS m FROM windows JOIN kinds USING (notice, ws) JOIN cos USING (kind) GROUP BY 1),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, m.l AS license, m.c AS cosine FROM files LEFT JOIN own USING (doc_id)),
dirs AS (SELECT dir, min(struct_pack(c := -cosine, p := path, l := license)) AS m FROM placed WHERE license IS NOT NULL AND regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$') GROUP BY 1),
near AS (SELECT p.doc_id, arg_min(d.m.l, length(p.dir) - length(d.dir)) AS l, arg_min(d.m.p, length(p.dir) - length(d.dir)) AS lp FROM placed p JOIN dirs d ON p.dir = d.dir OR starts_with(p.dir, d.dir || '/') OR d.dir = '' GROUP BY 1)
SELECT doc_id, path, coalesce(license, l) AS license, CASE WHEN license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, cosine, CASE WHEN license IS NULL THEN lp END AS license_path FROM placed LEFT JOIN near USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_rollup, op2_pii_spans, op3_benchmark_matches, op4_license_scan, op5_piece_encoding, op6_hilbert_shards, op7_simhash_components, op8_quality_scores, op9_exact_groups, op10_pitman_yor_scores, op11_source_divergence, op12_conversation_repair, op13_rule_cascade)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": _op4_sql(), "op6_hilbert_shards": OP6_SQL, "op9_exact_groups": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_repair": _op12_sql(), "op13_rule_cascade": OP13_SQL}
