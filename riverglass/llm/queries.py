"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, lines, metric, mips, mixing, periodic, pii, repeats, sentencepiece, simhash, toxicity, warc
from .common import WORD, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document; their piece ids as a digest."""
    return sentencepiece.sample_segmentations(read(spark, sf_dir, "documents"), k=2, digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op8_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.search(read(spark, sf_dir, "embeddings"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and SHA-256 of the text that is left."""
    docs = read(spark, sf_dir, "documents")
    out = lines.dedup_lines(docs, lines.repeated_chunks(docs))
    return out.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.summary(read(spark, sf_dir, "documents"))


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.link(read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20, then repaired; a row for each conversation of the table, whatever is left of it."""
    rows = read(spark, sf_dir, "conversations")
    space = F.lit(" ")
    damage = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    damaged = rows.where(damage != 0).select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(role).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    fixed = conversations.repair(damaged).withColumnRenamed("conv_id", "of")
    whole = rows.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; where crc32 of the id ends in 0, the text's words first repeat with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(cycle, 1, n - a)), " "))

    words = F.array(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    text = F.when(h % 10 == 0, F.transform(words, planted)[0]).otherwise(F.col("text"))
    found = periodic.runs(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = found.withColumn("best", periodic.longest("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.period")).alias("exponent_milli"), F.sha2(periodic.listing("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS line,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (
  SELECT line, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY line) - 1) % 3 + 1 AS w
  FROM sized GROUP BY line),
lev(i, lam) AS (
  SELECT 0, CAST(sum(source_size) AS DOUBLE) / CAST(sum(w) AS DOUBLE) FROM src
  UNION ALL
  SELECT lev.i + 1,
         CAST((SELECT sum(source_size) FROM src) - coalesce(sum(CASE WHEN w * lam > 3.0::DOUBLE * source_size THEN 3 * source_size END), 0) AS DOUBLE)
         / nullif(CAST(sum(CASE WHEN NOT (w * lam > 3.0::DOUBLE * source_size) THEN w ELSE 0 END) AS DOUBLE), 0)
  FROM lev, src WHERE lev.i < 60 AND lam IS NOT NULL GROUP BY lev.i, lam),
goal AS (
  SELECT line, source_size, least(w * lam, 3.0::DOUBLE * source_size) AS target
  FROM src, (SELECT lam FROM lev WHERE lam IS NOT NULL ORDER BY i DESC LIMIT 1)),
placed AS (
  SELECT s.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.line ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN goal g USING (line))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""

_BITS = " + ".join(f"{2 ** (4 - b)} * CAST(substr(bits, 5 * i + {b + 1}, 1) AS BIGINT)" for b in range(5))
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
part AS (SELECT u, min(w) AS least FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT vec_id, coalesce(k, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings JOIN part ON vec_id = part.u LEFT JOIN n ON vec_id = n.u
"""

_CRC32 = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, ch: list_reduce(list_concat([xor(c, ch)], range(8)), lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1)))))"
_SPEAKERS = ("user", "assistant")
_MOVES = ", ".join(
    f"('{code}', {state}, '{'I' * k}{letter}', {5 * k + cost}, {after}, '{''.join(f'{_SPEAKERS[j % 2]}:~' for j in range(first, first + k))}', {repr(_SPEAKERS[(first + k) % 2]) if letter == 'R' else 'NULL'})"
    for code, state, k, first, (letter, cost, after) in (
        (code, state, k, int(state == 2), edit)
        for code in conversations.EDITS
        for state in range(4)
        for k in range(3)
        for edit in conversations.EDITS[code][[state, 3 if state == 2 else 2, 2 if state == 2 else 3][k]]
    )
)
_ENDS = "(0, '', 0, ''), (3, '', 0, ''), (2, 'I', 5, 'assistant:~'), (1, 'II', 10, 'user:~assistant:~')"
# the same edits as shortest ways over (row, state), all of a row's ways at once; moves are up to two insertions and one edit of the row
OP12_SQL = rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC32.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS c
  FROM h WHERE d <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
                rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM pos),
judged AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN cut[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS known FROM seen),
coded AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'X' WHEN fault = 'truncated' THEN upper(known) ELSE known END AS code FROM judged),
moves(code, s, letters, cost, t, pre, say) AS (VALUES {_MOVES}),
ends(s, letters, cost, pre) AS (VALUES {_ENDS}),
walk(conv_id, i, s, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} FROM coded
  UNION ALL
  SELECT w.conv_id, r.i, m.t, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters,
    'said': w.best.said || replace(m.pre, '~', chr(10)) || CASE WHEN m.letters LIKE '%D' THEN '' ELSE coalesce(m.say, r.role) || ':' || r.text || chr(10) END}})
  FROM walk w JOIN coded r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN moves m ON m.code = r.code AND m.s = w.s
  GROUP BY w.conv_id, r.i, m.t),
sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id),
done AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.letters, 'said': w.best.said || replace(e.pre, '~', chr(10))}}) AS best
  FROM walk w JOIN sums u ON u.conv_id IS NOT DISTINCT FROM w.conv_id AND u.n = w.i JOIN ends e ON e.s = w.s GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(done.best.cost, 0) AS cost, coalesce(done.best.audit, '') AS audit,
       sha256(coalesce(left(done.best.said, length(done.best.said) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# the words of a text after planting, joined with themselves on equal words at distances of up to a quarter of the text
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
e AS (SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM d),
f AS (SELECT *, 1 + (n - a) // parts AS p FROM e),
t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda j: CASE WHEN planted AND j >= a THEN w[1 + a + (j - a) % p] ELSE w[j + 1] END)) AS word FROM f),
m AS (SELECT x.rid, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT rid, q, min(i) AS s, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS part FROM m) GROUP BY rid, q, part HAVING count(*) >= greatest(3 * q, 6 - q)),
r AS (SELECT rid, s, k + q AS length, min(q) AS period FROM island GROUP BY rid, s, k + q),
best AS (SELECT rid, count(*) AS n_runs, arg_min(s, (-length, s, period)) AS start, arg_min(length, (-length, s, period)) AS length, arg_min(period, (-length, s, period)) AS period,
                sha256(string_agg(s || ',' || length || ',' || period || chr(10), '' ORDER BY s, period)) AS listing FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + period, s + length)) AS i FROM r),
kept AS (SELECT rid, sha256(string_agg(word, ' ' ORDER BY i)) AS h FROM t ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       coalesce(listing, sha256('')) AS runs_sha256, coalesce(kept.h, sha256('')) AS collapsed_sha256
FROM f LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""

QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_hilbert_neighbours": op6_hilbert_neighbours,
    "op8_inner_products": op8_inner_products,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_repeats": op10_repeats,
    "op11_metric_join": op11_metric_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op8_inner_products": OP8_SQL,
    "op11_metric_join": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
