"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.functions.text import SPACE
from cognatus.llm import ann, archive, boilerplate, changepoints, embdedup, filteraudit, langid, maxent, mixing, packing, simhash, suffixdedup, urllists
from cognatus.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("neighbour_id").alias("vec_id"), "score")


def op2_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embdedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: One year of dated entries for the hosts and first path segments of all pages, by their digests.
ENTRIES_SQL = """
WITH p AS (
    SELECT DISTINCT regexp_extract(url, '^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h,
           split_part(regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1), '/', 2) AS s
    FROM pages
), hosts AS (
    SELECT DISTINCT h, {num}substr(md5(h), 1, 4){ber} % 365 AS d1, {num}substr(md5(h), 5, 4){ber} % 200 + 1 AS d2,
           {num}substr(md5(h), 9, 1){ber} AS c FROM p WHERE h <> ''
), ways AS (
    SELECT h, s, {num}substr(md5(h || '/' || s), 1, 4){ber} % 365 AS d, {num}substr(md5(h || '/' || s), 5, 1){ber} AS c
    FROM p WHERE h <> '' AND s <> ''
), domains AS (
    SELECT DISTINCT regexp_extract(h, '([^.]*[.][^.]*)$', 1) AS g FROM hosts
), e AS (
    SELECT 'malware' AS list, 'host' AS kind, h AS pattern, 'block' AS action, d1 AS d FROM hosts WHERE c < 12
    UNION ALL SELECT 'malware', 'host', h, 'remove', d1 + d2 FROM hosts WHERE c < 12
    UNION ALL SELECT 'malware', 'host', h, 'block', d1 + d2 + 30 FROM hosts WHERE c < 6
    UNION ALL SELECT 'adult', 'prefix', h || '/' || s, 'block', d FROM ways WHERE c < 5
    UNION ALL SELECT 'review', 'prefix', h || '/' || s, 'allow', d FROM ways WHERE c > 12
    UNION ALL SELECT 'phishing', 'domain', g, 'block', 300 FROM domains
    UNION ALL SELECT 'phishing', 'domain', g, 'remove', 330 FROM domains
)
SELECT list, kind, pattern, action, 1704067200 + CAST(d AS BIGINT) * 86400 AS listed FROM e
"""
CAPTURES_SQL = "SELECT page_id, url, 1704067200 + (page_id * 7919 % 525600) * 60 AS fetched FROM pages"


def _entries(num: str, ber: str) -> str:
    return ENTRIES_SQL.replace("{num}", num).replace("{ber}", ber)


def op4_urllists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    entries = spark.sql(_entries("CAST(conv(", ", 16, 10) AS BIGINT)").replace("FROM pages", "FROM {pages}"), pages=pages)
    entries = entries.withColumn("listed_at", F.timestamp_seconds("listed")).drop("listed")
    captures = spark.sql(CAPTURES_SQL.replace("FROM pages", "FROM {pages}"), pages=pages).withColumn("fetched_at", F.timestamp_seconds("fetched"))
    judged = urllists.judge(captures, entries)
    return judged.select("page_id", "url", "fetched", "verdict", "list", "pattern", F.unix_timestamp("since").alias("since"))


OP4_SQL = f"""
WITH captures AS ({CAPTURES_SQL}), entries AS ({_entries("CAST('0x' || ", " AS BIGINT)")}
), w AS (
    SELECT list, kind, pattern, listed, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS w
    FROM entries GROUP BY ALL
), v AS (
    SELECT *, lead(listed) OVER (PARTITION BY list, kind, pattern ORDER BY listed) AS until FROM w
), k AS (
    SELECT *, regexp_extract(url, '^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h,
           regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1) AS way FROM captures
), m AS (
    SELECT k.page_id, k.url, k.fetched, v.*,
           row_number() OVER (
               PARTITION BY k.page_id, k.url ORDER BY CASE kind WHEN 'url' THEN 4 WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
               length(pattern) DESC, w DESC, listed DESC, list DESC, pattern DESC) AS r
    FROM k JOIN v ON v.w > 0 AND v.listed <= k.fetched AND (v.until IS NULL OR k.fetched < v.until) AND (
        (kind = 'host' AND pattern = h)
        OR (kind = 'domain' AND (h = pattern OR ends_with(h, '.' || pattern)))
        OR (kind = 'prefix' AND (h || way = pattern OR starts_with(h || way, pattern || '/'))))
)
SELECT k.page_id, k.url, k.fetched, CASE WHEN m.w IS NULL THEN 'pass' WHEN m.w = 2 THEN 'block' ELSE 'allow' END AS verdict,
       m.list, m.pattern, m.listed AS since
FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.url = k.url AND m.r = 1
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = boilerplate.main_texts(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    archive.archive(table(spark, sf_dir, "pages"), path)
    found = archive.captures_in(spark, path)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumnRenamed("id", "doc_id")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op11_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoints.change_points(table(spark, sf_dir, "sale_lines"), key="vendor_id", value="quantity", at="shipped_at")


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_strings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_embdedup": op2_embdedup,
        "op3_mixing": op3_mixing,
        "op4_urllists": op4_urllists,
        "op5_simhash": op5_simhash,
        "op6_lm": op6_lm,
        "op7_html": op7_html,
        "op8_warc": op8_warc,
        "op9_packing": op9_packing,
        "op10_langid": op10_langid,
        "op11_changepoints": op11_changepoints,
        "op12_repeats": op12_repeats,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }


OP8_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), q AS (
    SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p
), r AS (
    SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM q
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""


VECTORS_SQL = """
raw AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), vectors AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM raw), pairs AS (
    SELECT q.vec_id AS a, x.vec_id AS b, list_reduce(list_transform(list_zip(x.v, q.v), lambda z: z[1] * z[2]), lambda a, b: a + b) / (x.n * q.n) AS score
    FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) {only}
)"""
OP1_SQL = f"""
WITH {VECTORS_SQL.replace("{only}", "AND q.vec_id % 50 = 0")}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM pairs)
SELECT a AS query_id, CAST(k AS INT) AS rank, b AS vec_id, score FROM r WHERE k <= 5
"""
OP2_SQL = f"""
WITH RECURSIVE {VECTORS_SQL.replace("{only}", "")}, near AS (SELECT a, b FROM pairs WHERE score >= 0.9), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, near.b FROM reach r JOIN near ON near.a = r.b
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT least.a AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, least.a = c AS kept FROM least LEFT JOIN links USING (a)
"""
#: For the pages of the tables at hand, which mark their article and use few character references.
OP7_SQL = rf"""
WITH a AS (
    SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages
), b AS (
    SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS blocks FROM a
), c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


#: Day by day: b is a list of (cost, segments, start), the best way to each day so far, or null.
OP11_SQL = """
WITH RECURSIVE daily AS (
    SELECT vendor_id, datediff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS d, CAST(sum(quantity) AS HUGEINT) AS s
    FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), spans AS (SELECT vendor_id, min(d) AS first, max(d) - min(d) + 1 AS n FROM daily GROUP BY vendor_id
), filled AS (
    SELECT p.vendor_id, p.first, p.n, u.k, coalesce(daily.s, 0) AS s FROM spans p, unnest(range(p.n)) AS u(k)
    LEFT JOIN daily ON daily.vendor_id IS NOT DISTINCT FROM p.vendor_id AND daily.d = p.first + u.k
), sums AS (
    SELECT vendor_id, first, n, k, sum(s) OVER w AS s, sum(s * s) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY k)
), series AS (
    SELECT vendor_id, first, n, list_prepend(0::HUGEINT, list(s::HUGEINT ORDER BY k)) AS s, list_prepend(0::HUGEINT, list(q::HUGEINT ORDER BY k)) AS q
    FROM sums GROUP BY vendor_id, first, n
), edges AS (
    SELECT vendor_id, i, j, (n * q - s * s) // (n * n) + 1 AS v, n, s AS total FROM (
        SELECT vendor_id, i.i, j.j, (j.j - i.i)::HUGEINT AS n, x.s[j.j + 1] - x.s[i.i + 1] AS s, x.q[j.j + 1] - x.q[i.i + 1] AS q
        FROM series x, unnest(range(x.n)) AS i(i), unnest(range(x.n + 1)) AS j(j)
        WHERE (j.j - i.i >= 14 OR i.i = 0 AND j.j = x.n) AND (i.i = 0 OR i.i >= 14) AND (j.j = x.n OR j.j <= x.n - 14))
), costs AS (SELECT *, CAST(n * floor(1000 * ln(v::DOUBLE)) AS BIGINT) AS cost FROM edges
), into_day AS (SELECT vendor_id, j, list({'i': i, 'cost': cost} ORDER BY i) AS e FROM costs GROUP BY vendor_id, j
), ways AS (
    SELECT vendor_id, n, 0 AS j, [{'cost': 0::BIGINT, 'k': 0, 'i': -1}] AS b FROM series
    UNION ALL
    SELECT w.vendor_id, w.n, w.j + 1, list_append(w.b, CASE WHEN e.e IS NOT NULL THEN list_sort(list_transform(
        list_filter(e.e, lambda x: w.b[x.i + 1] IS NOT NULL),
        lambda x: {'cost': w.b[x.i + 1].cost + x.cost + CASE WHEN x.i > 0 THEN 40000 ELSE 0 END, 'k': w.b[x.i + 1].k + 1, 'i': x.i::INTEGER}))[1] END)
    FROM ways w LEFT JOIN into_day e ON e.vendor_id IS NOT DISTINCT FROM w.vendor_id AND e.j = w.j + 1 WHERE w.j < w.n
), done AS (SELECT vendor_id, n, b, b[n + 1].cost AS best_cost, b[n + 1].k AS n_segments FROM ways WHERE j = n
), cuts AS (
    SELECT vendor_id, b, best_cost, n_segments, n_segments AS no, b[n + 1].i AS i, n AS j FROM done
    UNION ALL SELECT vendor_id, b, best_cost, n_segments, no - 1, b[i + 1].i, i FROM cuts WHERE i > 0
)
SELECT c.vendor_id, CAST(c.no AS INT) AS segment_no, CAST(p.first + c.i AS BIGINT) AS first_day, CAST(e.n AS BIGINT) AS n_days,
       CAST(e.total AS BIGINT) AS total, CAST(e.v AS BIGINT) AS spread, e.cost, CAST(c.n_segments AS BIGINT) AS n_segments, c.best_cost
FROM cuts c JOIN costs e ON e.vendor_id IS NOT DISTINCT FROM c.vendor_id AND e.i = c.i AND e.j = c.j
JOIN spans p ON p.vendor_id IS NOT DISTINCT FROM c.vendor_id
"""
#: Bytes as pairs of hexadecimal digits.
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (SELECT doc_id, base, substr(h, 2 * base + 1, 498) AS h FROM d, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT), 200)) AS u(base)
), g AS (
    SELECT doc_id, base + p AS p, min(doc_id) OVER (PARTITION BY substr(h, 2 * p + 1, 100)) AS first
    FROM c, unnest(range(CAST(length(h) // 2 - 49 AS BIGINT))) AS u(p)
), r AS (
    SELECT doc_id, p, p > coalesce(max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new
    FROM g WHERE doc_id > first
), n AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r
), spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, k
), pieces AS (
    SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS start FROM spans
), left_over AS (
    SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY k) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail
    FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
OP13_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
    SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
           EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
           EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
    FROM d
), m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM f GROUP BY ALL
), o(o) AS (
    SELECT '' UNION ALL SELECT o || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS l(x) WHERE NOT contains(o, x)
), s AS (
    SELECT o AS filter_order, k AS step, substr(o, k, 1) AS x, list_sum(list_transform(range(1, k), lambda i: 1 << (ord(substr(o, i, 1)) - 65)))::INT AS before,
           1 << (ord(substr(o, k, 1)) - 65) AS own FROM o, range(1, 6) AS r(k) WHERE length(o) = 5
), z AS (
    SELECT part, filter_order, step, x, sum(CASE WHEN m & own = 0 AND m & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN m & own > 0 AND m & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN m & own > 0 AND m & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN m & own > 0 AND m & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN m & own > 0 AND m & coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ann": OP1_SQL,
        "op2_embdedup": OP2_SQL,
        "op4_urllists": OP4_SQL,
        "op7_html": OP7_SQL,
        "op8_warc": OP8_SQL,
        "op11_changepoints": OP11_SQL,
        "op12_repeats": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
