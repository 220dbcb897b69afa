"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, exact, hyperminhash, jaccard, mixing, packing, pii, quality, runs, substring, topk, urls, warc
from .common import WORD

WORDS_SQL = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


THRESHOLD = 0.3
# Of the queries over invented data only; the operator takes its key from the caller.
PSEUDONYM_KEY = b"tidemark query key"


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.remove_repeated(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS words FROM documents),
    starts AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
    windows AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS seq FROM starts),
    ranked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS place FROM windows),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS n FROM ranked WHERE place > 1),
    lost AS (SELECT doc_id, list(n) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
    FROM w LEFT JOIN lost USING (doc_id)"""


# A stand-in for dated block lists, derived from the pages' own hosts: a host's hash says whether and when its domain,
# the host itself and a part of its paths are listed, delisted and listed again. Days count from 2024.
def _list_events(pages: DataFrame) -> DataFrame:
    host = urls.url_host(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")
    hosts = hosts.withColumn("x", number)
    domain = F.regexp_replace("host", r"^[^.]*\.", "")

    def events(when, name: str, kind: str, pattern, verdict: str, day, listed: bool) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1704067200) + day * 86400)
        return hosts.where(when).select(
            F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), at.alias("at"), F.lit(listed).alias("listed")
        )

    x = F.col("x")
    parts = [
        events(x % 3 == 0, "spam", "domain", F.col("host"), "block", x % 300, True),
        events(x % 3 == 0, "spam", "domain", F.col("host"), "block", x % 300 + 40, False),
        events(x % 6 == 0, "spam", "domain", F.col("host"), "block", x % 300 + 60, True),
        events(x % 16 == 1, "parents", "domain", domain, "block", x % 350, True),
        events(x % 16 == 3, "parents", "domain", domain, "block", x % 350, False),
        events(x % 5 == 0, "paths", "prefix", F.concat("host", F.lit("/en/")), "block", x % 200, True),
        events(x % 10 == 0, "paths", "prefix", F.concat("host", F.lit("/en/")), "allow", x % 200 + 90, True),
        events(x % 7 == 0, "trusted", "domain", F.col("host"), "allow", x % 250, True),
        events(x % 14 == 0, "trusted", "domain", F.col("host"), "allow", x % 250 + 30, False),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    seconds = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(400 * 24)) * 3600
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(seconds))
    found = urls.filter_urls(captures, _list_events(pages))
    return found.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


OP4_SQL = r"""
    WITH captures AS (
        SELECT page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % 9600) * 3600) AS t,
               lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS rest FROM pages),
    paths AS (SELECT *, CASE WHEN rest = '' THEN '/' ELSE rest END AS path FROM captures),
    hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS x FROM captures WHERE host <> ''),
    raw AS (
        SELECT 'spam' AS list_name, 'domain' AS kind, host AS pattern, 'block' AS verdict, x % 300 AS day, true AS listed FROM hosts WHERE x % 3 = 0
        UNION ALL SELECT 'spam', 'domain', host, 'block', x % 300 + 40, false FROM hosts WHERE x % 3 = 0
        UNION ALL SELECT 'spam', 'domain', host, 'block', x % 300 + 60, true FROM hosts WHERE x % 6 = 0
        UNION ALL SELECT 'parents', 'domain', regexp_replace(host, '^[^.]*\.', ''), 'block', x % 350, true FROM hosts WHERE x % 16 = 1
        UNION ALL SELECT 'parents', 'domain', regexp_replace(host, '^[^.]*\.', ''), 'block', x % 350, false FROM hosts WHERE x % 16 = 3
        UNION ALL SELECT 'paths', 'prefix', host || '/en/', 'block', x % 200, true FROM hosts WHERE x % 5 = 0
        UNION ALL SELECT 'paths', 'prefix', host || '/en/', 'allow', x % 200 + 90, true FROM hosts WHERE x % 10 = 0
        UNION ALL SELECT 'trusted', 'domain', host, 'allow', x % 250, true FROM hosts WHERE x % 7 = 0
        UNION ALL SELECT 'trusted', 'domain', host, 'allow', x % 250 + 30, false FROM hosts WHERE x % 14 = 0),
    events AS (SELECT list_name, kind, pattern, verdict, to_timestamp(1704067200 + day * 86400) AS at, bool_or(listed) AS listed FROM raw GROUP BY ALL),
    state AS (
        SELECT p.page_id, e.list_name, e.kind, e.pattern, e.verdict, arg_max(e.listed, e.at) AS listed
        FROM paths p JOIN events e ON e.at <= p.t AND p.host <> '' AND CASE e.kind
             WHEN 'domain' THEN p.host = e.pattern OR p.host LIKE ('%.' || e.pattern)
             WHEN 'prefix' THEN starts_with(p.host || p.path, e.pattern) ELSE p.host || p.path = e.pattern END
        GROUP BY ALL),
    ranked AS (
        SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY
               CASE kind WHEN 'domain' THEN 1 WHEN 'prefix' THEN 2 ELSE 3 END DESC,
               CASE kind WHEN 'domain' THEN len(string_split(pattern, '.')) WHEN 'prefix' THEN len(string_split(pattern, '/')) ELSE 0 END DESC,
               verdict <> 'block', list_name) AS place
        FROM state WHERE listed)
    SELECT p.page_id, p.url, strftime(p.t AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS fetched_at, p.host, coalesce(r.n, 0)::BIGINT AS n_matches,
           coalesce(r.verdict = 'block', false) AS blocked, r.list_name, r.kind, r.pattern
    FROM paths p LEFT JOIN ranked r ON p.page_id = r.page_id AND r.place = 1"""


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, folder, "documents"), PSEUDONYM_KEY)
    return found.withColumn("found", F.to_json("found"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_table(spark, folder, "documents"), largest=True)


OP6_SQL = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP7_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
    pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                     list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
              FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
    SELECT * FROM ranked WHERE rank <= 20"""


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "cut_words")


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, folder, "documents"))


OP9_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
        UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) IN (1, 2)),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node)
    SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, (SELECT min(least) FROM reach WHERE node = d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes z USING (doc_id)"""


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(400 * 24)) * 3600)
    return warc.archive(pages, fetched=fetched).drop("uri")


OP10_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f"""


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.collocations(_table(spark, folder, "documents"))


OP11_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
    totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    places AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS size) WHERE len(words) >= size),
    f AS MATERIALIZED (
        SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
    cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    scored AS (
        SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1:], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    parts AS (SELECT c.lang, c.a, array_to_string(c.words[i:i + n - 1], ' ') AS phrase
              FROM c, (SELECT unnest(range(2, 4)) AS n), (SELECT unnest(range(1, 4)) AS i) WHERE n < c.size AND i + n - 1 <= c.size),
    longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
    alone AS (SELECT s.* FROM lowest s LEFT JOIN longer g USING (lang, phrase) WHERE g.most IS NULL OR 100 * g.most::HUGEINT < 80 * s.a::HUGEINT)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
    FROM alone JOIN totals USING (lang) QUALIFY rank <= 2000"""


def op12_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, folder, "documents"))


OP12_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
        UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (
        SELECT a, b FROM both_have JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node),
    found AS (SELECT node AS doc_id, min(least) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents JOIN found USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which about one in ten repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    found = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("words"))
    found = found.withColumn("n", F.size("words").cast("long"))
    found = found.withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    found = found.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    root = F.expr("slice(words, int(a) + 1, int(p))")
    times = F.expr("int((n - a) div p) + 1")
    repeated = F.slice(F.concat(F.expr("slice(words, 1, int(a))"), F.flatten(F.array_repeat(root, times))), F.lit(1), F.col("n").cast("int"))
    return found.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(_with_repeats(_table(spark, folder, "documents")))
    # Runs come by start, then period, so the first of equal ones stays.
    best = F.reduce(
        "runs",
        F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"),
        lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filters": op4_url_filters,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

# The others have no SQL form: they train, permute by key, pack greedily, iterate to balance, or look for runs.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op4_url_filters": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_exact_topk": OP7_SQL,
    "op9_ngram_join": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_minhash_dedup": OP12_SQL,
}
