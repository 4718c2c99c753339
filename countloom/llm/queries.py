"""The named queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_token_counts(spark, sf):
    import public_tokenizers

    from countloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_exact_dedup(spark, sf):
    from countloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf, "documents"))


ORACLES["op8_exact_dedup"] = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@_query
def op9_mixing(spark, sf):
    from countloom.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf, "documents"))


@_query
def op5_language_id(spark, sf):
    import public_tokenizers

    from countloom.llm.language_id import held_out, identify, train

    docs = _table(spark, sf, "documents")
    model = train(docs.where(~held_out("doc_id", 3, 1)), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@_query
def op10_quality(spark, sf):
    from countloom.llm.language_id import held_out
    from countloom.llm.quality import score, train

    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    model = train(docs.where(~held_out("doc_id", 5, 0)), labels.where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@_query
def op7_near_dedup(spark, sf):
    from countloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf, "documents"))


@_query
def op1_decontamination(spark, sf):
    from countloom.llm.decontamination import contaminated

    return contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@_query
def op2_html_text(spark, sf):
    from countloom.llm.html_text import main_text, train

    pages = _table(spark, sf, "pages")
    return main_text(pages, train(pages))


@_query
def op4_lm_scoring(spark, sf):
    from pyspark.sql import functions as F

    from countloom.llm.language_id import held_out
    from countloom.llm.lm_scoring import score_texts

    found = score_texts(_table(spark, sf, "documents"), ~held_out("doc_id", 7, 2))
    return found.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), *[F.col(c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")])


def crawl_records(pages):
    """A crawl log over the pages: each page in full, a later not-modified visit to it under another spelling of its URL, and
    a not-modified visit to its host's front page; every fiftieth page also answers for its host's front page."""
    from pyspark.sql import functions as F

    i, tag = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    host = F.regexp_extract(F.col("url"), r"^[^/]*//([^/?#]*)", 1)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def rows(kind, url, seconds, full, headers):
        pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
        given = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
        return pages.select(text(kind, i).alias("record_id"), url.alias("url"), F.timestamp_seconds(i * 3600 + seconds).alias("date"), F.lit(full).alias("is_response"), given.alias("headers"), F.col("html" if full else "url").alias("payload"))

    later = F.when(i % 5 == 0, '"other"').when(i % 5 > 1, text('W/"', tag, '"'))
    page = rows("page-", F.col("url"), 0, True, {"etag": text('"', tag, '"'), "content-type": F.lit("text/html"), "date": text("d", i), "last-modified": text("m", i), "cache-control": F.lit("max-age=60")})
    again = rows("again-", F.concat(F.regexp_replace("url", "^https?", "HTTP"), F.lit("#again")), 432_000, False, {"etag": later, "last-modified": F.when(i % 5 == 1, text("m", i)), "cache-control": F.lit("max-age=90"), "content-length": F.lit("0"), "date": text("d", i + 5)})
    visit = rows("visit-", F.concat(F.lit("http://www."), F.upper(host), F.lit(":80/?utm_source=x")), 1800, False, {"etag": F.lit('"f0"'), "x-cache": F.lit("hit")})
    front = rows("front-", F.concat(F.lit("https://"), host), 0, True, {"etag": text('"f', i % 100, '"'), "content-type": F.lit("text/html")}).where(F.regexp_extract("record_id", r"(\d+)$", 1).cast("long") % 50 == 0)
    return page.unionByName(again).unionByName(visit).unionByName(front)


@_query
def op6_revisits(spark, sf):
    from pyspark.sql import functions as F

    from countloom.llm.revisits import header_lines, resolve_revisits, with_payload

    records = crawl_records(_table(spark, sf, "pages"))
    found = with_payload(resolve_revisits(records), records.where("is_response").select("record_id", "payload"))
    return found.select("record_id", "canonical", "is_response", "response_id", "status", header_lines("headers").alias("headers"), F.length("payload").cast("long").alias("n_chars"))


ORACLES["op6_revisits"] = r"""
WITH p AS (SELECT page_id AS i, url, html, md5(coalesce(html, '')) AS tag, regexp_extract(url, '^[^/]*//([^/?#]*)', 1) AS host FROM pages),
r AS (
    SELECT 'page-' || i AS record_id, url, i * 3600 AS t, true AS is_response, '"' || tag || '"' AS etag, 'm' || i AS modified, 'd' || i AS d, 'max-age=60' AS cache, 'text/html' AS kind, NULL AS size, NULL AS hit, html FROM p
    UNION ALL SELECT 'again-' || i, regexp_replace(url, '^https?', 'HTTP') || '#again', i * 3600 + 432000, false, CASE WHEN i % 5 = 0 THEN '"other"' WHEN i % 5 > 1 THEN 'W/"' || tag || '"' END, CASE WHEN i % 5 = 1 THEN 'm' || i END, 'd' || (i + 5), 'max-age=90', NULL, '0', NULL, NULL FROM p
    UNION ALL SELECT 'visit-' || i, 'http://www.' || upper(host) || ':80/?utm_source=x', i * 3600 + 1800, false, '"f0"', NULL, NULL, NULL, NULL, NULL, 'hit', NULL FROM p
    UNION ALL SELECT 'front-' || i, 'https://' || host, i * 3600, true, '"f' || (i % 100) || '"', NULL, NULL, NULL, 'text/html', NULL, NULL, html FROM p WHERE i % 50 = 0
),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM r),
c AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS h, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$'))), '&') AS q
    FROM b
),
u AS (SELECT *, h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM c),
a AS (
    SELECT *, last_value(CASE WHEN is_response THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY t, is_response, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM u
),
j AS (
    SELECT a.*, f.etag AS fe, f.modified AS fm, f.d AS fd, f.cache AS fc, f.kind AS fk, f.html AS fh,
        CASE WHEN a.is_response THEN 'response' WHEN a.before IS NULL THEN 'no_earlier_response'
            WHEN a.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN regexp_replace(a.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
            WHEN a.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN a.modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'no_validator' END AS status
    FROM a LEFT JOIN u f ON f.record_id = a.before AND NOT a.is_response
)
SELECT record_id, canonical, is_response, CASE WHEN is_response THEN record_id ELSE before END AS response_id, status,
    CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: ' || coalesce(cache, fc), 'content-type: ' || fk, 'date: ' || coalesce(d, fd), 'etag: ' || coalesce(etag, fe), 'last-modified: ' || coalesce(modified, fm))
        ELSE concat_ws(chr(10), 'cache-control: ' || cache, 'content-length: ' || size, 'content-type: ' || kind, 'date: ' || d, 'etag: ' || etag, 'last-modified: ' || modified, 'x-cache: ' || hit) END AS headers,
    CASE WHEN is_response THEN length(html) WHEN status = 'resolved' THEN length(fh) END AS n_chars
FROM j
"""


@_query
def op13_conversation_repair(spark, sf):
    from countloom.llm.conversation_repair import damage_and_repair

    return damage_and_repair(_table(spark, sf, "conversations"))


def _repair_sql() -> str:
    """The edits as a fold over each conversation's rows. A state is a string: its cost in twelve digits, then its edits, so
    that the least string is the cheapest and, of those, the least edit list. States: empty, system, user, assistant."""
    add = lambda cell, cost, letter: f"lpad(CAST(CAST(substr({cell}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({cell}, 13) || '{letter}'"
    none = "'900000000000'"
    stays = "NOT (r.fault IN ('blank', 'duplicate'))"
    extra = "CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END"
    keep = lambda s, i: f"CASE WHEN {stays} AND r.initial = '{i}' THEN {add(f's[{s}]', extra, 'K')} ELSE {none} END"
    rerole = lambda s: f"CASE WHEN {stays} THEN {add(f's[{s}]', f'1 + {extra}', 'R')} ELSE {none} END"
    drop = lambda s: add(f"s[{s}]", 2, "D")
    user = ", ".join([drop(3), *[keep(s, "u") for s in (1, 2, 4)], *[rerole(s) for s in (1, 2, 4)]])
    moved = f"[{drop(1)}, least({drop(2)}, {keep(1, 's')}), least({user}), least({drop(4)}, {keep(3, 'a')}, {rerole(3)})]"
    opened = lambda rows: f"list_transform(list_transform([{rows}], lambda t: [t[1], t[2], least(t[3], {add('t[1]', 5, 'I')}, {add('t[2]', 5, 'I')}, {add('t[4]', 5, 'I')}), t[4]]), lambda t: [t[1], t[2], t[3], least(t[4], {add('t[3]', 5, 'I')})])[1]"
    begin = opened(f"['000000000000', {none}, {none}, {none}]")
    crc = "list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT))"
    # The repaired rows, as a fold over the edits: place in the rows, roles so far as initials, and the text.
    return f"""
WITH k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor({crc}, 4294967295) % 20 AS h FROM k),
d AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
    FROM h WHERE h <> 0
),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS p, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (
    SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS before,
        CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM o
),
c AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'initial': initial, 'fault': fault}} ORDER BY p) AS rows, list(role ORDER BY p) AS roles, list(text ORDER BY p) AS texts
    FROM f GROUP BY conv_id
),
s AS (SELECT *, list_reduce(rows, lambda s, r: {opened(moved)}, {begin}) AS s FROM c),
b AS (SELECT *, least(s[1], s[4]) AS best FROM s),
a AS (SELECT *, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM b),
r AS (
    SELECT *, list_reduce(string_split(audit, ''), lambda w, e: CASE e WHEN '' THEN w WHEN 'D' THEN [CAST(CAST(w[1] AS BIGINT) + 1 AS VARCHAR), w[2], w[3]] ELSE list_transform([
            CASE WHEN e = 'K' THEN roles[CAST(w[1] AS BIGINT)] WHEN right(w[2], 1) = 'u' THEN 'assistant' ELSE 'user' END], lambda role: [
            CAST(CAST(w[1] AS BIGINT) + CASE WHEN e = 'I' THEN 0 ELSE 1 END AS VARCHAR), w[2] || substr(role, 1, 1),
            w[3] || CASE WHEN w[2] = '' THEN '' ELSE chr(10) END || role || ':' || CASE WHEN e = 'I' THEN '' ELSE texts[CAST(w[1] AS BIGINT)] END])[1] END, ['1', '', ''])[3] AS repaired
    FROM a
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


ORACLES["op13_conversation_repair"] = _repair_sql()


@_query
def op12_collocations(spark, sf):
    from countloom.llm.collocations import collocations

    return collocations(_table(spark, sf, "documents"))


ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
    SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= 30),
s AS (
    SELECT c.lang, c.k, c.phrase, c.f AS a, cut, list_aggregate(string_split(c.phrase, ' ')[1:cut], 'string_agg', ' ') AS x, list_aggregate(string_split(c.phrase, ' ')[cut + 1:], 'string_agg', ' ') AS y
    FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < c.k
),
t AS (
    SELECT s.*, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
    FROM s JOIN f l ON l.lang = s.lang AND l.phrase = s.x JOIN f r ON r.lang = s.lang AND r.phrase = s.y
),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM t),
u AS (
    SELECT DISTINCT lang, k, f, list_aggregate(string_split(phrase, ' ')[i:i + m - 1], 'string_agg', ' ') AS inner_phrase
    FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k
),
o AS (SELECT lang, inner_phrase, max(f) AS above FROM u GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.inner_phrase = b.phrase WHERE first = 1 AND (above IS NULL OR 100 * above < 80 * a)),
z AS (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang)
SELECT * FROM z WHERE rank <= 2000
"""


@_query
def op11_personal_data(spark, sf):
    from countloom.llm.pii import find_private, train

    docs = _table(spark, sf, "documents")
    return find_private(docs, train(docs))
