"""One registered query per operator of this folder, over whole tables, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from . import (html_text, licenses, lm, mixing, pii, quality, ranked, sentencepiece_fst, simhash, token_counts, topk, trie,
               urls)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODEL = "piece_bpe_32k.model"
#: A deployment passes its own secret; this one makes the query's result the same everywhere.
PII_KEY = "pointweave test key"
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/"))
#: Hosts with one of these words in a label are listed.
URL_WORDS = r"(^|[.-])(casino|bets|pills|ads|spam|adult)([.-]|$)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


@query("""WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


@query()
def op2_pii(spark, sf_dir):
    return pii.pii_table(table(spark, sf_dir, "documents"), PII_KEY)


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p in sorted(
    ((entry[:entry.index("/")], entry[entry.index("/"):]) for _, entry in URL_RULES), key=lambda r: -len(r[0] + r[1])))
_ALLOWED = ", ".join(f"'{entry}'" for verdict, entry in URL_RULES if verdict == "allow")


@query(f"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
                        FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_ALLOWED}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '{URL_WORDS}') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.select(urls.host(F.col("url")).alias("entry")).filter(F.col("entry").rlike(URL_WORDS)).distinct()
    return urls.url_table(pages, URL_RULES, listed)


@query()
def op4_lm_scores(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


@query()
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model_path())


@query()
def op6_mix_sources(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    spread = " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.LEAST_SPREAD.items())

    def fences(name: str, keys: str, group: str) -> str:
        return f"""{name}_ranked AS (SELECT {keys}, measure, bucket, sum(sum(n)) OVER (PARTITION BY {keys}, measure) AS total,
    sum(sum(n)) OVER (PARTITION BY {keys}, measure ORDER BY bucket) AS below FROM sketch GROUP BY {keys}, measure, bucket),
{name}_q AS (SELECT {keys}, measure, max(total) AS docs, min(bucket) FILTER (below * 4 >= total) AS q1,
    min(bucket) FILTER (below * 4 >= total * 3) AS q3 FROM {name}_ranked GROUP BY {keys}, measure),
{name} AS (SELECT {group}, max(max(docs)) OVER (PARTITION BY {keys}) AS docs, measure,
    min(q1 - 3 * greatest(q3 - q1, CASE measure {spread} END)) AS low,
    max(q3 + 3 * greatest(q3 - q1, CASE measure {spread} END)) AS high FROM {name}_q GROUP BY {keys}, measure)"""

    inside = "\n".join(f"""LEFT JOIN (SELECT g.lang, g.source, CASE WHEN g.docs >= {quality.LEAST_DOCS} THEN o.low
    WHEN l.docs >= {quality.LEAST_DOCS} THEN l.low ELSE a.low END AS low, CASE WHEN g.docs >= {quality.LEAST_DOCS} THEN o.high
    WHEN l.docs >= {quality.LEAST_DOCS} THEN l.high ELSE a.high END AS high
    FROM (SELECT lang, source, max(docs) AS docs FROM own GROUP BY ALL) AS g
    LEFT JOIN own AS o ON o.measure = '{k}' AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
    LEFT JOIN (SELECT lang, measure, low, high, max(docs) OVER (PARTITION BY lang) AS docs FROM by_lang) AS l
    ON l.measure = '{k}' AND l.lang IS NOT DISTINCT FROM g.lang
    LEFT JOIN overall AS a ON a.measure = '{k}') AS t_{k}
    ON t_{k}.lang IS NOT DISTINCT FROM m.lang AND t_{k}.source IS NOT DISTINCT FROM m.source""" for k in quality.LEAST_SPREAD)
    kept = " AND ".join(f"coalesce(m.{k} BETWEEN t_{k}.low AND t_{k}.high, true)" for k in quality.LEAST_SPREAD)
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twins WHERE n > 1)
    GROUP BY doc_id),
c AS MATERIALIZED (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_symbols * 1000 // nullif(n_words, 0) AS symbols,
    CASE WHEN n_words >= {quality.MEAN_WORDS} THEN word_chars * 100 // n_words END AS word_length,
    n_dup_lines * 1000 // nullif(n_lines, 0) AS repeated_lines FROM c),
sketch AS MATERIALIZED (SELECT lang, source, measure, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket,
    count(*) AS n FROM (SELECT lang, source, 'symbols' AS measure, symbols AS v FROM m
    UNION ALL SELECT lang, source, 'word_length', word_length FROM m
    UNION ALL SELECT lang, source, 'repeated_lines', repeated_lines FROM m) WHERE v IS NOT NULL GROUP BY ALL),
{fences("own", "lang, source", "lang, source")},
{fences("by_lang", "lang", "lang")},
{fences("overall", "everything", "everything").replace("FROM sketch", "FROM (SELECT *, 0 AS everything FROM sketch)")}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed AS base_failed,
    NOT failed AND {kept} AS kept
FROM (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS failed FROM m) AS m
{inside}"""


@query(_quality_sql())
def op7_quality_rules(spark, sf_dir):
    return quality.quality_table(table(spark, sf_dir, "documents"))


@query()
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_fst.encoded(table(spark, sf_dir, "documents"), model_path())


@query()
def op10_licenses(spark, sf_dir):
    return licenses.license_table(table(spark, sf_dir, "documents"))


#: The given pages hold their text in one ``article`` of headings and paragraphs, so patterns can cut it out.
@query(r"""WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
blocks AS (SELECT page_id, url, string_split_regex(a, '</?(p|h1)>') AS bs FROM article),
plain AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
    '[\s\xA0]+', ' ', 'g')) FOR b IN bs] AS bs FROM blocks),
joined AS (SELECT page_id, url, array_to_string([b FOR b IN bs IF b <> ''], chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined""")
def op11_html_text(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))



def _terms_sql(table: str) -> str:
    return rf"""regexp_extract_all(translate(coalesce({table}.text, ''), '{ranked.UPPER}', '{ranked.LOWER}'), '{ranked.TERM}')"""


@query(rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("documents")} AS ts FROM documents),
g AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_terms_sql("benchmark")}) AS ts FROM benchmark),
qt AS (SELECT i, item_id, unnest(ts) AS term FROM q),
tf AS MATERIALIZED (SELECT r, doc_id, any_value(length) AS length, term, count(*) AS tf
    FROM (SELECT r, doc_id, len(ts) AS length, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * length * n) // l)))) AS BIGINT) AS score
    FROM qt JOIN tf USING (term) JOIN w USING (term), g GROUP BY i, item_id, r, doc_id),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10""")
def op12_ranked_search(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 10)

#: CRC-32 of a conversation's number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda v, b: xor(v >> 1, 3988292384 * (v & 1)))))"""


@query(f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
head AS (SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
taken AS (SELECT conv_id, count(*) AS k FROM head GROUP BY conv_id),
r AS (SELECT * FROM head UNION ALL SELECT conv_id, t.pos - c.h + coalesce(k, 0), t.role, t.text FROM t JOIN c USING (conv_id)
    LEFT JOIN taken USING (conv_id) WHERE t.pos > c.h),
p AS MATERIALIZED (SELECT conv_id, d, length(text) AS chars,
    string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars FROM p GROUP BY path, d),
child AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
above AS (SELECT path, d, n, chars, unnest(range(0, d + 1)) AS up FROM node),
below AS (SELECT left(a.path, 32 * a.up) AS path, count(*) FILTER (child.k IS NULL) AS leaves, sum((a.n - 1) * a.chars) AS saved
    FROM above AS a LEFT JOIN child ON child.path = a.path GROUP BY 1),
last AS (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs,
    coalesce(child.k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
    sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (path) LEFT JOIN child USING (path) LEFT JOIN ends USING (path)
LEFT JOIN node AS parent ON node.d > 0 AND parent.path = left(node.path, 32 * (node.d - 1))""")
def op13_conversation_trie(spark, sf_dir):
    return trie.trie(table(spark, sf_dir, "conversations"))
