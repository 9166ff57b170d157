"""The operators of this subpackage as named queries over the given tables, with their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridgelog.llm.centroids import clustered
from ridgelog.llm.chat import as_mails, format_conversations
from ridgelog.llm.decontam import contamination
from ridgelog.llm.extract import extract_main_text
from ridgelog.llm.licenses import scan_licenses, template_table
from ridgelog.llm.periods import run_report
from ridgelog.llm.pii import personal_data
from ridgelog.llm.quality import fit_rules, judge_quality
from ridgelog.llm.shards import shard_documents
from ridgelog.llm.simhash import near_duplicates
from ridgelog.llm.sptok import encode, read_model
from ridgelog.llm.urlrules import Rule, judge_urls, rules_table
from ridgelog.llm.warc import read_archive, write_archive
from ridgelog.session import checkpointed, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: the vocabulary of the first operator; a parameter of it
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
# The rules of the third operator.
URL_RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is tested against a brute-force version."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sentencepiece_ids")
def op1_sentencepiece_ids(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), read_model(MODEL_PATH))


@query("op2_simhash_groups")
def op2_simhash_groups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def _fits(rule: Rule) -> str:
    return f"(('.' || host) LIKE '%.{rule.host}' AND starts_with(path, '{rule.path}'))"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r.host + r.path))


@query(
    "op3_url_rules",
    f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
whole AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM parts)
SELECT page_id, host, path,
 CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.host}{r.path}'" for r in _BY_LENGTH)} END AS rule,
 CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM whole""",
)
def op3_url_rules(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(
    "op4_benchmark_windows",
    f"""WITH doc AS (SELECT doc_id, {_words('text')} AS w FROM documents),
item AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + 9) AS g FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
gram AS (SELECT DISTINCT g FROM win),
place AS (SELECT doc_id, s, z, list_slice(w, s, s + z - 1) AS g FROM doc, (SELECT DISTINCT len(g) AS z FROM gram), unnest(range(1, len(w) - z + 2)) AS t(s)),
hit AS (SELECT doc_id, s, z, g FROM place SEMI JOIN gram USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + z)) AS t(p) GROUP BY doc_id),
found AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (g)),
lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
coded AS (SELECT row_number() OVER () AS code, g FROM gram),
placed AS (SELECT code, i, g[i] AS word FROM coded, unnest(range(1, len(g) + 1)) AS t(i)),
posting AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc) SEMI JOIN placed USING (word)),
often AS (SELECT word, count(*) AS n FROM posting GROUP BY word),
rare AS (SELECT code, arg_min(word, (n, i)) AS word, arg_min(i, (n, i)) AS i FROM placed LEFT JOIN often USING (word) GROUP BY code HAVING bool_and(n IS NOT NULL)),
low AS (SELECT DISTINCT doc_id, code, p - i - d AS low FROM posting JOIN rare USING (word), unnest(range(0, 3)) AS t(d)),
near AS (SELECT doc_id, code, low FROM low JOIN coded USING (code) JOIN placed USING (code) JOIN posting USING (doc_id, word)
 WHERE p BETWEEN low + i AND low + i + 2 GROUP BY doc_id, code, low HAVING count(DISTINCT i) = max(len(g))),
beside AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN coded USING (code) JOIN win USING (g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id) LEFT JOIN beside USING (doc_id)""",
)
def op4_benchmark_windows(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)


@query("op5_main_text")
def op5_main_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op6_license_notices")
def op6_license_notices(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"), template_table(spark))


@query("op7_minimax_shards")
def op7_minimax_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


@query("op9_personal_data")
def op9_personal_data(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


@query(
    "op10_quotation_links",
    r"""WITH before AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
own AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(one, ''), '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S'))) AS a,
 len(list_filter(regexp_split_to_array(coalesce(two, ''), '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S'))) AS b,
 role, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') AS own FROM before)
SELECT conv_id, turn, role, own, CASE WHEN a > 0 THEN turn - 1 END AS reply_to, min(turn) OVER (PARTITION BY conv_id) AS root,
 turn - min(turn) OVER (PARTITION BY conv_id) AS depth, a + b AS n_quoted, a + b AS n_linked, turn - min(turn) OVER (PARTITION BY conv_id) AS position FROM own""",
)
def op10_quotation_links(spark, sf_dir):
    mails = checkpointed(as_mails(table(spark, sf_dir, "conversations")), "mails")
    return format_conversations(mails)


def _centroid_rounds(clusters: int, rounds: int, dim: int, scale: int, salt: str) -> str:
    """The rounds of the eleventh operator one after the other, with all distances in every round."""
    nearest = "SELECT id, vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.*, c.k, list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n} AS c) GROUP BY id, vec_id, x"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('{salt}' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))",
    ]
    for n in range(rounds):
        parts += [
            f"a{n} AS MATERIALIZED ({nearest.format(n=n)})",
            f"s{n} AS (SELECT k, i, count(*) AS n, sum(x[i]) AS s FROM a{n}, range(1, {dim + 1}) AS t(i) GROUP BY k, i)",
            f"m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY k)",
            f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{n} AS o LEFT JOIN m{n} AS m USING (k))",
        ]
    parts.append(f"e AS ({nearest.format(n=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM e JOIN c{rounds} USING (k)"""


@query("op11_centroid_clusters", _centroid_rounds(8, 10, 64, 1024, "3:"))
def op11_centroid_clusters(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


@query(
    "op12_page_archive",
    """WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sums AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM page),
bits AS (SELECT *, list_reduce(list_transform(string_split(hex, ''), lambda c: right(bin(strpos('0123456789abcdef', c) + 15), 4)), lambda a, b: a || b) AS b FROM sums)
SELECT page_id, payload_bytes,
 list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda j: CAST(substr(b, 1 + 5 * i + j, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), lambda a, c: a || c) AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits""",
)
def op12_page_archive(spark, sf_dir):
    path = scratch_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return run_report(table(spark, sf_dir, "documents"), plant=True)
