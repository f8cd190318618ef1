"""Queries opN_<name>: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_resampling

    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import positions

    return positions(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with the first turns, up to five, of the first of its hundred."""
    from .prefix_trie import prefix_trie, turns_in_order, with_shared_heads

    turns = turns_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie(*with_shared_heads(turns, 100, F.crc32(F.col("conv_id").cast("string")) % 6))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the damaged table, every conversation of the original one."""
    from .repair import damaged, structure_repair

    conversations = table(spark, sf_dir, "conversations")
    return structure_repair(damaged(conversations), conversations)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the row of labels with its id."""
    from .url_filter import label_outcomes, url_filter

    return url_filter(table(spark, sf_dir, "pages"), label_outcomes(table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_importance_resampling": op3_importance_resampling,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_order_minhash": op6_order_minhash,
    "op7_warc": op7_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_url_filter": op13_url_filter,
}


def _crc32_sql(ascii_text: str) -> str:
    """crc32 bit by bit: a byte is taken in, then eight shifts, shown as -1, follow."""
    steps = f"flatten(list_transform(string_split({ascii_text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


def _trie_sql() -> str:
    """Nodes are lists of turns; sums over subtrees go up the members' paths."""
    return f"""
        WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c.conv_id, c.l AS own, coalesce(b.l, []) AS base, CAST({_crc32_sql("CAST(c.conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM t c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100),
        r AS (SELECT conv_id, list_concat(base[1:h], own[h + 1:]) AS l FROM h),
        o AS (SELECT conv_id, d, l[1:d] AS p, len(l) AS n, CASE WHEN d > 0 THEN length(l[d].text) ELSE 0 END AS size FROM r, unnest(range(len(l) + 1)) AS u(d)),
        k AS (SELECT *, sha256(CAST(p AS VARCHAR)) AS node FROM o),
        n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, (count(*) - 1) * any_value(size) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM k GROUP BY node, d),
        up AS (SELECT DISTINCT below.node AS node, above.node AS top FROM k below JOIN k above ON above.conv_id = below.conv_id AND above.d <= below.d),
        s AS (SELECT top, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM up JOIN n USING (node) GROUP BY top),
        e AS (SELECT DISTINCT c.node AS child, a.node AS parent FROM k c JOIN k a ON a.conv_id = c.conv_id AND a.d = c.d - 1),
        m AS (SELECT parent, count(*) AS children FROM e GROUP BY parent)
        SELECT n.conv_id, n.d AS depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s ON s.top = n.node LEFT JOIN e ON e.child = n.node LEFT JOIN n pn ON pn.node = e.parent LEFT JOIN m ON m.parent = n.node
    """


def _url_sql() -> str:
    """Priors from suffix to domain to host, each level's spread by the method of moments."""

    def rho(name: str, level: str) -> str:
        return f"""{name} AS (SELECT CASE WHEN coalesce(sum(mu * (1 - mu) * (n - 1)) FILTER (n > 0), 0) = 0 THEN 0.1e0
                ELSE least(0.99e0, greatest(0.001e0, (sum(n * pow(bad / n - mu, 2)) FILTER (n > 0) - sum(mu * (1 - mu)) FILTER (n > 0)) / sum(mu * (1 - mu) * (n - 1)) FILTER (n > 0))) END AS rho FROM {level})"""

    kappa = "(mu * (1 - mu) / (rho * (mu * (1 - mu) - var) + var) - 1)"
    prior = "* REPLACE (a / (a + b) AS mu, a * b / ((a + b) * (a + b) * (a + b + 1)) AS var)"

    two = "('ac.uk', 'co.in', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.au', 'org.uk')"
    last = lambda n: f"array_to_string(l[-{n}:], '.')"
    return f"""
        WITH u AS (SELECT row_number() OVER () AS row, page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        told AS (SELECT doc_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
        c AS (SELECT host, count(bad)::DOUBLE AS n, (count(*) FILTER (bad))::DOUBLE AS bad FROM u LEFT JOIN told ON doc_id = page_id GROUP BY host),
        split AS (SELECT *, string_split(bare, '.') AS l FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$', ''), '[.]$', '') AS bare FROM c)),
        h0 AS (SELECT host, n, bad, CASE WHEN regexp_matches(bare, '^[0-9.]*$|^[[]') THEN bare WHEN {last(2)} IN {two} THEN {last(3)} ELSE {last(2)} END AS domain,
                      CASE WHEN regexp_matches(bare, '^[0-9.]*$|^[[]') THEN bare WHEN {last(2)} IN {two} THEN {last(2)} ELSE {last(1)} END AS suffix FROM split),
        d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h0 GROUP BY ALL),
        s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM c) AS mu, 0e0 AS var FROM d0 GROUP BY suffix),
        {rho("rs", "s1")},
        d1 AS (SELECT {prior} FROM (SELECT d.*, mu, var, s.bad - d.bad + {kappa} * mu AS a, s.n - d.n - (s.bad - d.bad) + {kappa} * (1 - mu) AS b FROM d0 d JOIN s1 s USING (suffix), rs)),
        {rho("rd", "d1")},
        h1 AS (SELECT {prior} FROM (SELECT h.*, mu, var, d.bad - h.bad + {kappa} * mu AS a, d.n - h.n - (d.bad - h.bad) + {kappa} * (1 - mu) AS b FROM h0 h JOIN d1 d USING (domain, suffix), rd)),
        {rho("rh", "h1")},
        h2 AS (SELECT host, n, bad + {kappa} * mu AS a, n - bad + {kappa} * (1 - mu) AS b FROM h1, rh),
        h AS (SELECT host, n, greatest(0, a / (a + b) - 1.645e0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS bound FROM h2),
        rules AS (FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(says, place, start)),
        best AS (SELECT page_id, u.host, path, max(CASE WHEN starts_with(path, start) THEN {{'size': length(place || start), 'says': says, 'rule': place || start}} END) AS r
                 FROM u LEFT JOIN rules ON u.host = place OR ends_with(u.host, '.' || place) GROUP BY row, page_id, u.host, path)
        SELECT page_id, host, path, r.rule AS rule, coalesce(r.says, CASE WHEN bound > 0.3e0 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bad_bound, CAST(n AS BIGINT) AS n_labelled
        FROM best JOIN h USING (host)
    """


def _secret_sql() -> str:
    """Spans from the lengths of gaps and matches, rule by rule."""
    from .secrets import BASE_RULES, RULES

    text = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, g[1:i] AS gaps, w[1:i - 1] AS earlier, w[i] AS whole, p[i] AS part, {rank} AS rank, '{rule.kind}' AS kind, {rule.shortest} AS shortest
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS p FROM {text} WHERE regexp_matches(t, '{pattern}')))""")
    size = lambda c: f"coalesce(list_sum(list_transform({c}, lambda x: length(x))), 0)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    listed = "coalesce(string_agg(kind || ':' || pos || ':' || (pos + length(whole)), ',' ORDER BY pos, rank){}, '')"
    return f"""
        WITH m AS ({" UNION ALL ".join(parts)}),
        s AS (SELECT doc_id, rank, kind, whole, CAST({size("gaps")} + {size("earlier")} AS BIGINT) AS pos FROM m WHERE length(part) >= shortest),
        a AS (SELECT doc_id, {counts}, {listed.format(f" FILTER (rank < {len(BASE_RULES)})")} AS base, {listed.format("")} AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
    """


ORACLE_SQL = {
    "op11_prefix_trie": _trie_sql(),
    "op13_url_filter": _url_sql(),
    "op8_secret_scan": _secret_sql(),
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               max(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
                     min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d
    """,
}
