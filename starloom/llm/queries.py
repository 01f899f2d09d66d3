"""The registered query of each operator, with production parameters, and its DuckDB counterpart where SQL can say it."""

from __future__ import annotations


from fractions import Fraction

import public_tokenizers
from pyspark.sql import functions as F

from starloom.llm import bpe, collocations, decontamination, html, ngram_join, packing, quality, secrets, sharding, spelling, topk, urls, warc
from starloom.llm.tables import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

# Fixed rules of the URL filter: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def packing_encoder():
    """Tokenizer of the packing query: the ids of byte_bpe_50k.json, by its vocabulary's rank file."""
    path = public_tokenizers.path
    return packing.rank_file_tokenizer(path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, path("byte_bpe_50k.json"))


@query(
    "op1_ngram_jaccard_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s FROM w),
    classes AS MATERIALIZED (SELECT min(doc_id) AS k, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
    tokens AS MATERIALIZED (SELECT k, n, unnest(s) AS t FROM classes),
    pairs AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM tokens a JOIN tokens b ON a.t = b.t AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
    edges AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)),
    sides AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges),
    reach AS (SELECT k, k AS c FROM classes UNION SELECT sides.v, reach.c FROM reach JOIN sides ON reach.k = sides.u),
    named AS (SELECT k, min(c) AS component_id FROM reach GROUP BY k)
    SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN named USING (k)""",
)
def _(spark, sf_dir):
    found = ngram_join.ngram_jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, threshold=Fraction(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op2_hierarchical_packing")
def _(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing_encoder)


@query(
    "op3_warc_revisits",
    """
    WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    o AS (SELECT d, n, max(page_id) AS original FROM h WHERE n >= 1000 GROUP BY d, n)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
      CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to
    FROM h LEFT JOIN o USING (d, n)""",
)
def _(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=1000)


def _secrets_sql() -> str:
    """The patterns over whole texts with places from the lengths between matches; links as interval joins on the document."""

    def spans(kind: str, pattern: str, group: int, least: int, most: int) -> str:
        quoted = pattern.replace("'", "''")
        return f"""SELECT rid, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS ord,
            CAST(list_sum(list_transform(between[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(whole[i]) AS n
          FROM (SELECT rid, whole, grp, between, unnest(generate_series(1, len(whole))) AS i FROM (SELECT rid, regexp_extract_all(t, '{quoted}', 0) AS whole,
            regexp_extract_all(t, '{quoted}', {group}) AS grp, string_split_regex(t, '{quoted}') AS between FROM d)) WHERE length(grp[i]) BETWEEN {least} AND {most}"""

    far = 1 << 30
    parts = [
        spans("assign", secrets.ASSIGN, 2, 6, far), spans("access", secrets.ACCESS, 0, 20, far), spans("hex", secrets.HEX, 0, 24, far),
        spans("client", secrets.CLIENT, 2, 3, far), spans("key", secrets.KEY, 0, 40, 40), spans("endpoint", secrets.ENDPOINT, 0, 1, far),
    ]
    near = lambda kinds: f"EXISTS (SELECT 1 FROM p q WHERE q.rid = p.rid AND q.kind IN ({kinds}) AND q.s < p.e + {secrets.SCOPE} AND q.e > p.s - {secrets.SCOPE})"
    identifier, secret, endpoint = near("'access', 'client'"), near("'assign', 'hex', 'key'"), near("'endpoint'")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
    p AS MATERIALIZED (SELECT *, s + n AS e FROM ({" UNION ALL ".join(parts)})),
    r AS (SELECT * FROM p WHERE ord < 3 OR (NOT EXISTS (SELECT 1 FROM p q WHERE q.rid = p.rid AND q.ord < 3 AND q.s < p.e AND q.e > p.s)
      AND ((kind = 'key' AND {identifier}) OR (kind = 'client' AND {secret} AND {endpoint}) OR (kind = 'endpoint' AND {identifier} AND {secret})))),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, ord) AS spans FROM r GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


@query("op4_credential_linking", _secrets_sql())
def _(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query(
    "op5_url_filter",
    """
    WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    parsed AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM pages),
    best AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM parsed JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (rid)""",
)
def _(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_quality_rules")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit_decision_list(documents, table(spark, sf_dir, "labels"))
    judged = quality.apply_quality_rules(documents, rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[f"quality_statistics.{c}" for c in counts], "base_failed", "kept", "quality_rule")


@query("op7_merge_replay")
def _(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query(
    "op8_threshold_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
)
def _(spark, sf_dir):
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def _sharding_sql(shards: int, seed: int) -> str:
    """Row numbers by id, the rounds as a fold over their keys, the walk as a fold over its steps, and the checksum byte by byte."""
    keys = ", ".join(f"[{m}, {c}, {s}, {i % 2}]" for i, (m, c, s) in enumerate(sharding.round_keys(seed)))
    residue = lambda v: f"(((({v}) * k[1] + k[2]) % {sharding.PRIME}) * ((({v}) + k[3]) % {sharding.PRIME}) % {sharding.PRIME})"
    rounds = f"""list_reduce([[y // b, y % b], {keys}], lambda s, k: CASE WHEN k[4] = 0 THEN [(s[1] + {residue("s[2]")}) % a, s[2]] ELSE [s[1], (s[2] + {residue("s[1]")}) % b] END)"""
    return f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
      xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
    n AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents)),
    numbered AS MATERIALIZED (SELECT d.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, n, a, (n + a - 1) // a AS b FROM d, n),
    walk AS (SELECT row_number AS r, row_number AS y, 0 AS step, n, a, b FROM numbered
      UNION ALL SELECT r, s[1] * b + s[2], step + 1, n, a, b FROM (SELECT *, {rounds} AS s FROM walk WHERE step = 0 OR y >= n)),
    placed AS (SELECT r AS row_number, y FROM walk WHERE step > 0 AND y < n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INTEGER) AS shard, y // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
    FROM numbered JOIN placed USING (row_number)"""


@query("op9_feistel_sharding", _sharding_sql(24, 20240229))
def _(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24, seed=20240229)


@query("op10_site_templates")
def _(spark, sf_dir):
    return html.extract_main_text(table(spark, sf_dir, "pages"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_spelling_variants",
    rf"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    summed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM counted, crc),
    typed AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM summed),
    words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    cut AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    pairs AS (SELECT a.word AS u, b.word AS v, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
      UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word),
    near AS (SELECT u, count(*) AS n_near, max(m) AS most, arg_min(v, (-m, v)) AS best FROM pairs GROUP BY u),
    forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN best END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM words LEFT JOIN near ON u = word),
    chain AS (SELECT word, word AS reached, 0 AS step FROM forms UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.reached WHERE forms.form IS NOT NULL),
    ends AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
)
def _(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"), typo_every=31)


@query(
    "op12_decontamination",
    rf"""
    WITH words AS (SELECT *, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS piece
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
    places AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS piece
      FROM (SELECT rid, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM words, (SELECT DISTINCT size FROM windows))),
    found AS MATERIALIZED (SELECT DISTINCT rid, i, places.size, item_id FROM places JOIN windows USING (piece, size)),
    hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid),
    ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT rid, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)""",
)
def _(spark, sf_dir):
    found = decontamination.contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated")


@query(
    "op13_phrase_collocations",
    rf"""
    WITH pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
    inner_parts AS (SELECT lang, p[s:s + m - 1] AS p, max(a) AS most FROM (SELECT lang, p, a, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
    kept AS (SELECT f.* FROM f LEFT JOIN inner_parts i ON f.lang = i.lang AND f.p = i.p WHERE f.k > 1 AND (most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * f.a)),
    cuts AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
    scored AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:c] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[c + 1:cuts.k]),
    best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
)
def _(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
