"""Registered opN_ queries: each maps the given tables to an operator's records and its result back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .chat_format import link_route_calls
from .decontaminate import phrase_matches
from .filter_audit import audit_filters, read_route_files
from .label_divergence import label_divergence
from .license_scan import BASE_PHRASES, NOTICES, license_notices, mandatory_words
from .mixing import mix_routes
from .quality_rules import quality_rules
from .simhash import near_routes
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_strings
from .token_counts import count_tokens
from .toxicity import held_out, learn_grammar, score_texts
from .url_filters import judge_feed_urls

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def routes_of(docs, *more):
    """Documents as route texts: (route_id, text)."""
    return docs.select(F.col("doc_id").alias("route_id"), "text", *more)


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op1_url_filters", """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
             arg_max(rverdict, length(rhost) * 1000 + length(rpath)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p), r
      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
""")
def op1_url_filters(spark, sf):
    feeds = table(spark, sf, "pages").select(F.col("page_id").alias("dataset_id"), "url")
    judged = judge_feed_urls(feeds, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return judged.select(F.col("dataset_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op2_suffix_dedup", r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, length(h) // 2 - 99)) AS i,
             unnest(list_transform(range(0, length(h) // 2 - 99), lambda i: hash(substring(h, 2 * i + 1, 200)))) AS k FROM d WHERE length(h) >= 200),
f AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY k ORDER BY rid, i) AS n FROM w) WHERE n > 1),
e AS (SELECT rid, i, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -101) > 100 AS fresh FROM f),
g AS (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS s FROM e),
r AS (SELECT rid, s, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY rid, s),
o AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS z FROM r),
k AS (SELECT o.rid, string_agg(d.h[2 * z + 1:2 * a], '' ORDER BY a) || any_value(d.h)[2 * max(b) + 1:] AS h, sum(b - a) AS gone, count(*) AS spans
      FROM o JOIN d ON o.rid = d.rid GROUP BY o.rid)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
""")
def op2_suffix_dedup(spark, sf):
    kept = remove_strings(routes_of(table(spark, sf, "documents")))
    return kept.select(F.col("route_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_quality_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) AS t(i) WHERE len(ws) >= 5),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM h WHERE n >= 2) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: list_contains({stops}, lower(x)))) AS n_stops
      FROM w LEFT JOIN c ON w.rid = c.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars / n_words BETWEEN 2 AND 25 AND n_symbols / n_words <= 0.3
       AND n_stops / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept FROM m
""")
def op3_quality_rules(spark, sf):
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ruled = quality_rules(routes_of(table(spark, sf, "documents")))
    return ruled.select(F.col("route_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


def toxic_labels(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("route_id"), "toxic")


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    routes = routes_of(table(spark, sf, "documents"))
    scored = score_texts(routes, learn_grammar(routes, toxic_labels(spark, sf)))
    return scored.select(F.col("route_id").alias("doc_id"), held_out(F.col("route_id")).alias("held_out"), "score", "predicted")


@query("op5_simhash")
def op5_simhash(spark, sf):
    near = near_routes(routes_of(table(spark, sf, "documents")))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return near.select(F.col("route_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


@query("op6_token_counts")
def op6_token_counts(spark, sf):
    import public_tokenizers
    counted = count_tokens(routes_of(table(spark, sf, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("route_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


@query("op7_mix_sources", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS lv, coalesce(sum(source_size) OVER b, 0) AS below, coalesce(sum(w) OVER b, 0) AS passed,
             sum(source_size) OVER () AS t, sum(w) OVER () AS ws FROM w
      WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max((1.5::DOUBLE * t - 2.0::DOUBLE * below) / (ws - passed)) AS flat FROM o WHERE (1.5::DOUBLE * t - 2.0::DOUBLE * below) / (ws - passed) <= lv),
p AS (SELECT source, source_size, CASE WHEN flat IS NULL OR lv <= flat THEN cap ELSE flat * w END AS target,
             ('0x' || md5('7:' || coalesce('s' || source, 'n'))[1:5])::BIGINT::DOUBLE / 1048576.0::DOUBLE AS u FROM o, f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d),
c AS (SELECT k.doc_id, k.size, p.source_size, p.target, k.k, p.u,
             CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS r FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (least(floor((k + 1) * r + u) - floor(k * r + u), 2) * size)::BIGINT AS taken FROM c
""")
def op7_mix_sources(spark, sf):
    mixed = mix_routes(routes_of(table(spark, sf, "documents"), F.col("source").alias("label")))
    return mixed.select(F.col("route_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op8_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM d, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
f AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM w) WHERE lo < doc_id),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM f),
p AS (SELECT rid, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT p.rid, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.rid = c.rid AND p.p = c.p GROUP BY p.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
""")
def op8_substring_dedup(spark, sf):
    kept = remove_repeats(routes_of(table(spark, sf, "documents")))
    return kept.select(F.col("route_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: what a user turn must look like as a call: its own text and who speaks
TURN_SCHEMA = (("role", "string", True, 1, 20), ("text", "string", True, 1, 2000), ("turn", "int", True, 0, None))


@query("op9_chat_format", r"""
WITH c AS (SELECT true AS called, conv_id, turn, role, text, conv_id::VARCHAR || '/' || turn::VARCHAR AS id FROM conversations WHERE role = 'user'),
t AS (SELECT DISTINCT conv_id, turn FROM c),
g AS (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM t),
p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, run, turn % 2 ORDER BY turn) - 1 AS depth FROM g),
r AS (SELECT true AS given, conv_id, turn - 1 AS turn, text AS content, conv_id::VARCHAR || '/' || (turn - 1)::VARCHAR AS id FROM conversations WHERE role IS DISTINCT FROM 'user'),
j AS (SELECT coalesce(c.called, false) AS called, coalesce(r.given, false) AS given, coalesce(c.id, r.id) AS request_id,
             c.conv_id, c.turn, c.role, c.text, r.content FROM c FULL JOIN r ON c.id = r.id),
e AS (SELECT j.*, CASE WHEN NOT given THEN 'no_result' WHEN NOT called THEN 'no_call' ELSE 'linked' END AS status, p.depth,
             list_filter([CASE WHEN role IS NULL THEN 'role: missing' END, CASE WHEN length(role) < 1 THEN 'role: below 1' END,
                          CASE WHEN length(role) > 20 THEN 'role: above 20' END, CASE WHEN text IS NULL THEN 'text: missing' END,
                          CASE WHEN length(text) < 1 THEN 'text: below 1' END, CASE WHEN length(text) > 2000 THEN 'text: above 2000' END,
                          CASE WHEN j.turn IS NULL THEN 'turn: missing' END, CASE WHEN j.turn < 0 THEN 'turn: below 0' END], lambda x: x IS NOT NULL) AS errs
      FROM j LEFT JOIN p ON j.conv_id = p.conv_id AND j.turn = p.turn)
SELECT request_id, status, depth, called AND len(errs) = 0 AS valid, CASE WHEN called THEN array_to_string(errs, '; ') ELSE '' END AS errors,
       '{' || CASE WHEN called THEN coalesce('"after":"' || conv_id::VARCHAR || '/' || (turn - 2)::VARCHAR || '",', '') || '"arguments":{' || '"role":' || to_json(role)::VARCHAR ||
       CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text)::VARCHAR END || coalesce(',"turn":' || turn::VARCHAR, '') || '},' ELSE '' END ||
       CASE WHEN content IS NULL THEN '' ELSE '"content":' || to_json(content)::VARCHAR || ',' END ||
       coalesce('"request_id":' || to_json(request_id)::VARCHAR || ',', '') || '"status":"' || status || '"}' AS record FROM e
""")
def op9_chat_format(spark, sf):
    """User turns as calls that wait for the user turn before, other turns as results of the turn before them."""
    turns = table(spark, sf, "conversations")

    def name(back):
        # null where the conversation or the turn is unknown
        return F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") - back).cast("string"))

    calls = turns.filter("role <=> 'user'").select(name(0).alias("request_id"), name(2).alias("after"), F.struct("role", "text", "turn").alias("arguments"))
    results = turns.filter("NOT role <=> 'user'").select(name(1).alias("request_id"), F.col("text").alias("content"))
    linked = link_route_calls(calls, results, TURN_SCHEMA)
    return linked.select("request_id", "status", "depth", "valid", F.array_join("errors", "; ").alias("errors"), "record")


@query("op10_decontamination", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
      FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM q),
w AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM d, l, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
m AS (SELECT rid, i, w.n, item FROM w JOIN q ON w.k = q.k AND w.n = q.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN s ON d.rid = s.rid
""")
def op10_decontamination(spark, sf):
    matched = phrase_matches(routes_of(table(spark, sf, "documents")), table(spark, sf, "benchmark"))
    return matched.select(F.col("route_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                          F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def notice_pattern(markup: str) -> str:
    """A license template as a regular expression over words that each end in a space."""
    out, skip = [], False
    for part in re.split(r"(<[^>]*>)", markup):
        low, mark, given = part, part[:5], re.findall(r'"([^"]*)"', part)
        if part == "</alt>":
            skip = False
        elif mark == "<alt ":
            skip = True
            spaced = "|".join(" ".join(w.split()) + " " for w in given[0].split("|")) if "match=" in part else ""
            out.append(f"(?:{spaced})" if spaced else "(?:[^ ]+ ){" + given[0].replace("-", ",") + "}")
        elif part == "<optional>":
            out.append("(?:")
        elif part == "</optional>":
            out.append(")?")
        elif not skip:
            out.append("".join(w + " " for w in low.split()))
    return "".join(out)


def _license_sql() -> str:
    entries = [*NOTICES, *BASE_PHRASES]
    hits = ", ".join(f"CASE WHEN regexp_matches(line, ' {notice_pattern(m)}') THEN {mandatory_words(m)} END AS h{i}" for i, (_, m) in enumerate(entries))
    named = ", ".join(f"CASE WHEN h{i} IS NOT NULL THEN '{label}' END" for i, (label, _) in enumerate(entries))
    based = ", ".join(f"CASE WHEN h{i} IS NOT NULL THEN '{label}' END" for i, (label, _) in enumerate(entries) if i >= len(NOTICES))
    places = " || ".join(
        "list_filter(range(len(ws)), lambda i: " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(m.split())) + ")" for _, m in BASE_PHRASES)
    most = ", ".join(f"coalesce(h{i}, 0)" for i in range(len(entries)))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
l AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d),
h AS (SELECT doc_id, ws, {hits} FROM l),
p AS (SELECT *, {places} AS places, greatest({most}) AS most FROM h)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_filter([{based}], lambda x: x IS NOT NULL))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_filter([{named}], lambda x: x IS NOT NULL))), ',') AS labels,
       most / (most + 2)::DOUBLE AS score FROM p
"""


@query("op11_license_scan", _license_sql())
def op11_license_scan(spark, sf):
    """License notices of every document: base phrases by place, and the labels of all templates that match."""
    feeds = table(spark, sf, "documents").select(F.col("doc_id").alias("dataset_id"), F.col("text").alias("attribution"))
    places = F.filter("notices", lambda n: n["base"])["first_word"]
    return license_notices(feeds).select(
        F.col("dataset_id").alias("doc_id"), "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query("op12_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
             + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || e.letter || g.letter AS filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] AS bits
      FROM f a, f b, f c, f e, f g WHERE a.bit + b.bit + c.bit + e.bit + g.bit = 31 AND a.bit | b.bit | c.bit | e.bit | g.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) AS t(step)),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""")
def op12_filter_audit(spark, sf):
    """What five filters remove from each source, in all orders, over a stream of the document files."""
    path = f"{sf}/documents.parquet"
    docs = read_route_files(spark, path, spark.read.parquet(path).schema)
    routes = docs.select(F.col("doc_id").alias("route_id"), F.col("source").alias("label"), "text")
    judgments = table(spark, sf, "labels").select(F.col("doc_id").alias("route_id"), "quality", "toxic")
    return audit_filters(routes, judgments).withColumnRenamed("label", "part")


@query("op13_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT a.lang, a.source, a.term, a.n,
             1 + (1000000000::HUGEINT * (a.n + 2)) // (sum(a.n) OVER (PARTITION BY a.lang, a.source) + 2 * v.v) AS p FROM a JOIN v ON a.lang = v.lang),
l AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 2)) // (sum(x.n) OVER (PARTITION BY x.lang) + 2 * v.v) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) x JOIN v ON x.lang = v.lang),
s AS (SELECT p.lang, p.source, o.source AS item, sum(((p.p - o.p) * (p.p - o.p)) // (p.p + o.p)) AS value
      FROM p JOIN p o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0) AS value
      FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // (p.p + l.q) FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
""")
def op13_source_divergence(spark, sf):
    """Sources of a language by how far their terms lie apart, and the terms that set each source off."""
    docs = table(spark, sf, "documents")
    told = label_divergence(docs.select(F.col("lang").alias("borough"), F.col("source").alias("label"), "text"))
    return told.select(F.col("borough").alias("lang"), F.col("label").alias("source"), "part", "item", "value", "rank")


def _finish() -> None:
    from .quality_rules import STOP_WORDS
    stops = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"
    ORACLES["op3_quality_rules"] = ORACLES["op3_quality_rules"].replace("{stops}", stops)


_finish()
