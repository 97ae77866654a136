"""Checked queries over settings, searches, stored documents, feedback and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.oracle import BASE, RULES, SQL, conf, flat, lit, say, scored, trim, u16
from checks.page_checks import HOST, TITLE, joined
from checks.queries import query
from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.joins import latest_by
from pagegauge.operators import chunks as H, feedback as B, models as M, rollup as R, scorers as S, search as Q, settings as G, store as D
from pagegauge.operators.topics import topics as topics_of

# --- settings -----------------------------------------------------------------
# Customers serve as users' per-site switches: a site and a module by key.

PAGE_HOST = f"regexp_replace({HOST}, '^www\\.', '')"
SITE_OFF = f"SELECT DISTINCT {PAGE_HOST} AS host FROM pages WHERE {PAGE_HOST} LIKE 'm.%'"
SWITCHES = f"""SELECT {PAGE_HOST} AS host, {I.MODULE_BY.format('page_id')} AS module, bool_and(page_id % 4 = 1) AS enabled
    FROM pages GROUP BY 1, 2"""
GLOBAL_OFF = ["defuseRagebait"]


def settings(spark, sf) -> G.Settings:
    from pagegauge.functions.urls import host_of
    pages = I.table(spark, sf, "pages").select(host_of(F.col("url")).alias("host"), "page_id")
    # Users switched everything off on mobile sites.
    off = pages.where(F.startswith("host", F.lit("m."))).select(F.concat(F.lit("https://www."), "host").alias("host"))
    switches = pages.withColumn("module", F.expr(I.MODULE_BY.format("page_id"))).groupBy("host", "module").agg(
        F.bool_and(F.col("page_id") % 4 == 1).alias("enabled"))
    names = F.explode(F.array(*[F.lit(m) for m in V.MODULE_NAMES]))
    module = I.table(spark, sf, "region").select(names.alias("module")).distinct().withColumn(
        "enabled", ~F.col("module").isin(GLOBAL_OFF)).withColumn("block_page_ads", F.lit(None).cast("boolean"))
    return G.Settings(off, switches, module)


@query
def enabled_modules(spark, sf):
    gated = G.enabled_modules(I.table(spark, sf, "pages").select("page_id", "url"), settings(spark, sf))
    return gated.select("page_id", "host", joined("modules").alias("modules"))


_M = ", ".join(f"CASE WHEN {lit(m)} NOT IN ('defuseRagebait') AND NOT coalesce(list_contains(off, {lit(m)}), false) THEN {lit(m)} END"
               for m in V.MODULE_ASPECT)
_RULES = f"""x AS ({SITE_OFF}), w AS (SELECT host, list(module) FILTER (NOT enabled) AS off FROM ({SWITCHES}) GROUP BY host),
    p AS (SELECT page_id, {PAGE_HOST} AS host FROM pages)"""
SQL["enabled_modules"] = f"""WITH {_RULES} SELECT page_id, p.host, CASE WHEN x.host IS NOT NULL THEN '' ELSE concat_ws(',', {_M}) END AS modules
    FROM p LEFT JOIN x ON p.host = x.host LEFT JOIN w ON p.host = w.host"""


@query
def ad_gate(spark, sf):
    return G.ad_blocking_enabled(I.table(spark, sf, "pages").select("page_id", "url"), settings(spark, sf)).select(
        "page_id", "block_ads")


SQL["ad_gate"] = f"""WITH {_RULES} SELECT page_id, x.host IS NULL AND NOT coalesce(list_contains(off, 'adBlocker'), false) AS block_ads
    FROM p LEFT JOIN x ON p.host = x.host LEFT JOIN w ON p.host = w.host"""


@query
def domain_defaults(spark, sf):
    """Shipped switches of every site with an even page id under the users' own."""
    from pagegauge.functions.urls import host_of
    pages = I.table(spark, sf, "pages").select(host_of(F.col("url")).alias("host"), "page_id")
    shipped = pages.groupBy("host").agg(F.max("page_id").alias("n")).select(
        "host", F.explode(F.array(F.lit("factChecker"), F.lit("biasDetector"))).alias("module"), (F.col("n") % 2 == 0).alias("enabled"))
    return G.apply_domain_defaults(settings(spark, sf).site_module, shipped)


SQL["domain_defaults"] = f"""WITH u AS ({SWITCHES}), s AS (SELECT host, unnest(['factChecker', 'biasDetector']) AS module, n % 2 = 0 AS enabled
      FROM (SELECT {PAGE_HOST} AS host, max(page_id) AS n FROM pages GROUP BY 1))
    SELECT coalesce(u.host, s.host) AS host, coalesce(u.module, s.module) AS module, coalesce(u.enabled, s.enabled) AS enabled
    FROM u FULL JOIN s ON u.host = s.host AND u.module = s.module"""


@query
def off_list(spark, sf):
    return G.off_list(settings(spark, sf).site_module)


_NAME = "CASE module " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.MODULE_NAMES.items()) + " ELSE module END"
_PLACE = "CASE module " + " ".join(f"WHEN {lit(k)} THEN {i}" for i, k in enumerate(V.MODULE_NAMES)) + " ELSE -1 END"
SQL["off_list"] = f"""SELECT host, (count(*) FILTER (NOT enabled))::INT AS n_off,
    coalesce(string_agg({_NAME}, ', ' ORDER BY {_PLACE}) FILTER (NOT enabled), '') AS modules_off FROM ({SWITCHES}) GROUP BY host"""


@query
def off_by_default(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", F.expr(
        "CASE page_id % 4 WHEN 0 THEN 'https://www.gov.uk/x' WHEN 1 THEN 'nhs.uk' WHEN 2 THEN 'http://parliament.uk' ELSE url END").alias("url"))
    return G.off_by_default(pages, G.shipped_rules(spark), "factChecker").select("page_id", "off_by_default")


SQL["off_by_default"] = "SELECT page_id, page_id % 4 < 3 AS off_by_default FROM pages"


@query
def current_bundle(spark, sf):
    """Orders as stored bundle versions of 40 bundles."""
    bundles = I.table(spark, sf, "orders").select(
        F.concat(F.lit("bundle-"), (F.col("o_custkey") % 40).cast("string")).alias("bundle_id"),
        (F.col("o_orderkey") % 50).alias("version"), F.col("o_orderkey").alias("updated_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "bundled").otherwise("remote").alias("source"),
        F.when(F.col("o_orderstatus") != "P", F.create_map(
            F.col("o_orderpriority"), F.create_map(F.lit("factChecker"), F.col("o_totalprice") > 100000))).alias("data"))
    newest = G.current_bundle(bundles)
    return newest.join(G.bundle_site_rules(newest.select("data")).groupBy("host").count(), F.get(F.map_keys("data"), F.lit(0)) == F.col("host")).select(
        "bundle_id", "version", "updated_at", "source", "host", "count")


SQL["current_bundle"] = """WITH b AS (SELECT concat('bundle-', o_custkey % 40) AS bundle_id, o_orderkey % 50 AS version, o_orderkey AS updated_at,
      CASE WHEN o_orderkey % 2 = 0 THEN 'bundled' ELSE 'remote' END AS source, o_orderpriority AS host FROM orders WHERE o_orderstatus <> 'P'),
    n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY version DESC, updated_at) = 1)
    SELECT *, count(*) OVER (PARTITION BY host) AS count FROM n"""

# --- searches -----------------------------------------------------------------

_HAS = lambda w: f"contains(lower(concat(text, ' ', title)), {lit(w)})"


def _search(spark, sf, q):
    return Q.search(I.chunks(spark, sf), q, ["text", "title"]).select("doc_id")


@query
def search_and(spark, sf):
    return _search(spark, sf, Q.search_all("headline", "lang:en ing"))


SQL["search_and"] = f"SELECT doc_id FROM ({I.CHUNKS}) WHERE {_HAS('headline')} AND {_HAS('ing')} AND lang = 'en'"


@query
def search_or(spark, sf):
    return _search(spark, sf, Q.search_any("Trick OR secrets", Q.with_any_prop(None, "lang", ["de", "fr"])))


SQL["search_or"] = f"SELECT doc_id FROM ({I.CHUNKS}) WHERE {_HAS('trick')} OR {_HAS('secrets')} OR lang IN ('de', 'fr')"


@query
def search_brackets(spark, sf):
    return _search(spark, sf, '(headline OR trick) AND (lang:en OR source:src1) AND "what happens"')


SQL["search_brackets"] = f"""SELECT doc_id FROM ({I.CHUNKS}) WHERE ({_HAS('headline')} OR {_HAS('trick')})
    AND (lang = 'en' OR source = 'src1') AND {_HAS('what happens')}"""


@query
def search_prop(spark, sf):
    """Terms changed step by step: a property replaced, a word taken out, a JSON field."""
    q = Q.search_without(Q.with_prop("event_type:view rare k:7", "event_type", "click"), "rare")
    events = I.table(spark, sf, "events")
    return Q.search(events, q, ["event_type"], props="props").select("event_id")


SQL["search_prop"] = "SELECT event_id FROM events WHERE event_type = 'click' AND props->>'$.k' = '7'"


WHOLE = 1_000_000_000_000


@query
def saved_searches(spark, sf):
    """Saved searches matched against all documents. The first two words of part names and of texts are sought with English,
    any of them (even ids) or all; of whole part names any word is sought, of whole texts all words in their language."""
    docs, parts = I.chunks(spark, sf), I.table(spark, sf, "part")
    names = parts.select(F.col("p_partkey").alias("query_id"), F.split(F.lower("p_name"), " ").alias("w"))
    words = docs.select((F.col("doc_id") + 1_000_000).alias("query_id"), F.split(F.lower(T.collapse_space(F.col("text"))), " ", 3).alias("w"))
    op = F.when(F.col("query_id") % 2 == 0, " OR ").otherwise(" AND ")
    two = F.transform(F.slice("w", 1, 2), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    heads = names.unionByName(words).select(
        "query_id", F.concat_ws("", F.get(two, F.lit(0)), op, F.get(two, F.lit(1)), op, F.lit("lang:en")).alias("query"))
    clean = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")
    any_of = parts.select((F.col("p_partkey") + WHOLE).alias("query_id"), F.array_join(clean(F.col("p_name")), " OR ").alias("query"))
    all_of = docs.select(
        (F.col("doc_id") + 2 * WHOLE).alias("query_id"),
        F.concat_ws(" AND ", clean(F.col("text")), F.concat(F.lit("lang:"), "lang")).alias("query"))
    hits = Q.match_saved_searches(docs, heads.unionByName(any_of).unionByName(all_of), ["doc_id"], "text", ["lang"], totals=True)
    return hits.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


_BAG = "list_distinct(list_append(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), concat('lang:', lang)))"
_CLEANED = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
SQL["saved_searches"] = f"""WITH docs AS ({I.CHUNKS}),
    q AS (SELECT p_partkey AS query_id, string_split(lower(p_name), ' ') AS w FROM part
      UNION ALL SELECT doc_id + 1000000, string_split(lower({flat('text')}), ' ') FROM docs),
    t AS (SELECT query_id, list_distinct(list_filter([{_CLEANED.format("coalesce(w[1], '')")}, {_CLEANED.format("coalesce(w[2], '')")}, 'lang:en'],
      lambda x: x <> '')) AS terms FROM q),
    bag AS (SELECT doc_id, unnest({_BAG}) AS word FROM docs),
    heads AS (SELECT query_id, doc_id, count(*) AS n, any_value(len(terms)) AS n_terms FROM (SELECT query_id, terms, unnest(terms) AS word FROM t) u
      JOIN bag USING (word) GROUP BY query_id, doc_id),
    bags AS (SELECT doc_id, list_append({_WORDS.format('text')}, concat('lang:', lang)) AS bag FROM docs),
    posted AS (SELECT doc_id, unnest(bag) AS word FROM bags),
    often AS (SELECT word, count(*) AS n FROM posted GROUP BY word),
    rarest AS (SELECT doc_id, arg_min(word, (n, word)) AS word FROM posted JOIN often USING (word) GROUP BY doc_id),
    hit AS (
      SELECT doc_id, query_id FROM heads WHERE query_id % 2 = 0 OR n = n_terms
      UNION ALL SELECT DISTINCT doc_id, p_partkey + {WHOLE} FROM (SELECT p_partkey, unnest({_WORDS.format('p_name')}) AS word FROM part) JOIN posted USING (word)
      UNION ALL SELECT b.doc_id, q.doc_id + {2 * WHOLE} FROM rarest r JOIN posted p ON p.word = r.word JOIN bags q ON q.doc_id = r.doc_id
        JOIN bags b ON b.doc_id = p.doc_id WHERE list_has_all(b.bag, q.bag))
    SELECT query_id, count(*) AS n, min(doc_id) AS first FROM hit GROUP BY query_id"""


@query
def list_items(spark, sf):
    """Newest 25 chunks that hold a word; times come from the key."""
    items = I.chunks(spark, sf).select(
        F.col("doc_id").alias("id"), "text", "title", (F.col("doc_id") * 37 % 1009).alias("updated"))
    return Q.list_items(items, "headline", "updated desc, id asc", 25, ["title", "text"]).select("id", "updated")


SQL["list_items"] = f"""SELECT doc_id AS id, doc_id * 37 % 1009 AS updated FROM ({I.CHUNKS}) WHERE contains(lower(title), 'headline')
    OR contains(lower(text), 'headline') ORDER BY updated DESC, id LIMIT 25"""


@query
def filter_pages(spark, sf):
    return Q.filter_pages(H.html_to_text(I.pages(spark, sf)), "ER").select("page_id")


@query
def list_view(spark, sf):
    items = I.chunks(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("url"), "title", "text",
        F.when(F.col("doc_id") % 3 == 0, F.lit("{}")).alias("analysis"))
    return H.list_view(items)


SQL["list_view"] = f"""SELECT doc_id AS id, '-' AS url, coalesce(nullif(title, ''), '-') AS title,
    coalesce(nullif(concat(substr(text, 1, 100), CASE WHEN length(text) > 100 THEN '...' ELSE '' END), ''), '-') AS preview,
    doc_id % 3 = 0 AS has_analysis FROM ({I.CHUNKS})"""

# --- stored documents --------------------------------------------------------------
# Customers are the stored items, orders the log of changes to them.

OP = "CASE WHEN o_orderkey % 11 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'insert' ELSE 'update' END"


def change_tables(spark, sf):
    base = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("note"))
    log = I.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.expr(OP).alias("op"), F.col("o_orderkey").alias("ts"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("new "), F.col("o_custkey").cast("string"))).alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("note"))
    return base, log


@query
def apply_changes(spark, sf):
    return D.apply_changes(*change_tables(spark, sf), ["id"])


_FIELDS = {"name": "CASE WHEN o_orderkey % 5 = 0 THEN concat('new ', o_custkey) END",
           "amount": "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END", "note": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END"}
SQL["apply_changes"] = f"""WITH e AS (SELECT c_custkey AS id, 'insert' AS op, -1 AS ts, c_name AS name, c_acctbal AS amount, c_mktsegment AS note
      FROM customer
      UNION ALL SELECT o_custkey, {OP}, o_orderkey, {', '.join(_FIELDS.values())} FROM orders),
    r AS (SELECT id, max(ts) AS reset, arg_max(op, ts) AS last FROM e WHERE op <> 'update' GROUP BY id),
    l AS (SELECT e.* FROM e JOIN r ON e.id = r.id AND e.ts >= r.reset AND r.last = 'insert')
    SELECT id, {', '.join(f'arg_max({f}, ts) FILTER ({f} IS NOT NULL) AS {f}' for f in _FIELDS)}, nullif(max(ts), -1) AS updated FROM l GROUP BY id"""


@query
def pack_unpack_props(spark, sf):
    """Customers packed to id, name and a JSON remainder, and unpacked again; the column wins."""
    items = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    packed = D.pack_props(items, ["id", "name"])
    return D.unpack_props(packed.withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name"))), "nation int, segment string, name string")


SQL["pack_unpack_props"] = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_nationkey AS nation,
    c_mktsegment AS segment FROM customer"""


@query
def merge_props(spark, sf):
    """Events as partial JSON updates of 150 stored user documents."""
    base = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.to_json(F.struct("c_name", "c_nationkey")).alias("props"))
    log = I.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("ts"),
        F.to_json(F.create_map(F.col("event_type"), F.get_json_object("props", "$.k"))).alias("props"))
    merged = D.merge_props(base, log, ["id"])
    return merged.select("id", F.explode("props").alias("field", "value"))


SQL["merge_props"] = """SELECT user_id AS id, event_type AS field, arg_max(props->>'$.k', event_id) AS value FROM events GROUP BY ALL
    UNION ALL SELECT c_custkey, unnest(['c_name', 'c_nationkey']), unnest([c_name, c_nationkey::VARCHAR]) FROM customer"""


@query
def lookup_fingerprint(spark, sf):
    """Documents by the fingerprint of their first line, the first of each."""
    docs = I.documents(spark, sf).select(F.col("doc_id").alias("id"), T.first_line(F.col("text")).alias("url"), F.lit("").alias("title"))
    marked = D.with_fingerprint(docs)
    return D.lookup_fingerprint(marked, marked).select("id")


SQL["lookup_fingerprint"] = f"""WITH d AS (SELECT doc_id AS id, {flat("split_part(text, chr(10), 1)")} AS line FROM documents)
    SELECT min(id) AS id FROM d GROUP BY line"""


@query
def latest_orders(spark, sf):
    return latest_by(I.table(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


SQL["latest_orders"] = "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey"

# --- feedback ---------------------------------------------------------------------

FB = I.FEEDBACK.replace("AS string", "AS VARCHAR")
REASON = f"""CASE WHEN coalesce(chunk_fingerprint, '') = '' THEN {lit(V.FEEDBACK_ERRORS['fingerprint'])}
    WHEN coalesce(chunk_url, '') = '' THEN {lit(V.FEEDBACK_ERRORS['url'])}
    WHEN aspect_type NOT IN ({', '.join(lit(a) for a in V.ASPECTS)}) THEN {lit(V.FEEDBACK_ERRORS['aspect'])}
    WHEN applies IS NULL THEN {lit(V.FEEDBACK_ERRORS['applies'])}
    WHEN length(message) > 500 THEN {lit(V.FEEDBACK_ERRORS['message_long'])} END"""
OKAY = f"ok AS (SELECT * FROM ({FB}) WHERE {REASON} IS NULL)"


@query
def feedback_ingest(spark, sf):
    ok, bad = B.ingest_feedback(I.feedback(spark, sf))
    both = ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("feedback_id", "reject_reason")


SQL["feedback_ingest"] = f"SELECT feedback_id, {REASON} AS reject_reason FROM ({FB})"


@query
def feedback_build(spark, sf):
    built = B.build_feedback(I.feedback(spark, sf).drop("aspect_type"))
    return built.select("feedback_id", "aspect_type", "error", "message")


_ASPECT = "CASE module_id " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.FEEDBACK_MODULE_ASPECT.items()) + " END"
SQL["feedback_build"] = f"""SELECT feedback_id, {_ASPECT} AS aspect_type, CASE WHEN {_ASPECT} IS NULL THEN 'Unknown analysis module'
    WHEN length(message) > 500 THEN 'Message too long (max 500)' END AS error,
    CASE WHEN NOT applies THEN nullif({trim('message')}, '') END AS message FROM ({FB})"""

_KNOWN = "SELECT p_partkey AS chunk_id, concat('fp', p_partkey % 25) AS fingerprint FROM part"


def _known_chunks(spark, sf):
    return I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("fp"), (F.col("p_partkey") % 25).cast("string")).alias("fingerprint"))


@query
def feedback_resolve(spark, sf):
    ok, _ = B.ingest_feedback(I.feedback(spark, sf))
    linked, _ = B.resolve_feedback(ok, _known_chunks(spark, sf))
    return linked.select("feedback_id", "chunk_fingerprint", "chunk_id")


SQL["feedback_resolve"] = f"""WITH {OKAY}, k AS (SELECT fingerprint, min(chunk_id) AS chunk_id FROM ({_KNOWN}) GROUP BY 1)
    SELECT feedback_id, chunk_fingerprint, chunk_id FROM ok LEFT JOIN k ON chunk_fingerprint = fingerprint"""


@query
def feedback_stubs(spark, sf):
    ok, _ = B.ingest_feedback(I.feedback(spark, sf))
    return B.resolve_feedback(ok, _known_chunks(spark, sf))[1]


SQL["feedback_stubs"] = f"""WITH {OKAY} SELECT CAST('0x' || substr(md5(chunk_fingerprint), 1, 15) AS BIGINT) AS stub_id, chunk_fingerprint AS fingerprint, arg_min(chunk_url, feedback_id) AS url,
    first(chunk_title ORDER BY feedback_id) AS title, coalesce(first(chunk_title ORDER BY feedback_id), arg_min(chunk_url, feedback_id)) AS text
    FROM ok WHERE chunk_fingerprint NOT IN (SELECT fingerprint FROM ({_KNOWN})) GROUP BY chunk_fingerprint"""


@query
def feedback_tally(spark, sf):
    ok, _ = B.ingest_feedback(I.feedback(spark, sf))
    return B.tally_feedback(ok)


SQL["feedback_tally"] = f"""WITH {OKAY}, v AS (SELECT chunk_fingerprint, aspect_type, coalesce(user_id, concat('#', feedback_id)) AS voter,
      arg_max(applies, feedback_id) AS applies, count(*) AS n FROM ok GROUP BY 1, 2, 3)
    SELECT chunk_fingerprint, aspect_type, count(*) FILTER (applies) AS applies, count(*) FILTER (NOT applies) AS applies_not,
      sum(n)::BIGINT AS n_events FROM v GROUP BY 1, 2"""

# --- models -------------------------------------------------------------------------

REPLY = """CASE doc_id % 9
  WHEN 0 THEN concat('Here: {"score": 0.', cast(doc_id % 10 AS string), ', "confidence": 0.8, "flags": ["loaded", "x"], "explanation": "because"}')
  WHEN 1 THEN concat('{"problemScore": 1.', cast(doc_id % 10 AS string), ', "score": 0.1, "confidence": 0}')
  WHEN 2 THEN concat('I think the Score: 0.', cast(doc_id % 7 AS string), '5 fits')
  WHEN 3 THEN 'no idea at all'
  WHEN 4 THEN '{"score": broken'
  WHEN 5 THEN '{"labels": ["risk", "safe"], "scores": [0.7, 0.3], "candidateLabels": ["risk", "safe"]}'
  WHEN 6 THEN concat('{"labels": ["other", "safe"], "scores": [0.9, 0.', cast(doc_id % 10 AS string), '], "candidateLabels": ["risk", "safe"]}')
  WHEN 7 THEN '   '
  END"""


def _replies(spark, sf):
    return I.documents(spark, sf).select("doc_id", F.expr(REPLY).alias("reply"))


@query
def model_replies(spark, sf):
    """Replies read for two modules that differ in defaults and flags."""
    replies = _replies(spark, sf).where("reply is not null")
    both = M.parse_model_replies(replies, "biasDetector", ["doc_id"]).unionByName(
        M.parse_model_replies(replies, "clickUnbait", ["doc_id"]))
    return both.select(
        "doc_id", "module", F.round("problem_score", 6).alias("problem_score"), F.round("confidence", 6).alias("confidence"),
        joined("flags").alias("flags"), "explanation", F.col("metadata")["biasDirection"].alias("direction"))


_SQL_REPLY = REPLY.replace("AS string", "AS VARCHAR")
_D = lambda x: f"({x})::DOUBLE"
_LOW, _MID, _HIGH = V.BIAS_EXPLANATIONS
SQL["model_replies"] = f"""WITH r AS (SELECT doc_id, {_SQL_REPLY} AS reply FROM documents),
    k AS (SELECT r.*, module, CASE WHEN module = 'biasDetector' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS dflt FROM r, (SELECT unnest(['biasDetector', 'clickUnbait']) AS module) WHERE reply IS NOT NULL),
    s AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN (doc_id % 10) / 10.0 WHEN 1 THEN 1 WHEN 2 THEN (doc_id % 7) / 10.0 + 0.05 WHEN 3 THEN dflt WHEN 4 THEN dflt
        WHEN 5 THEN 0.7 WHEN 6 THEN 1 - (doc_id % 10) / 10.0 ELSE dflt END::DOUBLE AS v,
      CASE doc_id % 9 WHEN 0 THEN 0.8 WHEN 1 THEN 0.7 WHEN 5 THEN 0.7 WHEN 6 THEN 0.9 ELSE 0.5 END::DOUBLE AS c FROM k)
    SELECT doc_id, module, round(v, 6) AS problem_score, c AS confidence,
      CASE WHEN module = 'clickUnbait' THEN concat(CASE WHEN doc_id % 9 = 0 THEN 'loaded,x' ELSE '' END,
          CASE WHEN v >= 0.4 THEN CASE WHEN doc_id % 9 = 0 THEN ',clickbait' ELSE 'clickbait' END ELSE '' END)
        WHEN doc_id % 9 = 0 THEN 'loaded,x' WHEN doc_id % 9 IN (5, 6) AND v > 0.45 THEN 'local_zero_shot' ELSE '' END AS flags,
      CASE WHEN doc_id % 9 = 0 THEN 'because' WHEN doc_id % 9 = 1 THEN 'Analysis completed' WHEN doc_id % 9 NOT IN (5, 6) THEN reply
        WHEN module = 'clickUnbait' THEN CASE WHEN v >= 0.4 THEN 'Headline looks like clickbait (withholding or sensational framing).' ELSE 'Headline appears straightforward.' END
        WHEN v < 0.2 THEN {lit(_LOW)} ELSE concat(CASE WHEN v < 0.5 THEN {lit(_MID[0] + 'neutral' + _MID[1])} ELSE {lit(_HIGH[0] + 'neutral' + _HIGH[1])} END,
          CASE WHEN v > 0.45 THEN 'local_zero_shot' ELSE '' END, CASE WHEN v < 0.5 THEN {lit(_MID[2])} ELSE {lit(_HIGH[2])} END) END AS explanation,
      CASE WHEN module = 'biasDetector' THEN 'neutral' END AS direction FROM s"""


@query
def zero_shot(spark, sf):
    """Embeddings as model output: the first three components, as scores of labels in an order given by the label."""
    rows = I.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(F.abs(x.cast("double")), 4)).alias("scores"),
        F.expr("CASE label % 3 WHEN 0 THEN array('spam scam', 'real content', 'x') WHEN 1 THEN array('real content', 'y') ELSE array('z') END").alias("labels"),
        F.array(*[F.lit(x) for x in V.ZERO_SHOT_LABELS["antiManipulation"]]).alias("candidate_labels"))
    return M.score_zero_shot(rows, "antiManipulation", ["vec_id"]).select(
        "vec_id", F.round("problem_score", 4).alias("problem_score"), F.round("confidence", 4).alias("confidence"),
        joined("flags").alias("flags"), "explanation")


_ML, _MM, _MH = V.MANIPULATION_EXPLANATIONS
SQL["zero_shot"] = f"""WITH s AS (SELECT vec_id, round(abs(embedding[1]::DOUBLE), 4) AS a, label FROM embeddings),
    t AS (SELECT vec_id, a, CASE label % 3 WHEN 0 THEN least(a, 1) WHEN 1 THEN greatest(0, 1 - a) ELSE 0.5::DOUBLE END AS v FROM s)
    SELECT vec_id, round(v, 4) AS problem_score, greatest(0.5::DOUBLE, least(0.95::DOUBLE, a)) AS confidence, CASE WHEN v > 0.45 THEN 'local_zero_shot' ELSE '' END AS flags,
    CASE WHEN v < 0.2 THEN {lit(_ML)} WHEN v < 0.5 THEN concat({lit(_MM[0])}, CASE WHEN v > 0.45 THEN 'local_zero_shot' ELSE '' END, {lit(_MM[1])})
      ELSE concat({lit(_MH[0])}, 'local_zero_shot', {lit(_MH[1])}) END AS explanation FROM t"""


@query
def score_with_fallback(spark, sf):
    replies = _replies(spark, sf).withColumn("error", F.when(F.col("doc_id") % 9 == 3, "time out")).where("reply is not null")
    scores = M.score_with_fallback(I.chunks(spark, sf), replies, "antiManipulation", ["doc_id"])
    meta = F.col("metadata")
    return scores.select(
        "doc_id", "model", F.round("problem_score", 6).alias("problem_score"), "explanation",
        meta["localModelSkipped"].alias("skipped"), meta["localModelError"].alias("failed"), meta["localModel"].alias("used"))


SQL["score_with_fallback"] = f"""WITH {BASE}, h AS (SELECT doc_id, score, {say('antiManipulation')} AS text FROM {scored('antiManipulation')}),
    z AS (SELECT *, doc_id % 9 AS k, {_SQL_REPLY} AS reply FROM h),
    m AS (SELECT *, k IN (0, 1, 2, 4, 5, 6) AS used, CASE k WHEN 0 THEN (doc_id % 10) / 10.0 WHEN 1 THEN 1 WHEN 2 THEN (doc_id % 7) / 10.0 + 0.05 WHEN 4 THEN 0.05
      WHEN 5 THEN 0.7 ELSE 1 - (doc_id % 10) / 10.0 END::DOUBLE AS v FROM z)
    SELECT doc_id, CASE WHEN used THEN 'model' ELSE 'heuristic' END AS model, round(CASE WHEN used THEN v ELSE score END, 6) AS problem_score,
      CASE WHEN NOT used THEN text WHEN k = 0 THEN 'because' WHEN k = 1 THEN 'Analysis completed' WHEN k IN (2, 4) THEN reply
        WHEN v < 0.2 THEN {lit(_ML)} WHEN v < 0.5 THEN concat({lit(_MM[0])}, CASE WHEN v > 0.45 THEN 'local_zero_shot' ELSE '' END, {lit(_MM[1])})
        ELSE concat({lit(_MH[0])}, 'local_zero_shot', {lit(_MH[1])}) END AS explanation,
      CASE WHEN k = 8 THEN 'no_backend' END AS skipped, CASE k WHEN 3 THEN 'time out' WHEN 7 THEN 'Empty generation' END AS failed,
      CASE WHEN used THEN 'model' END AS used FROM m"""


@query
def prompts(spark, sf):
    docs = I.chunks(spark, sf)
    server = M.build_prompts(docs, "antiManipulation", ["doc_id"], "Judge.").withColumn("style", F.lit("server"))
    local = M.build_prompts(docs, "antiManipulation", ["doc_id"], "Judge.", "local").withColumn("style", F.lit("local"))
    return server.unionByName(local).select("doc_id", "style", "system", F.md5("prompt").alias("prompt_md5"))


_T = "coalesce(nullif(title, ''), 'N/A')"
SQL["prompts"] = f"""SELECT doc_id, 'server' AS style, 'Judge.' AS system, md5(concat('URL: N/A', chr(10), 'Domain: ', domain, chr(10), 'Title: ', {_T}, chr(10),
      chr(10), 'Content:', chr(10), text, chr(10), chr(10), 'Links found:', chr(10), link)) AS prompt_md5 FROM ({I.CHUNKS})
    UNION ALL SELECT doc_id, 'local', 'Judge.', md5(concat_ws(chr(10), concat('Domain: ', domain),
      CASE WHEN title <> '' THEN concat('Title: ', title) END, concat('Links: ', link), '', 'Content:', text)) FROM ({I.CHUNKS})"""


def _stub_model():
    """A stand-in model: calls long texts risky, and fails on none."""
    def answer(texts):
        return [f'{{"score": {0.9 if len(t) > 2000 else 0.1}, "confidence": 0.6}}' for t in texts]
    return answer


@query
def model_scorer(spark, sf):
    """A user's model run over the prompts, batch by batch, once loaded per worker."""
    made = M.build_prompts(I.chunks(spark, sf), "biasDetector", ["doc_id"], "Judge.")
    replies = M.model_replies(made, _stub_model, ["doc_id"])
    return M.parse_model_replies(replies, "biasDetector", ["doc_id"]).select("doc_id", "problem_score", "confidence", "explanation")


_PROMPT = f"concat('URL: N/A', chr(10), 'Domain: ', domain, chr(10), 'Title: ', {_T}, chr(10), 'Author: N/A', chr(10), chr(10), 'Content:', chr(10), text)"
SQL["model_scorer"] = f"""SELECT doc_id, CASE WHEN length({_PROMPT}) > 2000 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END AS problem_score,
    0.6::DOUBLE AS confidence, 'Analysis completed' AS explanation FROM ({I.CHUNKS})"""


@query
def model_text(spark, sf):
    return I.documents(spark, sf).select("doc_id", F.md5(M.model_text(F.col("text"))).alias("text_md5"))


SQL["model_text"] = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"


@query
def ai_text_signals(spark, sf):
    """Signals of machine-written text, not part of the default modules."""
    from pagegauge.operators.scorers import AI_GENERATED, score
    return score(I.chunks(spark, sf), AI_GENERATED, ["doc_id"]).select(
        "doc_id", F.round("problem_score", 6).alias("problem_score"), joined("flags").alias("flags"))


_S = f"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {u16(trim('s'))} > 10)"
_NP = lambda ws: "(" + " OR ".join(f"regexp_matches(l, '\\b{w}\\b')" for w in ws) + ")"
_TW = "(" + " + ".join(f"(CASE WHEN regexp_matches(l, '\\b{w}\\b') THEN 1 ELSE 0 END)" for w in V.TRANSITION_WORDS) + ")"
_GN = "(" + " + ".join(f"(CASE WHEN contains(l, {lit(w)}) THEN 1 ELSE 0 END)" for w in V.GENERIC_PHRASES) + ")"
_SP = "(" + " OR ".join(f"regexp_matches(text, {lit(p)})" for p in V.SPECIFIC_DETAIL_PATTERNS) + ")"
_TY = "(" + " OR ".join(f"contains(l, {lit(p)})" for p in V.COMMON_TYPOS) + ")"
_AI = [
    ("repetitive_structure", 0.2, "n > 3 AND 1 - starts / n::DOUBLE > 0.4"), ("generic_language", 0.15, f"n > 5 AND {_GN} > n * 0.3::DOUBLE"),
    ("lack_of_personal_voice", 0.1, f"{u16('text')} > 500 AND NOT {_NP(V.PERSONAL_PRONOUNS)}"),
    ("overly_perfect_grammar", 0.1, f"{_GN} > 3 AND {u16('text')} > 300 AND NOT {_TY}"),
    ("excessive_transitions", 0.15, f"n > 5 AND {_TW} > n * 0.2::DOUBLE"),
    ("lack_of_specific_details", 0.1, f"{u16('text')} > 500 AND NOT {_SP}"),
]
SQL["ai_text_signals"] = f"""WITH {BASE}, x AS (SELECT *, {_S} AS sents FROM base),
    y AS (SELECT *, len(sents) AS n, len(list_distinct(list_transform(sents, lambda s: lower(regexp_split_to_array({trim('s')}, '{T.SPACE_CLASS}')[1])))) AS starts FROM x)
    SELECT doc_id, round({' + '.join(f'(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)' for _, w, c in _AI)}, 6) AS problem_score,
    concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {lit(f)} END' for f, _, c in _AI)}) AS flags FROM y"""


@query
def topics(spark, sf):
    from pagegauge.operators.scorers import topic
    return I.documents(spark, sf).select("doc_id", joined(topic(F.col("text"))).alias("topic"))


SQL["topics"] = f"SELECT doc_id, CASE WHEN {u16('text')} >= 100 THEN 'news' ELSE '' END AS topic FROM documents"


@query
def conversation_toxicity(spark, sf):
    """Conversation turns as posts: toxicity per conversation, worst turn first."""
    from pagegauge.operators.scorers import score
    turns = I.table(spark, sf, "conversations").withColumn("doc_id", F.col("conv_id") * 31 + F.col("turn"))
    posts = turns.withColumn("text", F.concat("text", F.expr(I.ADDED_TEXT)))
    scores = score(posts, "defuseRagebait", ["conv_id", "turn"])
    return scores.groupBy("conv_id").agg(
        F.round(F.max("problem_score"), 6).alias("worst"),
        F.max_by("turn", F.struct("problem_score", -F.col("turn"))).alias("worst_turn"), F.count("*").alias("n"))


_TOX = " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for _, w, c in RULES["defuseRagebait"])
SQL["conversation_toxicity"] = f"""WITH t AS (SELECT conv_id, turn, lower(concat(text, {I.ADDED_TEXT})) AS l
      FROM (SELECT *, conv_id * 31 + turn AS doc_id FROM conversations)), s AS (SELECT conv_id, turn, least(0::DOUBLE + {_TOX}, 1::DOUBLE) AS v FROM t)
    SELECT conv_id, round(max(v), 6) AS worst, first(turn ORDER BY v DESC, turn) AS worst_turn, count(*) AS n FROM s GROUP BY conv_id"""
SQL["filter_pages"] = f"""SELECT page_id FROM pages WHERE contains(lower(url), 'er') OR contains(lower({TITLE}), 'er')"""

# --- topics, errors -----------------------------------------------------------------

#: topic, term, weight. Some terms belong to two topics, and some are in nearly every text.
TOPIC_LEXICON = [
    ("politics", "progressive", 2.0), ("politics", "liberal", 2.0), ("politics", "conservative", 2.0), ("politics", "Republican", 2.0),
    ("economy", "market", 2.5), ("economy", "inequality", 1.25), ("economy", "returns", 1.0), ("money", "money", 2.0), ("money", "rich", 2.0),
    ("money", "returns", 1.5), ("security", "password", 2.0), ("security", "account", 1.0), ("security", "verify", 1.0),
    ("health", "doctors", 2.0), ("health", "weird", 0.5), ("insults", "idiot", 1.5), ("insults", "stupid", 1.5), ("threats", "hurt", 2.0),
    ("threats", "regret", 2.0), ("science", "experts", 2.0), ("science", "hoax", 1.0), ("advertising", "sponsored", 2.0),
    ("advertising", "click", 1.5), ("advertising", "limited", 1.5), ("news", "news", 1.75), ("news", "happened", 1.5),
    ("english", "the", 0.05), ("english", "and", 0.05), ("french", "les", 0.05), ("french", "des", 0.05), ("french", "é", 0.01)]
LEAST_TOPIC = 0.5


@query
def topics_by_lexicon(spark, sf):
    """The weightiest topic of each whole text, if any weighs enough."""
    lexicon = spark.createDataFrame(TOPIC_LEXICON, "topic string, term string, weight double")
    return topics_of(I.chunks(spark, sf), lexicon, ["doc_id"], LEAST_TOPIC).select("doc_id", "topic", F.round("weight", 6).alias("weight"))


_TERMS = ", ".join(f"({lit(t)}, {lit(w.lower())}, {x}::DECIMAL(18, 6))" for t, w, x in TOPIC_LEXICON)
SQL["topics_by_lexicon"] = f"""WITH l(topic, term, weight) AS (VALUES {_TERMS}),
    w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM ({I.CHUNKS})),
    s AS (SELECT doc_id, topic, sum(weight) AS weight FROM w JOIN l USING (term) GROUP BY ALL HAVING sum(weight) >= {LEAST_TOPIC}),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) = 1)
    SELECT DISTINCT d.doc_id, topic, round(weight::DOUBLE, 6) AS weight FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id"""

# A length as its source declares it: missing for one document in seven, wrong for another.
DECLARED = """CASE doc_id % 7 WHEN 3 THEN 'n/a' WHEN 5 THEN cast(n_chars + 40 AS string) ELSE cast(n_chars AS string) END"""


def _length_rules(view):
    declared = F.col("declared").try_cast("long")
    return [("wrong_length", 0.4, declared != F.length(view.text)), ("long_text", 0.3, declared > 600)]


LENGTH_SCORER = S.Scorer("declaredLength", "accuracy", _length_rules, lambda score, flags: F.lit(0.9),
                         lambda score, flags, hits: F.array_join(flags, " and "), strict=True)


def _declared(spark, sf):
    return I.documents(spark, sf).select("doc_id", "source", "text", F.expr(DECLARED).alias("declared"))


@query
def scorer_errors(spark, sf):
    """A scorer that fails on one document in seven gives error rows there, the other module's rows are whole."""
    scores = S.score_all(_declared(spark, sf), [LENGTH_SCORER, "biasDetector"], ["doc_id"])
    return S.complete_scores(scores, ["doc_id"]).select(
        "doc_id", "module", F.round("problem_score", 6).alias("problem_score"), "confidence", F.array_join("flags", ", ").alias("flags"), "error")


_DECLARED = f"""d AS (SELECT doc_id, source, length(coalesce(text, '')) AS n, lower(coalesce(text, '')) AS l, coalesce(text, '') AS text,
    TRY_CAST({DECLARED.replace('AS string', 'AS VARCHAR')} AS BIGINT) AS declared FROM documents),
    s AS (SELECT doc_id, source, CASE WHEN declared IS NOT NULL THEN if(declared <> n, 0.4::DOUBLE, 0) + if(declared > 600, 0.3::DOUBLE, 0) END AS score,
      concat_ws(', ', if(declared <> n, 'wrong_length', NULL), if(declared > 600, 'long_text', NULL)) AS flags FROM d)"""
SQL["scorer_errors"] = f"""WITH {_DECLARED},
    b AS (SELECT doc_id, {' + '.join(f'(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)' for _, w, c in RULES['biasDetector'])} AS score,
      concat_ws(', ', {', '.join(f'CASE WHEN {c} THEN {lit(f)} END' for f, _, c in RULES['biasDetector'])}) AS flags FROM d)
    SELECT doc_id, 'declaredLength' AS module, round(coalesce(score, 0), 6) AS problem_score, if(score IS NULL, 0, 0.9::DOUBLE) AS confidence,
      coalesce(flags, '') AS flags, if(score IS NULL, 'wrong_length: no result', NULL) AS error FROM s
    UNION ALL SELECT doc_id, 'biasDetector', round(least(score, 1), 6), {V.BIAS_CONFIDENCE}::DOUBLE, flags, NULL FROM b"""


@query
def scorer_error_means(spark, sf):
    """Means per source leave error rows out, in the long table and in the array of a chunk alike."""
    rows = _declared(spark, sf)
    long = R.summarize_page_modules(S.score_all(rows, [LENGTH_SCORER], ["doc_id", "source"]), ["source"], ["doc_id"])
    chunk = R.summarize_chunk_arrays(S.with_scores(rows, [LENGTH_SCORER, "biasDetector"]), ["doc_id", "source"])
    sure = chunk.groupBy("source").agg(F.count_if(F.col("confidence") == F.lit(V.BIAS_CONFIDENCE)).alias("n_failed"), F.count("*").alias("n_all"))
    return long.select("source", F.round(F.col("problem_score") + 1e-10, 6).alias("problem_score"), "n_chunks").join(sure, "source", "full")


SQL["scorer_error_means"] = f"""WITH {_DECLARED} SELECT source, round(avg(score) + 1e-10, 6) AS problem_score, nullif(count(score), 0) AS n_chunks,
    count(*) FILTER (score IS NULL) AS n_failed, count(*) AS n_all FROM s GROUP BY source"""
