"""Queries over text functions, path classifiers and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import index as I
from ..operators import embedding, rules, tallies
from ..operators.held import held
from . import frames
from . import oracle as O
from .registry import query, table
from .reports import item_url


@query(f"WITH {O.ITEMS.split('), order_files')[0]}) SELECT number, len({O.tokens('title')}) AS n_title, len({O.tokens('body')}) AS n_body, array_to_string({O.tokens('title')}, ' ') AS title_terms, md5(array_to_string({O.tokens('body')}, ' ')) AS body_terms FROM raw_items")
def tokenize_terms(spark, sf_dir):
    t = frames.text_items(spark, sf_dir).select("number", T.tokenize(F.col("title")).alias("t"), T.tokenize(F.col("body")).alias("b"))
    return t.select("number", F.size("t").cast("long").alias("n_title"), F.size("b").cast("long").alias("n_body"), F.array_join("t", " ").alias("title_terms"), F.md5(F.array_join("b", " ")).alias("body_terms"))


_MARKED = "'```Python' || chr(10) || html || ' [link ' || page_id || '](' || url || ') ' || url || ' end'"


@query(f"SELECT page_id, length(s) AS n, md5(s) AS stripped FROM (SELECT page_id, {O.strip(_MARKED)} AS s FROM pages)")
def strip_markup(spark, sf_dir):
    text = F.concat(F.lit("```Python\n"), "html", F.lit(" [link "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") "), "url", F.lit(" end"))
    s = table(spark, sf_dir, "pages").select("page_id", T.strip_markup(text).alias("s"))
    return s.select("page_id", F.length("s").cast("long").alias("n"), F.md5("s").alias("stripped"))


@query(
    "WITH p AS (SELECT p_partkey, lower(p_type) || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || 'HTTPServer.v' || p_size AS name FROM part) "
    f"SELECT p_partkey, name, array_to_string({O.expand('name')}, ' ') AS parts FROM p"
)
def expand_identifiers(spark, sf_dir):
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.array_join(words, ""), F.lit("HTTPServer.v"), F.col("p_size").cast("string")).alias("name"))
    return p.select("p_partkey", "name", F.array_join(T.expand_identifier(F.col("name")), " ").alias("parts"))


@query(f"WITH {O.ITEMS.split('), order_files')[0]}) SELECT number, {O.norm_title(O.q('fix(') + ' || author || ' + O.q('):  ') + ' || title || chr(160)')} AS norm_title FROM raw_items")
def norm_title(spark, sf_dir):
    raw = F.concat(F.lit("fix("), "author", F.lit("):  "), "title", F.lit(" "))
    return frames.text_items(spark, sf_dir).select("number", T.norm_title(raw).alias("norm_title"))


_EMBED = f"title || chr(10) || title || chr(10) || substr(regexp_replace(regexp_replace({O.strip('body')}, {O.q('[' + T.SPACE + ']+')}, ' ', 'g'), '^ | $', '', 'g'), 1, 2000)"


@query(f"WITH {O.ITEMS.split('), order_files')[0]}) SELECT number, md5({_EMBED}) AS embed_text FROM raw_items")
def embed_text(spark, sf_dir):
    return frames.text_items(spark, sf_dir).select("number", F.md5(T.embed_text(F.col("title"), F.col("body"))).alias("embed_text"))


_VOWELS = ", ".join(f"(length(t) - length(replace(t, '{v}', '')))::DOUBLE AS {v}" for v in "aeiou")
_UNIT = ", ".join(f"round({v} / sqrt(1.0::DOUBLE + a * a + e * e + i * i + o * o + u * u), 9) AS {v}" for v in "aeiou")


@query(f"WITH {O.ITEMS.split('), order_files')[0]}), t AS (SELECT number, {_EMBED} AS t FROM raw_items), c AS (SELECT number, {_VOWELS} FROM t) SELECT number, {_UNIT} FROM c")
def embed_items(spark, sf_dir):
    """Vectors of all items from an injected encoder (here one that counts vowels)."""
    v = embedding.embed(frames.text_items(spark, sf_dir), embedding.letter_encoder)
    return v.select("number", *[F.round(F.col("vector")[i + 1], 9).alias(c) for i, c in enumerate("aeiou")])


_INDEX = f"WITH {O.ITEMS.split('), order_files')[0]}), {O.index()}"


@query(f"{_INDEX} SELECT p.number, l.len, p.term, p.tf FROM post p JOIN lens l USING (number)")
def term_frequency(spark, sf_dir):
    return I.postings(frames.text_index(spark, sf_dir).entries)


@query(f"{_INDEX} SELECT term, df FROM df")
def doc_frequency(spark, sf_dir):
    return I.document_frequency(frames.text_index(spark, sf_dir).entries)


@query(f"{_INDEX} SELECT n, total_len, round(avg_len, 9) AS avg_len FROM stats")
def corpus_stats(spark, sf_dir):
    return I.statistics(frames.text_index(spark, sf_dir).entries).withColumn("avg_len", F.round("avg_len", 9))


_DELTA = """
changed AS (
  SELECT doc_id AS number, array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT item_id + (SELECT max(doc_id) FROM documents) + 1, text FROM benchmark
), both_ AS (
  SELECT * FROM changed UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT number FROM changed)
), folded AS (
  SELECT number, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM both_
)"""


def _fold(spark, sf_dir):
    base, delta = frames.text_index(spark, sf_dir), held(I.latest(frames.delta(spark, sf_dir)), "delta")
    return base, delta, held(I.entries(delta), "new")  # joined several times


@query(f"WITH {_DELTA}, {O.index('folded')} SELECT term, df FROM df")
def fold_df(spark, sf_dir):
    base, _, new = _fold(spark, sf_dir)
    return I.fold_frequency(I.document_frequency(base.entries), base.entries, new)


@query(f"WITH {_DELTA}, {O.index('folded')} SELECT n, total_len, round(avg_len, 9) AS avg_len FROM stats")
def fold_stats(spark, sf_dir):
    base, _, new = _fold(spark, sf_dir)
    return I.fold_statistics(I.statistics(base.entries), base.entries, new).withColumn("avg_len", F.round("avg_len", 9))


_UPSERT = f"""WITH {O.ITEMS}, {_DELTA}
SELECT coalesce(d.number, i.number) AS number, coalesce(d.title, i.title) AS title, md5(coalesce(d.body, i.body)) AS body,
       CASE WHEN d.number IS NOT NULL THEN 'OPEN' ELSE i.state END AS state, CAST(len(i.files) AS BIGINT) AS n_files
FROM items i FULL JOIN (SELECT f.* FROM folded f SEMI JOIN changed c USING (number)) d USING (number)"""


@query(_UPSERT)
def fold_upsert(spark, sf_dir):
    out = I.upsert(frames.full_items(spark, sf_dir), I.latest(frames.delta(spark, sf_dir)))
    return out.select("number", "title", F.md5("body").alias("body"), "state", F.when(F.col("files").isNotNull(), F.size("files")).cast("long").alias("n_files"))


@query("SELECT CAST(0 AS BIGINT) AS different_terms, CAST(0 AS BIGINT) AS n_difference, true AS same_length")
def fold_equals_rebuild(spark, sf_dir):
    base, delta, new = _fold(spark, sf_dir)
    folded = I.fold_frequency(I.document_frequency(base.entries), base.entries, new)
    rebuilt = held(I.entries(I.upsert(frames.full_items(spark, sf_dir), delta)), "rebuilt")
    terms = I.frequency_difference(folded, I.document_frequency(rebuilt)).agg(F.count("*").alias("different_terms"))
    a, b = I.fold_statistics(I.statistics(base.entries), base.entries, new), I.statistics(rebuilt).toDF("n2", "total2", "avg2")
    return terms.crossJoin(a.crossJoin(b).select((F.col("n") - F.col("n2")).alias("n_difference"), (F.abs(F.col("avg_len") - F.col("avg2")) < 1e-6).alias("same_length")))


@query(f"WITH {_DELTA} SELECT count(*) FILTER (number NOT IN (SELECT doc_id FROM documents)) AS added, count(*) FILTER (number IN (SELECT doc_id FROM documents)) AS updated FROM changed")
def change_counts(spark, sf_dir):
    return I.change_counts(frames.text_items(spark, sf_dir), frames.delta(spark, sf_dir))


_PATHS = """paths AS (
  SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'pkg/x/go.sum' WHEN 2 THEN 'Makefile' WHEN 3 THEN '.github/workflows/ci.yml'
    WHEN 4 THEN 'test/testdata/golden/a.go' WHEN 5 THEN 'tool/internal/' || lower(p_type) || '/x.go' WHEN 6 THEN 'tool/' || lower(p_type) || '/a.go'
    WHEN 7 THEN 'instrumentation/' || split_part(p_name, ' ', 1) || '.com/' || split_part(p_name, ' ', 2) || '/v2/hook.go'
    WHEN 8 THEN 'instrumentation/' || split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1) || '/h.go'
    WHEN 9 THEN 'docs/' || p_name WHEN 10 THEN 'tool/data/' || lower(p_type) || '-bundle.tgz' ELSE 'LICENSE' END AS path FROM part
)"""


def _paths(spark, sf_dir):
    word = lambda i: F.split("p_name", " ")[i]
    low = F.lower("p_type")
    forms = ["go.mod", "pkg/x/go.sum", "Makefile", ".github/workflows/ci.yml", "test/testdata/golden/a.go"]
    forms = [F.lit(x) for x in forms] + [
        F.concat(F.lit("tool/internal/"), low, F.lit("/x.go")),
        F.concat(F.lit("tool/"), low, F.lit("/a.go")),
        F.concat(F.lit("instrumentation/"), word(0), F.lit(".com/"), word(1), F.lit("/v2/hook.go")),
        F.concat(F.lit("instrumentation/"), word(1), F.lit("/"), word(0), F.lit("/h.go")),
        F.concat(F.lit("docs/"), "p_name"),
        F.concat(F.lit("tool/data/"), low, F.lit("-bundle.tgz")),
    ]
    path = F.lit("LICENSE")
    for i, f in reversed(list(enumerate(forms))):
        path = F.when(F.col("p_size") % 12 == i, f).otherwise(path)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


_NOISE = "(regexp_full_match(path, 'tool/data/[^/]+-bundle[.]tgz') OR path = 'Makefile' OR path LIKE '%go.mod' OR path LIKE '%go.sum' OR path LIKE '.github/workflows%' OR path LIKE '%/testdata/golden/%')"
_COMPONENT = """CASE WHEN path LIKE 'instrumentation/%' THEN 'instrumentation' WHEN regexp_matches(path, '^tool/(internal/)?[^/]+') THEN 'tool/' || regexp_extract(path, '^tool/(?:internal/)?([^/]+)', 1)
  WHEN path LIKE 'pkg/%' THEN 'pkg/runtime' WHEN path LIKE 'docs/%' THEN 'docs' WHEN path LIKE 'test/%' THEN 'test/e2e' WHEN path LIKE '.github/%' THEN 'ci'
  WHEN path LIKE 'scripts/%' OR path LIKE '.tools/%' THEN 'build' WHEN path LIKE 'demo/%' THEN 'demo' WHEN path LIKE 'schemas/%' THEN 'semconv' END"""
_INTEGRATION = "nullif(regexp_extract(path, '^instrumentation/(?:[^/]*[.][^/]*/)?([^/]+)', 1), '')"


@query(f"WITH {_PATHS} SELECT p_partkey, path, {_NOISE} AS noise, {_COMPONENT} AS component, {_INTEGRATION} AS integration FROM paths")
def noise_filter(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", "path", P.is_noise(p).alias("noise"), P.component(p).alias("component"), P.integration(p).alias("integration"))


_QUEUE = f"{_PATHS}, queue AS (SELECT DISTINCT l_orderkey AS number, path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN paths ON p_partkey = l_partkey WHERE o_orderstatus = 'O')"


def _queue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    files = li.join(_paths(spark, sf_dir), "p_partkey").groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_set("path").alias("files"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.lit("PR").alias("kind"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("state"))
    return o.join(files, "number", "left")


@query(f"WITH {_QUEUE} SELECT name, count(*) AS matches FROM (SELECT DISTINCT number, {_COMPONENT} AS name FROM queue WHERE NOT {_NOISE}) WHERE name IS NOT NULL GROUP BY name")
def component_tally(spark, sf_dir):
    return tallies.components(_queue(spark, sf_dir))


@query(f"WITH {_QUEUE} SELECT count(*) AS names, CAST(sum(matches) AS BIGINT) AS matches, max(matches) AS most FROM (SELECT name, count(*) AS matches FROM (SELECT DISTINCT number, {_INTEGRATION} AS name FROM queue WHERE NOT {_NOISE}) WHERE name IS NOT NULL GROUP BY name)")
def integration_tally(spark, sf_dir):
    return tallies.summary(tallies.integrations(_queue(spark, sf_dir)))


@query(f"WITH {_QUEUE} SELECT count(*) FILTER (b) AS bundle, count(*) AS total FROM (SELECT number, bool_or(regexp_full_match(path, 'tool/data/[^/]+-bundle[.]tgz')) AS b FROM queue GROUP BY number)")
def bundle_count(spark, sf_dir):
    return tallies.bundle_count(_queue(spark, sf_dir))


_TARGETS = r"""SELECT DISTINCT target FROM (
  SELECT regexp_replace(lower(unnest(string_split(regexp_extract(path, '^instrumentation/(.+?)/(?:v\d+/)?[^/]+$', 1), '/'))), '\.(com|org|io|net)$', '') AS target FROM paths
  UNION ALL SELECT unnest(['grpc', 'http', 'sql', 'https'])
) WHERE length(target) > 2 AND NOT regexp_full_match(target, 'v\d+') AND target NOT LIKE '%.%'"""


@query(f"WITH {_PATHS} {_TARGETS}")
def target_vocab(spark, sf_dir):
    return rules.target_vocabulary(_paths(spark, sf_dir).select(F.array("path").alias("files")))


@query(f"WITH {O.ITEMS} SELECT count(*) AS items, count(*) FILTER (kind = 'ISSUE') AS issues, count(*) FILTER (kind = 'PR') AS prs, count(*) FILTER (state = 'OPEN') AS open, count(*) FILTER (merged) AS merged FROM items")
def corpus_counts(spark, sf_dir):
    return tallies.corpus_counts(frames.full_items(spark, sf_dir))


@query(
    "SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 2880 THEN CAST(floor(m / 60.0 + 0.5) AS BIGINT) || 'h ago' ELSE CAST(floor(m / 1440.0 + 0.5) AS BIGINT) || 'd ago' END AS ago, "
    "strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d%H') AS hour, strftime(ts, '%Y%m') AS month, regexp_replace(substr(props || '|' || event_type, 1, 64), '[^a-zA-Z0-9_.:-]', '_', 'g') AS caller, "
    "replace(replace(replace(replace(props || '<b>&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped "
    "FROM (SELECT *, CAST(floor((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 60000.0 + 0.5) AS BIGINT) AS m FROM events)"
)
def display_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = T.stamps(F.col("ts"))
    return e.select(
        "event_id",
        T.ago(F.col("ts"), F.lit("2024-01-31").cast("timestamp")).alias("ago"),
        *[s[k].alias(k) for k in ("day", "hour", "month")],
        T.caller_id(F.concat_ws("|", "props", "event_type")).alias("caller"),
        T.html_escape(F.concat("props", F.lit("<b>&"))).alias("escaped"),
    )


@query(
    f"WITH {O.ITEMS} SELECT number, CASE WHEN state = 'OPEN' THEN 'open' WHEN coalesce(merged, false) THEN 'merged' ELSE 'closed' END AS label, 'https://example.org/project/issues/' || number AS url FROM items"
)
def item_labels(spark, sf_dir):
    """How an item's state is shown, and where it lies."""
    return frames.full_items(spark, sf_dir).select("number", T.state_label(F.col("state"), F.col("merged")).alias("label"), item_url("https://example.org/project/", F.col("number")).alias("url"))


_PASTED = "(SELECT p_partkey AS id, '  a/' || p_type || '/' || p_brand || chr(10) || chr(10) || 'b/' || p_name || ' ' || chr(10) || p_type AS lines FROM part)"


@query(f"SELECT id, list_aggregate(list_filter(list_transform(string_split(lines, chr(10)), lambda x: regexp_replace(trim(x), '^[ab]/', '')), lambda x: x <> ''), 'string_agg', '|') AS paths FROM {_PASTED}")
def pasted_paths(spark, sf_dir):
    """A pasted list of changed files, cleaned."""
    p = table(spark, sf_dir, "part")
    lines = F.concat(F.lit("  a/"), "p_type", F.lit("/"), "p_brand", F.lit("\n\nb/"), "p_name", F.lit(" \n"), "p_type")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(T.clean_paths(lines), "|").alias("paths"))


@query(
    "WITH f AS (SELECT l_orderkey AS doc_id, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1) "
    "SELECT doc_id, md5(substr(text, 1, 200)) AS title, md5(substr(text, 1, 4000)) AS body, len(list_slice(list_concat(list_concat(parts, range(100, 150)), range(200, 220)), 1, 60)) AS n_files FROM documents JOIN f USING (doc_id)"
)
def capped_request(spark, sf_dir):
    """What a request may carry of a long title, a long body and many paths."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_partkey").alias("parts"))
    d = table(spark, sf_dir, "documents").join(parts, "doc_id")
    files = F.concat("parts", F.sequence(F.lit(100), F.lit(149)).cast("array<long>"), F.sequence(F.lit(200), F.lit(219)).cast("array<long>"))
    c = T.capped_input(F.col("text"), F.col("text"), files)
    return d.select("doc_id", F.md5(c["title"]).alias("title"), F.md5(c["body"]).alias("body"), F.size(c["files"]).cast("long").alias("n_files"))
