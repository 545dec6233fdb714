"""Queries over the test tables, each with its equal in SQL where there is one.

The SQL is written independently of the operators wherever it can be said plainly.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelight.common import table
from quirelight.functions import html, nested, text
from quirelight.operators import bio, convert, embed, layout, match, prose, sequences, topics, tuning, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return s.replace("'", "''")


def _token_sql(column: str) -> str:
    out = f"translate({column}, ' ', '{text.MARK}')"
    for d in text.DELIMITERS:
        e = _q(re.escape(d))
        out = f"regexp_replace({out}, '(^|{text.MARK}){e}+', '\\1', 'g')"
        out = f"regexp_replace({out}, '{e}+', '{text.MARK}{_q(d)}{text.MARK}', 'g')"
    return f"list_filter(list_transform(string_split({out}, '{text.MARK}'), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t <> '')"


_TOKENS = _token_sql("text")


# Words


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 100")
def token_freq_topk(spark, d):
    rows = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return sequences.first_rows(rows.groupBy("token").agg(F.count("*").alias("n")), [F.desc("n"), "token"], 100)


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS word_index, t[i] AS word FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))")
def index_words(spark, d):
    return words.index_document(table(spark, d, "documents"))


_WORDS = "SELECT doc_id, box_index, i, t[i] AS word FROM (SELECT doc_id, box_index, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, box_index, " + _token_sql("text") + " AS t FROM b))"
#: One row for each box, as ``layout.distinct_boxes`` has it, from the columns that the queries need.
_BOXES = """b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, box_index ORDER BY (text IS NOT NULL)::INT + (x IS NOT NULL)::INT DESC, page_number DESC, text DESC NULLS LAST,
 x DESC NULLS LAST, y DESC NULLS LAST) AS rn FROM boxes) WHERE rn = 1)"""


@query(f"WITH {_BOXES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY box_index, i) - 1 AS BIGINT) AS word_index, word FROM ({_WORDS})")
def box_words(spark, d):
    found = words.index_words(layout.distinct_boxes(table(spark, d, "boxes")), order="box_index")
    return found.select("doc_id", "word_index", "word")


@query(f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS plain, CAST(len({_TOKENS}) AS INT) AS n FROM documents WHERE text IS NOT NULL AND len({_TOKENS}) > 0")
def document_json(spark, d):
    found = words.index_document(table(spark, d, "documents")).withColumn("box", F.lit(0))
    kind = "text string, indexed_words map<string,string>, cuts array<string>"
    return words.document_json(found).select("doc_id", F.from_json("json", kind).alias("j")).select("doc_id", F.col("j.text").alias("plain"), F.size("j.indexed_words").alias("n"))


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS word_index, '<z id=\"z' || (i - 1) || '\">' || t[i] || '</z>' AS tag FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))")
def word_tags(spark, d):
    return words.marked_up(words.index_document(table(spark, d, "documents"))).select("doc_id", "word_index", "tag")


# Cleaners and names


def _cleaner(f: Callable, sql: str) -> Query:
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", f(F.col("text")).alias("clean"))

    run.__name__ = f.__name__
    return query(f"SELECT doc_id, {sql} AS clean FROM documents")(run)


_cleaner(text.alnum_only, "regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')")
_cleaner(text.punctuation_token, "regexp_replace(text, '[,.;:?!]', 'PCT', 'g')")
_cleaner(text.inner_strip, "replace(replace(text, '  ', ' '), chr(10), '')")
_cleaner(text.topic_clean, "regexp_replace(text, '[^ 0-9A-Za-z]', '', 'g')")
_cleaner(text.collapse_lines, "replace(text, chr(10) || chr(10), chr(10))")
_cleaner(text.web_whitelist, "regexp_replace(text, '[^0-9A-Za-z !?$%&()+,\\-\\\\./:;\\[\\]_`‘’“”\n]', '', 'g')")
_cleaner(text.join_wrapped, "replace(replace(regexp_replace(text, '- *\n', '', 'g'), chr(10), ' '), ';', ' ')")


@query("SELECT doc_id, string_split(url, '/')[-1] AS base, regexp_replace(replace(url, '''', ''), '[\\n\\t:$ \\\\!@#%^&*()\\-+=\"'';<>?/~`.,]', '_', 'g') AS safe, left(url, 8) || '|' || substr(url, 9) AS marked FROM documents WHERE url IS NOT NULL")
def url_names(spark, d):
    u = F.col("url")
    return table(spark, d, "documents").where("url is not null").select("doc_id", text.basename(u).alias("base"), text.safe_name(u).alias("safe"), text.insert_at(u, 8, "|").alias("marked"))


@query("SELECT doc_id, CASE WHEN instr(text, 'Latest Posts') > 0 THEN left(text, instr(text, 'Latest Posts') - 1) ELSE text END AS post FROM documents WHERE media = 'web'")
def post_cut(spark, d):
    return table(spark, d, "documents").where("media = 'web'").select("doc_id", text.cut_after(F.col("text"), "Latest Posts").alias("post"))


_SAFE = "regexp_replace(replace(source, '''', ''), '[\\n\\t:$ \\\\!@#%^&*()\\-+=\"'';<>?/~`.,]', '_', 'g')"
_PATHS = {"html_before_indexing": ("before", "html"), "html_after_indexing": ("after", "html"), "apache_path": ("served", "html"), "json_path": ("json", "json"), "txt_path": ("txt", "txt")}


@query("SELECT doc_id, " + ", ".join(f"'out/{folder}/' || {_SAFE} || '.{end}' AS {name}" for name, (folder, end) in _PATHS.items()) + " FROM documents WHERE source IS NOT NULL")
def output_paths(spark, d):
    rows = table(spark, d, "documents").where("source is not null")
    return rows.select("doc_id", text.output_paths(F.col("source"), "out").alias("p")).select("doc_id", "p.*")


# Prose

_SHARES = ", ".join(f"({ord(c)}, {n})" for c, n in prose.SAMPLE.items())
_PROSE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, ps, list_sum(list_transform(ps, lambda p: length(p))) / len(ps) AS mean FROM d),
p AS (SELECT doc_id, unnest(range(0, len(ps))) AS paragraph_no, unnest(CASE WHEN mean > 80 THEN list_transform(ps, lambda p: replace(replace(regexp_replace(p, '- *\n', '', 'g'), chr(10), ' '), ';', ' ')) ELSE ps END) AS paragraph FROM m),
c AS (SELECT doc_id, paragraph_no, unnest(list_transform(range(1, length(paragraph) + 1), lambda i: unicode(paragraph[i]))) AS code FROM p),
n AS (SELECT doc_id, paragraph_no, code, count(*) AS k FROM c GROUP BY ALL),
s(code, k) AS (VALUES {_SHARES}),
keys AS (SELECT DISTINCT doc_id, paragraph_no FROM n),
u AS (SELECT doc_id, paragraph_no, code, k, 0 AS r FROM n UNION ALL SELECT doc_id, paragraph_no, code, 0, k FROM keys, s),
g AS (SELECT doc_id, paragraph_no, code, sum(k) AS k, sum(r) AS r FROM u GROUP BY ALL),
f AS (SELECT doc_id, paragraph_no, sum(k) OVER w AS k, sum(r) OVER w AS r, sum(k) OVER (PARTITION BY doc_id, paragraph_no) AS n FROM g WINDOW w AS (PARTITION BY doc_id, paragraph_no ORDER BY code ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT doc_id, paragraph_no, max(abs(k / n - r / 1018)) AS dist, CAST(any_value(n) AS BIGINT) AS n FROM f GROUP BY ALL),
z AS (SELECT *, dist * sqrt(n * 1018 / (n + 1018)) / sqrt(-0.5 * ln(0.0005)) AS z, CAST(round(dist * n * 1018) AS BIGINT) AS h, least(n, 1018) AS a, greatest(n, 1018) AS b FROM ks),
-- the share of paths within the distance, from one i + j to the next, where the asymptotic chance doesn't decide
near AS (SELECT doc_id, paragraph_no, list_reduce(list_prepend(list_prepend(1.0::DOUBLE, list_transform(range(0, a), lambda x: 0.0::DOUBLE)), list_transform(range(1, a + b + 1), lambda s: [s::DOUBLE])),
 lambda f, s: list_transform(range(0, a + 1), lambda i: CASE WHEN i <= s[1] AND s[1] - i <= b AND abs(b * i - a * (s[1] - i)) < h THEN (CASE WHEN i > 0 THEN f[i] * i ELSE 0 END + f[i + 1] * (s[1] - i)) / s[1] ELSE 0.0 END))[a + 1] AS inside
 FROM z WHERE n <= 10000 AND z < 1 AND z > CASE WHEN n < 20 THEN 0.6 WHEN n < 50 THEN 0.95 WHEN n < 300 THEN 0.97 ELSE 0.98 END),
pr AS (SELECT p.doc_id, CAST(p.paragraph_no AS INT) AS paragraph_no, paragraph, CAST(length(paragraph) AS INT) AS n_chars, coalesce(z < 1 AND coalesce(1 - inside > 0.001, true), false) AS keep
FROM p LEFT JOIN z ON p.doc_id = z.doc_id AND p.paragraph_no = z.paragraph_no LEFT JOIN near ON p.doc_id = near.doc_id AND p.paragraph_no = near.paragraph_no)"""


@query(f"{_PROSE_SQL} SELECT doc_id, paragraph_no, n_chars, keep FROM pr")
def prose_filter(spark, d):
    return prose.prose_paragraphs(table(spark, d, "documents")).select("doc_id", "paragraph_no", "n_chars", "keep")


@query(f"{_PROSE_SQL} SELECT doc_id, left(regexp_replace(coalesce(string_agg(paragraph, ' ' ORDER BY paragraph_no) FILTER (keep), ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), 20000) AS prose FROM pr GROUP BY doc_id")
def prose_text(spark, d):
    return prose.prose_text(table(spark, d, "documents"))


# Annotation

_LATEST = "t AS (SELECT sample_id, i, tok, tag FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY arrived_at DESC NULLS LAST, tok DESC NULLS LAST, tag DESC NULLS LAST) AS rn FROM tagged_tokens) WHERE rn = 1)"
_BIO = """v AS (SELECT *, last_value(CASE WHEN tag IN ('U-CONTRAST', 'B-CONTRAST', 'U-SUBJECT', 'B-SUBJECT') THEN true WHEN tag IN ('O', 'L-CONTRAST') THEN false END IGNORE NULLS)
 OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM t),
bio AS (SELECT sample_id, i, tok, tag, CASE WHEN tag IN ('U-CONTRAST', 'B-CONTRAST', 'U-SUBJECT', 'B-SUBJECT') THEN CASE WHEN opened THEN 'I' ELSE 'B' END || tag[2:] WHEN tag IN ('L-CONTRAST', 'L-SUBJECT') THEN 'I' || tag[2:] ELSE tag END AS bio FROM v)"""
_PARTS = "parts AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN bio[1] = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INT) AS part_no FROM bio) WHERE part_no > 0)"
_SPANS = """spans AS (SELECT sample_id, part_no, bio[3:] AS kind, CAST(min(i) AS INT) AS span_start, CAST(max(i) + 1 AS INT) AS span_end, count(*) AS n_tokens, string_agg(tok, ' ' ORDER BY i) AS text
 FROM parts WHERE bio <> 'O' AND bio[3:] NOT IN ('O', '') GROUP BY ALL)"""


def _latest(spark, d):
    return bio.latest_tokens(table(spark, d, "tagged_tokens"))


def _bio(spark, d):
    return bio.bioul_to_bio(_latest(spark, d))


@query(f"WITH {_LATEST} SELECT * FROM t")
def latest_tokens(spark, d):
    return _latest(spark, d)


@query(f"WITH {_LATEST}, {_BIO} SELECT sample_id, i, bio FROM bio")
def bioul_to_bio(spark, d):
    return _bio(spark, d).select("sample_id", "i", "bio")


@query(f"WITH {_LATEST}, {_BIO}, {_PARTS} SELECT sample_id, i, part_no FROM parts")
def bio_parts(spark, d):
    return bio.parts(_bio(spark, d), "bio").select("sample_id", "i", "part_no")


@query(f"WITH {_LATEST}, {_BIO}, {_PARTS}, {_SPANS} SELECT sample_id, part_no, kind, span_start, span_end, n_tokens, coalesce(text, '') AS text FROM spans")
def bio_spans(spark, d):
    return bio.spans(_bio(spark, d), "bio")


@query(f"WITH {_LATEST}, {_BIO}, {_PARTS}, {_SPANS} SELECT sample_id, CAST(count(DISTINCT part_no) AS INT) AS n_parts, count(*) AS n_spans FROM spans GROUP BY sample_id")
def structured_spans(spark, d):
    rows = bio.structured_spans(bio.spans(_bio(spark, d), "bio"))
    return rows.select("sample_id", F.size("parts").alias("n_parts"), F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p)).cast("bigint").alias("n_spans"))


@query(f"WITH {_LATEST}, {_BIO}, {_PARTS}, {_SPANS} SELECT sample_id, kind, CAST(sum(span_end - span_start) AS BIGINT) AS width FROM spans GROUP BY sample_id, kind")
def spans_by_kind(spark, d):
    return bio.by_kind(bio.spans(_bio(spark, d), "bio"), F.sum(F.col("span_end") - F.col("span_start")).alias("width"))


@query(f"WITH {_LATEST}, {_BIO}, {_PARTS}, {_SPANS} SELECT sample_id, part_no, count(*) AS kinds FROM spans GROUP BY sample_id, part_no")
def spans_by_part(spark, d):
    return bio.by_part(bio.spans(_bio(spark, d), "bio"), F.count("*").alias("kinds"))


_TRIM = "e AS (SELECT sample_id, min(i) AS lo, max(i) AS hi FROM t WHERE coalesce(tag, '') <> 'O' GROUP BY sample_id), trimmed AS (SELECT t.* FROM t LEFT JOIN e ON t.sample_id = e.sample_id WHERE lo IS NULL OR t.i BETWEEN lo AND hi)"


@query(f"WITH {_LATEST}, {_TRIM} SELECT sample_id, i, tok, tag FROM trimmed")
def trim_outer_o(spark, d):
    return bio.trim_outside(_latest(spark, d)).select("sample_id", "i", "tok", "tag")


@query(f"WITH {_LATEST}, {_TRIM} SELECT min(sample_id) AS sample_id, actual_text FROM (SELECT sample_id, coalesce(string_agg(tok, ' ' ORDER BY i), '') AS actual_text FROM trimmed GROUP BY sample_id) GROUP BY actual_text")
def distinct_annotations(spark, d):
    return bio.distinct_annotations(_latest(spark, d))


@query(f"WITH {_LATEST}, {_BIO} SELECT sample_id, count(*) FILTER (bio[1] = 'B') AS n_b, count(*) FILTER (bio[1] = 'B') = 2 AS ok FROM bio GROUP BY sample_id")
def exactly_two_b(spark, d):
    return bio.exactly_two_begins(_bio(spark, d), "bio")


@query(f"""WITH {_LATEST}, {_BIO}, q AS (SELECT *, CASE WHEN length(tok) > 6 THEN 'NN' WHEN length(tok) = 1 THEN NULL ELSE 'VB' END AS pos, count(*) FILTER (bio[1] = 'B') OVER (PARTITION BY sample_id) AS n_b FROM bio),
l AS (SELECT sample_id, i, concat_ws('  ', tok, coalesce(pos, 'UKN'), CASE WHEN bio[1] = 'O' THEN 'O' ELSE bio[1] || '-' || coalesce(pos, 'UKN') END, bio) AS line FROM q WHERE n_b = 2 AND bio[1] IN ('B', 'I', 'O'))
SELECT sample_id, i, line FROM l WHERE regexp_matches(line, '^\\S+  \\S+  \\S+  \\S+')""")
def conll_lines(spark, d):
    pos = F.when(F.length("tok") > 6, "NN").when(F.length("tok") == 1, None).otherwise("VB")
    return bio.conll_lines(_bio(spark, d), pos, "bio")


@query("""SELECT sample_id, CAST(min(i) AS INT) AS r_start, CAST(max(i) + 1 AS INT) AS r_end FROM (SELECT sample_id, i, i - row_number() OVER (PARTITION BY sample_id ORDER BY i) AS run FROM (SELECT DISTINCT sample_id, i FROM tagged_tokens)) GROUP BY sample_id, run""")
def islands(spark, d):
    return bio.islands(table(spark, d, "tagged_tokens"), "sample_id", "i")


_PAIRS = """able AS (SELECT DISTINCT sample_id, span_start, span_end, coalesce(kind, '') AS kind FROM editable_spans WHERE able AND span_start < span_end),
n AS (SELECT DISTINCT sample_id, unnest(range(span_start, span_end)) AS i FROM able),
r AS (SELECT sample_id, CAST(min(i) AS INT) AS r_start, CAST(max(i) + 1 AS INT) AS r_end FROM (SELECT sample_id, i, i - row_number() OVER (PARTITION BY sample_id ORDER BY i) AS run FROM n) GROUP BY sample_id, run),
pairs AS (SELECT able.sample_id, r_start, r_end, span_start, span_end, kind FROM able JOIN r ON able.sample_id = r.sample_id AND span_start >= r_start AND span_end <= r_end)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_spans(spark, d):
    return bio.pair_spans(table(spark, d, "editable_spans"))


@query(f"WITH {_PAIRS} SELECT able.sample_id, span_start, span_end, kind, r_start, r_end FROM able JOIN r ON able.sample_id = r.sample_id AND span_start >= r_start AND span_end <= r_end")
def contained_spans(spark, d):
    runs = bio.pair_spans(table(spark, d, "editable_spans")).select("sample_id", "r_start", "r_end").distinct()
    return bio.contained_in(bio.able_spans(table(spark, d, "editable_spans")), runs)


@query(f"""WITH {_LATEST}, {_PAIRS}, m AS (SELECT sample_id, unnest(range(span_start, span_end)) AS i, r_start, kind FROM pairs),
w AS (SELECT sample_id, i, min_by(tag, rank) AS tag FROM (SELECT sample_id, i, CASE WHEN i = r_start THEN 'B-' ELSE 'I-' END || kind AS tag,
 (coalesce(list_position(['SUBJECT', 'ASPECT', 'CONTRAST', 'SUBJECT_EXCEPT', 'CONTRAST_MARKER', 'COMPARISON_MARKER', ''], kind), 99), kind) AS rank FROM m) GROUP BY sample_id, i)
SELECT t.sample_id, t.i, tok, coalesce(w.tag, 'O') AS tag FROM t LEFT JOIN w ON t.sample_id = w.sample_id AND t.i = w.i""")
def tags_from_spans(spark, d):
    return bio.tags_from_spans(_latest(spark, d), table(spark, d, "editable_spans"))


@query(f"WITH {_LATEST} SELECT sample_id, i, tok, tag FROM t")
def zipped_tags(spark, d):
    """Tokens and tags gathered apart and put together again by position."""
    rows = F.array_sort(F.collect_list(F.struct("i", "tok", "tag")))
    apart = _latest(spark, d).groupBy("sample_id").agg(rows.alias("r")).select("sample_id", "r.i", convert.zip_tags(F.col("r.tok"), F.col("r.tag")).alias("z"))
    return apart.select("sample_id", F.explode(F.arrays_zip("i", "z")).alias("p")).select("sample_id", "p.i", "p.z.tok", "p.z.tag")


# Matching


@query("""SELECT DISTINCT replace(replace(e.text, '  ', ' '), chr(10), '') AS text FROM eval_items e WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(replace(replace(replace(d.text, '  ', ' '), chr(10), ''), ' ', ''), replace(replace(replace(e.text, '  ', ' '), chr(10), ''), ' ', '')))""")
def whats_new(spark, d):
    return match.whats_new(table(spark, d, "eval_items"), table(spark, d, "documents"), "item_id", "doc_id")


@query("SELECT doc_id, media FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL)")
def unseen_docs(spark, d):
    return match.unseen(table(spark, d, "documents"), table(spark, d, "subject_labels"), "doc_id").select("doc_id", "media")


# Sequences


@query(f"""WITH {_LATEST} SELECT sample_id, i, before, "at", after FROM (SELECT sample_id, i, lag(tag) OVER w AS before, tag AS "at", lead(tag) OVER w AS after, row_number() OVER w AS k, count(*) OVER (PARTITION BY sample_id) AS n
 FROM t WINDOW w AS (PARTITION BY sample_id ORDER BY i)) WHERE k > 1 AND k < n""")
def threewise(spark, d):
    """Tags, of which some are null."""
    return sequences.threewise(_latest(spark, d), "tag", "sample_id", "i")


@query("SELECT event_id, coalesce(last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.0) AS filled FROM events")
def threshold_fill(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", sequences.threshold_fill(F.col("value"), 50.0, w).alias("filled"))


@query("SELECT event_id, max(value > 90) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM events")
def dilate_mask(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", sequences.dilate(F.col("value") > 90, 4, w).alias("near"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY ALL)) WHERE rn = 1")
def mode_first(spark, d):
    return sequences.mode_first(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""SELECT user_id, CAST(place AS INT) AS place, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS there FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k > 1) WHERE place <= 2) WHERE there >= 2""")
def repeating_first_two(spark, d):
    return sequences.repeating(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT DISTINCT o_orderpriority AS value, o_custkey FROM orders WHERE o_orderpriority IS NOT NULL")
def invert_lists(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("vals"))
    return sequences.invert_lists(lists, "o_custkey", "vals")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS seq FROM events")
def number_rows(spark, d):
    return sequences.number_rows(table(spark, d, "events"), "user_id", "event_id").select("event_id", "seq")


# Layout

_CSS = f"""WITH {_BOXES}, r AS (SELECT doc_id, ident, prop, max(val) AS val FROM css WHERE val IS NOT NULL GROUP BY ALL),
a AS (SELECT doc_id, box_index, list_sort(list_filter(tag_attributes, lambda c: starts_with(c, 'x') OR starts_with(c, 'y') OR starts_with(c, 'h') OR starts_with(c, 'ff') OR starts_with(c, 'fs'))) AS names FROM b)
SELECT a.doc_id, box_index, {", ".join(f"coalesce((SELECT val FROM r WHERE r.doc_id = a.doc_id AND r.ident = names[{k}] AND prop = '{p}'), 0.0) AS {p.replace('-', '_')}" for k, p in enumerate(layout.PROPERTIES, 1))} FROM a"""


def _boxes(spark, d):
    return layout.distinct_boxes(table(spark, d, "boxes"))


@query(_CSS)
def css_lookup(spark, d):
    return layout.css_lookup(_boxes(spark, d), table(spark, d, "css"))


@query(f"SELECT doc_id, box_index, \"left\" AS x, bottom AS y, height FROM ({_CSS})")
def box_geometry(spark, d):
    return convert.set_geometry(_boxes(spark, d), table(spark, d, "css")).select("doc_id", "box_index", "x", "y", "height")


@query(f"WITH {_BOXES} SELECT doc_id, box_index, tag_attributes[4] AS header FROM b")
def header_ids(spark, d):
    return _boxes(spark, d).select("doc_id", "box_index", convert.header_id(F.col("tag_attributes")).alias("header"))


_POINTS = f"""{_BOXES}, z AS (SELECT doc_id, page_number, box_index, text, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y FROM b),
pt AS (SELECT *, x / (greatest(max(x) OVER p, 700.0::DOUBLE) - least(min(x) OVER p, 0.0::DOUBLE)) AS nx, y / (greatest(max(y) OVER p, sqrt(2.0::DOUBLE) * 700) - least(min(y) OVER p, 0.0::DOUBLE)) AS ny FROM z WINDOW p AS (PARTITION BY doc_id, page_number))"""


@query(f"WITH {_POINTS} SELECT doc_id, box_index, round(nx, 6) AS nx, round(ny, 6) AS ny FROM pt")
def normalise_points(spark, d):
    return layout.points(_boxes(spark, d)).select("doc_id", "box_index", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


@query(f"WITH {_POINTS} SELECT doc_id, page_number, greatest(least(CAST(trunc(nx * 100) AS INT), 99), 0) AS gx, greatest(least(CAST(trunc(ny * 100) AS INT), 99), 0) AS gy, count(*) AS n FROM pt GROUP BY ALL")
def grid_bins(spark, d):
    return layout.grid(layout.points(_boxes(spark, d)))


# The density of each page's cells by the mirrored kernel, and the peaks of its rows: what is higher than its surroundings (of a level top
# the middle), taken from the highest, of equals the last, not within 15 of one taken, at least 1e-6 above the higher of the lows on its two sides
# towards something higher. A page has the most frequent number of peaks of its rows, a document the most frequent of its pages.


def _kernel_sql(name: str, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"""{name} AS (SELECT s, x, sum(w) AS w FROM (SELECT s, x, exp(-0.5 * pow((img - x) / {sigma}, 2)) / (SELECT sum(exp(-0.5 * pow(k / {sigma}, 2))) FROM range({-r}, {r + 1}) r(k)) AS w
 FROM (SELECT s, unnest([s, -1 - s, 199 - s]) AS img FROM range(100) g(s)) i, range(100) g(x) WHERE abs(img - x) <= {r}) GROUP BY s, x)"""


_CELLS = f"""{_POINTS}, cl AS (SELECT *, greatest(least(CAST(trunc(nx * 100) AS INT), 99), 0) AS gx, greatest(least(CAST(trunc(ny * 100) AS INT), 99), 0) AS gy FROM pt),
dt AS (SELECT DISTINCT doc_id, page_number, gx, gy FROM cl), {_kernel_sql("k3", 3.0)}, {_kernel_sql("k05", 0.5)}"""
_FINE = f"""{_CELLS}, fi AS (SELECT doc_id, page_number, kx.x AS gx, ky.x AS gy, round(sum(kx.w * ky.w), 12) AS v FROM dt JOIN k05 kx ON kx.s = gx JOIN k05 ky ON ky.s = gy GROUP BY ALL)"""
_COLUMNS = f"""{_FINE}, hr AS (SELECT DISTINCT doc_id, page_number, gy FROM fi WHERE gy BETWEEN 10 AND 89),
rw AS (SELECT hr.doc_id, hr.page_number, hr.gy, list(coalesce(v, 0.0) ORDER BY g.x) AS v FROM hr CROSS JOIN range(100) g(x) LEFT JOIN fi ON fi.doc_id = hr.doc_id AND fi.page_number = hr.page_number AND fi.gy = hr.gy AND fi.gx = g.x GROUP BY ALL),
pk AS (SELECT doc_id, page_number, gy, v, list_filter(list_transform(list_filter(range(1, 99), lambda n: v[n] < v[n + 1]), lambda n: [n, coalesce(list_min(list_filter(range(n + 1, 100), lambda m: v[m + 1] <> v[n + 1])), 100)]),
 lambda p: p[2] < 100 AND coalesce(v[p[2] + 1], 9) < v[p[1] + 1]) AS ps FROM rw),
md AS (SELECT doc_id, page_number, gy, v, list_transform(ps, lambda p: (p[1] + p[2] - 1) // 2) AS ms FROM pk),
sr AS (SELECT doc_id, page_number, gy, v, list_transform(list_sort(list_transform(ms, lambda m: struct_pack(h := -v[m + 1], m := -m))), lambda s: [-s.m]) AS ms FROM md WHERE len(ms) > 0),
kp AS (SELECT doc_id, page_number, gy, v, list_reduce(ms, lambda a, b: CASE WHEN len(list_filter(a, lambda q: abs(q - b[1]) < 15)) = 0 THEN list_concat(a, b) ELSE a END) AS ms FROM sr),
pr AS (SELECT doc_id, page_number, gy, v, unnest(ms) AS m FROM kp),
lo AS (SELECT *, coalesce(list_max(list_filter(range(0, m), lambda n: v[n + 1] > v[m + 1])), -1) AS l, coalesce(list_min(list_filter(range(m + 1, 100), lambda n: v[n + 1] > v[m + 1])), 100) AS r FROM pr),
pc AS (SELECT doc_id, page_number, gy, count(*) AS n FROM lo WHERE v[m + 1] - greatest(list_min(v[l + 2 : m + 1]), list_min(v[m + 1 : r])) >= 1e-6 GROUP BY ALL),
pn AS (SELECT doc_id, page_number, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY c DESC, f) AS rn FROM (SELECT doc_id, page_number, n, count(*) AS c, min(gy) AS f FROM pc GROUP BY ALL)) WHERE rn = 1),
pg AS (SELECT doc_id, page_number, coalesce(n, 1) AS n FROM (SELECT DISTINCT doc_id, page_number FROM pt) LEFT JOIN pn USING (doc_id, page_number)),
dc AS (SELECT doc_id, CAST(n AS INT) AS columns FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS rn FROM (SELECT doc_id, n, count(*) AS c, min(page_number) AS f FROM pg GROUP BY ALL)) WHERE rn = 1)"""
_LABELS = f"{_COLUMNS}, bd AS (SELECT *, coalesce(min(CASE WHEN nx > 0.05 THEN nx END) OVER (PARTITION BY doc_id, page_number), 0.05) AS border FROM pt), lb AS (SELECT bd.*, columns, CAST(trunc((nx - border + 0.9) / (1 - 2 * border) * columns) AS INT) AS label FROM bd JOIN dc ON bd.doc_id = dc.doc_id)"


def _order_sql(rows: str) -> str:
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, mean_x, label, y DESC, box_index) - 1 AS seq FROM (SELECT *, avg(x) OVER (PARTITION BY doc_id, page_number, label) AS mean_x FROM {rows}))"


_ORDER = _order_sql("lb")


def _columns(spark, d):
    return layout.document_columns(layout.density(layout.points(_boxes(spark, d))))


def _labels(spark, d):
    return layout.column_labels(layout.points(_boxes(spark, d)).join(_columns(spark, d), "doc_id"), F.col("columns"))


@query(f"""WITH {_FINE}, co AS (SELECT cl.doc_id, cl.page_number, box_index, sum(kx.w * ky.w) AS coarse FROM cl JOIN dt ON cl.doc_id = dt.doc_id AND cl.page_number = dt.page_number JOIN k3 kx ON kx.s = dt.gx AND kx.x = cl.gx JOIN k3 ky ON ky.s = dt.gy AND ky.x = cl.gy GROUP BY ALL)
SELECT cl.doc_id, cl.page_number, cl.box_index, round(coarse, 7) AS coarse, round(v, 7) AS fine FROM cl JOIN co USING (doc_id, page_number, box_index) JOIN fi ON fi.doc_id = cl.doc_id AND fi.page_number = cl.page_number AND fi.gx = cl.gx AND fi.gy = cl.gy""")
def density(spark, d):
    found = layout.density(layout.points(_boxes(spark, d)))
    return found.select("doc_id", "page_number", "box_index", F.round("coarse", 7).alias("coarse"), F.round("fine", 7).alias("fine"))


@query(f"WITH {_COLUMNS} SELECT doc_id, page_number, CAST(n AS INT) AS page_columns FROM pg")
def page_columns(spark, d):
    return layout.density(layout.points(_boxes(spark, d))).select("doc_id", "page_number", "page_columns").distinct()


@query(f"WITH {_CELLS} SELECT doc_id, CAST(kx.x AS INT) AS gx, CAST(ky.x AS INT) AS gy, round(sum(kx.w * ky.w), 7) AS density FROM dt JOIN k3 kx ON kx.s = gx JOIN k3 ky ON ky.s = gy GROUP BY doc_id, kx.x, ky.x")
def density_field(spark, d):
    return layout.density_field(layout.points(_boxes(spark, d))).select("doc_id", "gx", "gy", F.round("density", 7).alias("density"))


@query(f"WITH {_COLUMNS} SELECT doc_id, columns FROM dc")
def column_count(spark, d):
    return _columns(spark, d)


@query(f"WITH {_LABELS} SELECT doc_id, box_index, columns, label AS column_label FROM lb")
def column_labels(spark, d):
    return _labels(spark, d).select("doc_id", "box_index", "columns", "column_label")


_DISTANCES = f"""{_LABELS}, eg AS (SELECT *, greatest(max(y) OVER p, sqrt(2.0::DOUBLE) * 700) AS top, least(min(y) OVER p, 0.0::DOUBLE) AS bottom FROM lb WINDOW p AS (PARTITION BY doc_id, page_number)),
ds AS (SELECT *, abs(y - coalesce(lag(y) OVER dn, top)) AS d1, abs(coalesce(lead(y) OVER dn, bottom) - y) AS d2 FROM eg WINDOW dn AS (PARTITION BY doc_id, page_number ORDER BY label, y DESC, box_index)),
sd AS (SELECT *, coalesce(last_value(CASE WHEN d1 >= 0.3 THEN d1 END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY label DESC, y, box_index DESC ROWS UNBOUNDED PRECEDING), 0.0) AS bf,
 coalesce(last_value(CASE WHEN d2 >= 0.3 THEN d2 END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY label, y DESC, box_index ROWS UNBOUNDED PRECEDING), 0.0) AS bh FROM ds)"""


@query(f"WITH {_DISTANCES} SELECT doc_id, box_index, round(bf, 4) AS before, round(bh, 4) AS behind FROM sd")
def line_distances(spark, d):
    return layout.line_distances(_labels(spark, d)).select("doc_id", "box_index", F.round("before", 4).alias("before"), F.round("behind", 4).alias("behind"))


_MASK = f"""{_DISTANCES}, mi AS (SELECT doc_id, page_number, median(x) AS m FROM (SELECT doc_id, page_number, bf AS x FROM sd UNION ALL SELECT doc_id, page_number, bh FROM sd) GROUP BY ALL),
bm AS (SELECT sd.*, (bf > m * (1 - 0.1::DOUBLE) AND bf < m * (1 + 0.1::DOUBLE)) OR (bh > m * (1 - 0.1::DOUBLE) AND bh < m * (1 + 0.1::DOUBLE)) AS in_body FROM sd JOIN mi ON sd.doc_id = mi.doc_id AND sd.page_number = mi.page_number)"""


@query(f"WITH {_MASK} SELECT doc_id, box_index, in_body FROM bm")
def body_mask(spark, d):
    return layout.body_mask(layout.line_distances(_labels(spark, d))).select("doc_id", "box_index", "in_body")


@query(f"WITH {_LABELS}, {_ORDER} SELECT doc_id, box_index, CAST(seq AS INT) AS reading_sequence FROM o")
def reading_order(spark, d):
    return layout.reading_order(_labels(spark, d)).select("doc_id", "box_index", "reading_sequence")


_COLUMN_TEXT = f"WITH {_LABELS}, {_ORDER} SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY min(seq)) - 1 AS INT) AS column_no, string_agg(coalesce(text, ''), ' ' ORDER BY seq) AS column_text, any_value(columns) AS columns FROM o GROUP BY doc_id, page_number, label"


def _column_text(spark, d):
    return layout.column_text(layout.reading_order(_labels(spark, d)))


@query(f"SELECT doc_id, page_number, column_no, column_text FROM ({_COLUMN_TEXT})")
def column_text(spark, d):
    return _column_text(spark, d)


@query(f"""WITH ct AS ({_COLUMN_TEXT}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM ct),
k AS (SELECT *, list_transform(range(1, n + 1), lambda j: (length(column_text) - length(replace(column_text, CAST(j AS VARCHAR), ''))) / length(CAST(j AS VARCHAR))) AS c FROM n),
s AS (SELECT *, CASE WHEN contains(column_text, 'text') AND contains(column_text, 'column') THEN 1 ELSE 0 END + CASE WHEN c[column_no + 1] > 0 THEN 3 * c[column_no + 1] - 3 * (1 + list_sum(c) - c[column_no + 1]) ELSE 0 END AS s FROM k),
pg AS (SELECT doc_id, page_number, sum(s) AS s, max(n) AS n, any_value(columns) AS columns FROM s GROUP BY ALL)
SELECT doc_id, CAST(sum(s + CASE WHEN columns = 2 THEN 10 ELSE 0 END + CASE WHEN n = columns THEN 10 ELSE 0 END) AS DOUBLE) AS score FROM pg GROUP BY doc_id""")
def layout_score(spark, d):
    return layout.layout_score(_column_text(spark, d), _columns(spark, d), 2)


@query(f"""WITH {_MASK}, {_order_sql("(SELECT * FROM bm WHERE in_body)")}, tk AS (SELECT doc_id, seq, {_token_sql("text")} AS t FROM o)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) - 1 AS BIGINT) AS word_index, t[i] AS word FROM (SELECT doc_id, seq, t, unnest(range(1, len(t) + 1)) AS i FROM tk)""")
def recovered_words(spark, d):
    return words.index_words(layout.recover(table(spark, d, "boxes"))).select("doc_id", "word_index", "word")


@query("SELECT doc_id, box_index, (CASE WHEN text IS NULL OR text IN ('', '0') THEN 'text ' ELSE '' END) || (CASE WHEN x IS NULL OR x = 0 THEN 'x ' ELSE '' END) || (CASE WHEN y IS NULL OR y = 0 THEN 'y ' ELSE '' END) AS missing FROM boxes")
def missing_attributes(spark, d):
    rows = layout.missing_attributes(table(spark, d, "boxes"), ["text", "x", "y"])
    return rows.select("doc_id", "box_index", F.array_join(F.transform("missing", lambda m: F.concat(m, F.lit(" "))), "").alias("missing"))


@query(f"WITH {_LABELS} SELECT doc_id, box_index, abs(label + 2) / 5 AS colour FROM lb")
def debug_colours(spark, d):
    return _labels(spark, d).select("doc_id", "box_index", layout.debug_colour(F.col("column_label")).alias("colour"))


@query("SELECT trial_id, CAST(k AS INT) AS k, round(val * 0.5 + k * val * 0.2, 6) AS val FROM (SELECT trial_id, val, unnest(range(0, 5)) AS k FROM trials WHERE val IS NOT NULL AND val <> 0)")
def evaluation_ranges(spark, d):
    rows = table(spark, d, "trials").where("val is not null")
    return rows.select("trial_id", F.posexplode(layout.evaluation_range(F.col("val"))).alias("k", "val")).withColumn("val", F.round("val", 6))


# HTML: pages are made of the documents' lines, so that their texts must come out again

_WEB = "media = 'web' and text is not null"


def _pages(spark, d):
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit('<html><head><title>t</title><script>var a = "<b>";</script></head><body><a rel="bookmark" href="/'), F.col("doc_id").cast("string"), F.lit('"></a><div class="post">'), escaped, F.lit("</div></body></html>"))
    return table(spark, d, "documents").where(_WEB).select("doc_id", body.alias("html"))


@query("SELECT doc_id, 't' || text AS text FROM documents WHERE media = 'web' AND text IS NOT NULL")
def html_text(spark, d):
    """A page's title is part of what it shows."""
    return html.visible_text(_pages(spark, d), "doc_id")


@query("SELECT doc_id, CAST(0 AS INT) AS seq, '/' || doc_id AS href FROM documents WHERE media = 'web' AND text IS NOT NULL")
def html_links(spark, d):
    return html.links(_pages(spark, d), "doc_id")


@query("""SELECT doc_id, CASE WHEN instr(text, 'Latest Posts') > 0 THEN regexp_replace(replace(left(text, instr(text, 'Latest Posts') - 1), chr(10) || chr(10), chr(10)), '[^0-9A-Za-z !?$%&()+,\\-\\\\./:;\\[\\]_`‘’“”\n]', '', 'g') ELSE text END AS text
 FROM documents WHERE media = 'web' AND text IS NOT NULL""")
def html_post(spark, d):
    return html.post_text(_pages(spark, d), "doc_id")


# Embeddings

_EMBEDDED = "t AS (SELECT label AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings), ph AS (SELECT key, i - 4 AS i, e FROM t WHERE i BETWEEN 4 AND 6)"
_SCORES = f"""{_EMBEDDED}, sz AS (SELECT key, count(*) AS n FROM t GROUP BY key), sc AS (SELECT t.key, t.i - ph.i AS shift, sum(list_sum(list_transform(range(1, 65), lambda k: t.e[k]::DOUBLE * ph.e[k]::DOUBLE))) AS score
 FROM t JOIN ph ON t.key = ph.key JOIN sz ON t.key = sz.key WHERE t.i >= ph.i AND t.i - ph.i <= sz.n - 3 GROUP BY ALL)"""


def _text_phrase(spark, d):
    rows = sequences.number_rows(table(spark, d, "embeddings").withColumnRenamed("label", "key"), "key", "vec_id").select("key", F.col("seq").alias("i"), "embedding")
    return rows, rows.where("i between 4 and 6").withColumn("i", F.col("i") - 4)


@query(f"WITH {_SCORES} SELECT key, CAST(shift AS INT) AS shift, round(score, 4) AS score FROM sc")
def sliding_correlation(spark, d):
    return embed.sliding_correlation(*_text_phrase(spark, d)).select("key", "shift", F.round("score", 4).alias("score"))


@query(f"WITH {_SCORES} SELECT key, CAST(shift AS INT) AS border, CAST(shift + 3 AS BIGINT) AS right_border, round(score, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, shift) AS rn FROM sc) WHERE rn = 1")
def borders(spark, d):
    rows, phrase = _text_phrase(spark, d)
    left = embed.left_border(embed.sliding_correlation(rows, phrase))
    right = embed.right_border(rows, phrase).select("key", F.col("border").alias("right_border"))
    return left.join(right, "key").select("key", "border", "right_border", F.round("confidence", 3).alias("confidence"))


@query(f"""WITH {_SCORES}, pk AS (SELECT key, shift FROM (SELECT *, max(score) OVER (PARTITION BY key) AS best FROM sc) WHERE score >= 0.93 * best),
cv AS (SELECT key, unnest(range(shift, shift + 2)) AS i FROM pk INTERSECT SELECT key, unnest(range(shift + 1, shift + 3)) AS i FROM pk)
SELECT cv.key, CAST(i AS INT) AS i, 'CONTRAST' AS label, round(coalesce(score, 0.0), 3) AS score FROM cv LEFT JOIN sc ON cv.key = sc.key AND cv.i = sc.shift""")
def label_peaks(spark, d):
    return embed.label_peaks(*_text_phrase(spark, d), "CONTRAST").select("key", F.col("i").cast("int").alias("i"), "label", F.round("score", 3).alias("score"))


@query("""WITH t AS (SELECT label AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS e FROM embeddings), q AS (SELECT key, e FROM t WHERE i = 4),
c AS (SELECT t.key, i, 1 - list_cosine_similarity(t.e::DOUBLE[], q.e::DOUBLE[]) AS far FROM t JOIN q ON t.key = q.key)
SELECT key, CAST(i AS INT) AS border, round(abs(far), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY far, i) AS rn FROM c) WHERE rn = 1""")
def one_token_borders(spark, d):
    rows, phrase = _text_phrase(spark, d)
    return embed.left_borders(rows, phrase.where("i = 0")).select("key", "border", F.round(F.abs("confidence"), 6).alias("confidence"))


@query("""WITH t AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
SELECT vec_id, round(-(1 - list_cosine_similarity(e::DOUBLE[], f::DOUBLE[])), 6) AS similarity FROM t WHERE f IS NOT NULL""")
def neg_cosine(spark, d):
    rows = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("before is not null")
    return rows.select("vec_id", F.round(embed.negative_cosine([(F.col("embedding"), F.col("before"))]), 6).alias("similarity"))


@query("SELECT vec_id, CAST(greatest(len(embedding), 70) AS INT) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def pad_right(spark, d):
    padded = embed.pad_right(F.col("embedding").cast("array<double>"), 70)
    return table(spark, d, "embeddings").select("vec_id", F.size(padded).alias("n"), F.round(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# Tuning

_TRIALS = "c AS (SELECT DISTINCT trial_id, param, val, score FROM trials WHERE param IS NOT NULL AND val IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"


def _trials(spark, d):
    return tuning.clean_trials(table(spark, d, "trials"))


@query(f"WITH {_TRIALS}, m AS (SELECT param, max(score) AS best_score FROM c GROUP BY param) SELECT c.param, best_score, count(*) AS n_best, round(avg(val), 9) AS mean_val, round(stddev_samp(val), 9) AS std_val, min_by(val, trial_id) AS first_val FROM c JOIN m ON c.param = m.param AND score = best_score GROUP BY c.param, best_score")
def best_trials(spark, d):
    return tuning.best_trials(_trials(spark, d)).withColumns({"mean_val": F.round("mean_val", 9), "std_val": F.round("std_val", 9)})


@query(f"WITH {_TRIALS} SELECT param, val, round(sum(score), 6) AS total FROM c GROUP BY param, val")
def scores_by_option(spark, d):
    return tuning.scores_by_option(_trials(spark, d)).withColumn("total", F.round("total", 6))


_RANGES = f"{_TRIALS}, r AS (SELECT param, min(val) AS lo, max(val) AS hi FROM c GROUP BY param)"


def _ranges(spark, d):
    low_high = _trials(spark, d).groupBy("param").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    return low_high.select("param", tuning.parameter_range(F.col("lo"), F.col("hi")).alias("vals"))


@query(f"WITH {_RANGES} SELECT param, CAST(k AS INT) AS k, round(lo + k * ((hi - lo) / 3), 9) AS val FROM (SELECT *, unnest(range(0, 4)) AS k FROM r)")
def param_grid(spark, d):
    return _ranges(spark, d).select("param", F.posexplode("vals").alias("k", "val")).withColumn("val", F.round("val", 9))


@query(f"WITH {_RANGES} SELECT param, CAST(k AS INT) AS k, round(hi + 2.0 / 3 * (lo + k * ((hi - lo) / 3) - (lo + hi) / 2), 6) AS val FROM (SELECT *, unnest(range(0, 4)) AS k FROM r)")
def fractal_range(spark, d):
    moved = tuning.fractal_range(F.element_at("vals", -1), F.col("vals"))
    return _ranges(spark, d).select("param", F.posexplode(moved).alias("k", "val")).withColumn("val", F.round("val", 6))


@query(f"WITH {_RANGES}, g AS (SELECT param, lo + k * ((hi - lo) / 3) AS val FROM (SELECT *, unnest(range(0, 4)) AS k FROM r)) SELECT g.param, round(g.val, 9) AS val, CAST(1 + (g.param <> 'base')::INT AS INT) AS n, round(g.val, 9) AS setting FROM g")
def options(spark, d):
    rows = tuning.options(_ranges(spark, d), F.create_map(F.lit("base"), F.lit(1.0)))
    return rows.select("param", F.round("val", 9).alias("val"), F.size("settings").alias("n"), F.round(F.element_at("settings", F.col("param")), 9).alias("setting"))


@query("SELECT trial_id, param FROM trials WHERE contains(param, 'a')")
def trials_of_part(spark, d):
    return tuning.of_parameter(table(spark, d, "trials"), "a", part=True).select("trial_id", "param")


# Nested values


@query("SELECT event_id, e.key AS key, e.value ->> '$' AS value FROM events, json_each(props) AS e")
def flatten_props(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(nested.json_flat(F.col("props"))).alias("key", "value"))


@query("SELECT trial_id, coalesce(round(list_sum(list_transform(map_values(state), lambda v: v * 2)), 6), 0.0) AS total FROM trials WHERE state IS NOT NULL")
def map_leaves(spark, d):
    doubled = F.map_values(nested.map_values(F.col("state"), lambda v: v * 2))
    return table(spark, d, "trials").where("state is not null").select("trial_id", F.round(F.aggregate(doubled, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))), 6).alias("total"))


@query("SELECT count(DISTINCT list_sort(map_entries(state))) AS states FROM trials WHERE state IS NOT NULL")
def state_hashes(spark, d):
    return table(spark, d, "trials").where("state is not null").agg(F.count_distinct(nested.structural_hash(table(spark, d, "trials"), "state")).alias("states"))


# Topics

_BEST = "w AS (SELECT doc, topic, max(weight) AS weight FROM topic_weights WHERE weight IS NOT NULL AND topic IS NOT NULL GROUP BY ALL), bt AS (SELECT doc, topic FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY weight DESC, topic) AS rn FROM w) WHERE rn = 1)"


@query(f"WITH {_BEST} SELECT doc, topic FROM bt")
def best_topic(spark, d):
    return topics.best_topic(table(spark, d, "topic_weights"))


@query(f"WITH {_BEST} SELECT topic, CAST(0 AS INT) AS part, count(*) AS n, string_agg(doc, ' ' ORDER BY doc) AS docs FROM bt GROUP BY topic")
def topic_documents(spark, d):
    rows = topics.topic_documents(topics.best_topic(table(spark, d, "topic_weights")))
    return rows.select("topic", "part", F.size("docs").cast("bigint").alias("n"), F.array_join("docs", " ").alias("docs"))


@query(f"WITH {_BEST} SELECT topic, count(*) AS n_docs, CAST(row_number() OVER (ORDER BY count(*) DESC, topic) AS INT) AS place FROM bt GROUP BY topic")
def describe_topics(spark, d):
    return topics.describe(topics.best_topic(table(spark, d, "topic_weights")))


_STOPS = "|".join(topics.STOPWORDS)


def _rake_sql(key: str, source: str) -> str:
    return f"""ph AS (SELECT {key}, phrase, count(*) AS n, string_split(phrase, ' ') AS ws FROM (SELECT {key}, regexp_replace(regexp_replace(p, '\\s+', ' ', 'g'), '^[ ''-]+|[ ''-]+$', '', 'g') AS phrase FROM
 (SELECT {key}, unnest(string_split(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s''-]+', '|', 'g'), '\\b(?:{_STOPS})\\b', '|', 'g'), '|')) AS p FROM {source})) WHERE phrase <> '' GROUP BY ALL),
cd AS (SELECT * FROM ph WHERE length(phrase) >= 10 AND len(ws) <= 2 AND n >= 5 AND regexp_matches(phrase, '[a-z]')),
wd AS (SELECT {key}, word, sum(n * size) / sum(n) AS s FROM (SELECT {key}, n, len(ws) AS size, unnest(ws) AS word FROM cd) GROUP BY ALL),
sc AS (SELECT e.{key}, phrase, sum(s) AS score FROM (SELECT {key}, phrase, unnest(ws) AS word FROM cd) e JOIN wd ON e.{key} = wd.{key} AND e.word = wd.word GROUP BY ALL),
hw AS (SELECT {key}, phrase FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, phrase) AS rn FROM sc) WHERE rn = 1)"""


@query(f"WITH {_rake_sql('doc_id', 'documents')} SELECT d.doc_id, coalesce(phrase, 'no topic set') AS headword FROM documents d LEFT JOIN hw ON d.doc_id = hw.doc_id")
def predict_headwords(spark, d):
    return topics.predict_headwords(table(spark, d, "documents"))


_TEXTS = "tt AS (SELECT topic, bt.doc, regexp_replace(text, '[^ 0-9A-Za-z]', '', 'g') AS text, text AS raw FROM documents JOIN bt ON bt.doc = 'txts/' || doc_id || '.txt' WHERE text IS NOT NULL)"


def _topic_docs(spark, d):
    best = topics.best_topic(table(spark, d, "topic_weights"))
    return best, table(spark, d, "documents").where("text is not null").withColumn("doc", F.concat(F.lit("txts/"), F.col("doc_id").cast("string"), F.lit(".txt")))


@query(f"WITH {_BEST}, {_TEXTS}, {_rake_sql('topic', 'tt')}, nd AS (SELECT topic, count(*) AS n FROM bt GROUP BY topic) SELECT nd.topic, coalesce(phrase, 'no topic set') AS headword, CAST(0 AS INT) AS part, CAST(n AS INT) AS n_docs FROM nd LEFT JOIN hw ON nd.topic = hw.topic WHERE nd.topic IN (SELECT topic FROM tt)")
def topic_headwords(spark, d):
    best, docs = _topic_docs(spark, d)
    texts = topics.topic_texts(best, docs, F.col("doc"))
    return topics.headword_documents(best, topics.headwords(texts, "topic")).select("topic", "headword", "part", F.size("docs").alias("n_docs"))


@query(f"""WITH {_BEST}, {_TEXTS}, w2 AS (SELECT topic, unnest(regexp_split_to_array(lower(raw), '[^a-z]+')) AS word FROM tt),
n AS (SELECT topic, word, count(*) AS n FROM w2 WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{w}'" for w in topics.STOPWORDS)}) GROUP BY ALL)
SELECT topic, word, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS place FROM n) WHERE place <= 10""")
def topic_words(spark, d):
    best, docs = _topic_docs(spark, d)
    return topics.topic_words(docs, best)


@query(f"""WITH {_BEST} SELECT '{{"topic":"' || topic || '","docs":[' || string_agg('"' || doc || '"', ',' ORDER BY doc) || ']}}' AS json FROM bt GROUP BY topic""")
def topics_json(spark, d):
    rows = topics.topic_documents(topics.best_topic(table(spark, d, "topic_weights")))
    return rows.select(F.to_json(F.struct("topic", "docs")).alias("json"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents) WHERE lower(word) IN (SELECT DISTINCT lower(subject) FROM subject_areas) GROUP BY doc_id")
def real_words(spark, d):
    """Words of each document that a list has; here the list of subjects."""
    known = table(spark, d, "subject_areas").select(F.col("subject").alias("word"))
    return convert.real_words(words.index_document(table(spark, d, "documents")), known).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def lda_topics(spark, d):
    return topics.lda_topics(table(spark, d, "documents"))
