"""Queries through files and streams: what is written comes back. They extend the catalogue, each with its equal in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirelight.common import shared_dir, table
from quirelight.config import Config
from quirelight.functions import html, nested, text
from quirelight.operators import bio, convert, layout, match, sequences, topics, tuning, words
from quirelight.plans.catalogue import _BEST, _BIO, _BOXES, _LATEST, _TOKENS, _TRIALS, _WEB, _bio, _boxes, _pages, _trials, query
from quirelight.plans.registry import converters
from quirelight.sources import files, sinks
from quirelight.streaming import incremental


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Files: each test item as a file of its own, its ending by its number

_ITEMS = "it AS (SELECT 'item_' || item_id || ['.txt', '.html', '.pdf', '.xyz'][item_id % 4 + 1] AS name, item_id, text FROM eval_items WHERE text IS NOT NULL)"


def _items(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".html", ".pdf", ".xyz"))), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "eval_items").where("text is not null").select(F.concat(F.lit("item_"), "item_id", ending).alias("filename"), F.col("text").alias("content"), "item_id")


def _landed(spark, d, which: str = "true", root: str | None = None) -> str:
    root = root or _fresh(spark, "items")
    files.upload(_items(spark, d).where(which), root)
    return root


@query(f"WITH {_ITEMS} SELECT name, text AS value FROM it WHERE name LIKE '%.txt'")
def landed_texts(spark, d):
    """Texts written as files and read whole by a pattern."""
    return files.whole_texts(spark, _landed(spark, d), "*.txt").select(text.basename(F.col("path")).alias("name"), "value")


@query(f"WITH {_ITEMS} SELECT name, CAST(strlen(text) AS BIGINT) AS length FROM it")
def scanned_files(spark, d):
    """Files found at any depth, in an order by a seed."""
    root = _landed(spark, d, "item_id % 2 = 0")
    _landed(spark, d, "item_id % 2 = 1", f"{root}/deeper/still")
    return files.scan(spark, root, shuffle_seed=7).select(text.basename(F.col("path")).alias("name"), "length")


@query(f"WITH {_ITEMS} SELECT name, text AS value FROM it WHERE item_id % 2 = 0")
def flat_texts(spark, d):
    """Files of one folder only."""
    root = _landed(spark, d, "item_id % 2 = 0")
    _landed(spark, d, "item_id % 2 = 1", f"{root}/deeper")
    return files.whole_texts(spark, root, "item*", recursive=False).select(text.basename(F.col("path")).alias("name"), "value")


@query(f"WITH {_ITEMS} SELECT name, name LIKE '%.html' AS page FROM it WHERE name LIKE '%.html' OR NOT (name LIKE '%.txt' OR name LIKE '%.pdf')")
def named_files(spark, d):
    """Names with an ending, and names without others."""
    found = files.scan(spark, _landed(spark, d))
    pages = files.names(found, (".html",)).select("name", F.lit(True).alias("page"))
    return pages.unionByName(files.names(found, (".html", ".txt", ".pdf"), without=True).select("name", F.lit(False).alias("page")))


@query(f"WITH {_ITEMS} SELECT CASE split_part(name, '.', 2) WHEN 'txt' THEN 'text' WHEN 'xyz' THEN 'rejected' ELSE split_part(name, '.', 2) END AS format, name FROM it")
def dispatched_files(spark, d):
    """Files by format, and the rejected ones."""
    known, rest = files.dispatch(files.scan(spark, _landed(spark, d)))
    out = rest.withColumn("format", F.lit("rejected"))
    for part in known.values():
        out = out.unionByName(part)
    return out.select("format", text.basename(F.col("path")).alias("name"))


_CONLL = f"""{_LATEST}, {_BIO}, q AS (SELECT *, CASE WHEN length(tok) > 6 THEN 'NN' ELSE 'VB' END AS pos, count(*) FILTER (bio[1] = 'B') OVER (PARTITION BY sample_id) AS n_b FROM bio),
ln AS (SELECT sample_id, i, tok, pos, CASE WHEN bio[1] = 'O' THEN 'O' ELSE bio[1] || '-' || pos END AS pos_tag, bio AS tag FROM q WHERE n_b = 2 AND bio[1] IN ('B', 'I', 'O') AND regexp_matches(concat_ws('  ', tok, pos, bio), '^\\S+  \\S+  \\S+'))"""


def _conll(spark, d):
    lines = bio.conll_lines(_bio(spark, d), F.when(F.length("tok") > 6, "NN").otherwise("VB"), "bio")
    root = _fresh(spark, "conll")
    files.upload(bio.conll_documents(lines), root)
    rows = bio.read_conll(files.whole_texts(spark, root, "*.conll3"))
    return rows.withColumn("sample_id", F.xxhash64("path", "sample_no"))


@query(f"WITH {_CONLL} SELECT tok, pos, pos_tag, tag, count(*) AS n FROM ln GROUP BY ALL")
def conll_roundtrip(spark, d):
    """Annotations written as CoNLL files, scanned and read again."""
    return _conll(spark, d).groupBy("tok", "pos", "pos_tag", "tag").agg(F.count("*").alias("n"))


_KEPT = f"""{_CONLL}, en AS (SELECT sample_id, min(i) AS lo, max(i) AS hi FROM ln WHERE tag <> 'O' GROUP BY sample_id),
tx AS (SELECT ln.sample_id, string_agg(tok, ' ' ORDER BY i) AS text FROM ln LEFT JOIN en ON ln.sample_id = en.sample_id WHERE lo IS NULL OR i BETWEEN lo AND hi GROUP BY ln.sample_id)"""


@query(f"WITH {_KEPT} SELECT DISTINCT text FROM tx")
def conll_distinct(spark, d):
    """Annotations of many files, each different one once."""
    return bio.distinct_annotations(_conll(spark, d)).select(F.col("actual_text").alias("text"))


@query(f"""WITH {_KEPT}, pg AS (SELECT string_agg(tok, ' ' ORDER BY i) AS text FROM t WHERE sample_id % 50 = 0 GROUP BY sample_id)
SELECT DISTINCT replace(replace(x.text, '  ', ' '), chr(10), '') AS text FROM tx x WHERE EXISTS (SELECT 1 FROM pg WHERE contains(replace(replace(replace(pg.text, '  ', ' '), chr(10), ''), ' ', ''), replace(replace(replace(x.text, '  ', ' '), chr(10), ''), ' ', '')))""")
def conll_matched(spark, d):
    """The whole way: CoNLL files read, different annotations kept, and those found that stand in a page; the pages are the texts of a search's query samples."""
    texts = bio.distinct_annotations(_conll(spark, d)).select("sample_id", F.col("actual_text").alias("text"))
    tokens = bio.latest_tokens(table(spark, d, "tagged_tokens")).where("sample_id % 50 = 0")
    pages = tokens.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]), " ").alias("text"))
    return match.whats_new(texts, pages.withColumnRenamed("sample_id", "page_id"), "sample_id", "page_id")


@query(f"WITH {_LATEST} SELECT sample_id, i, tok, tag FROM t WHERE sample_id IN (SELECT min(sample_id) FROM (SELECT t.sample_id, coalesce(string_agg(tok, ' ' ORDER BY t.i), '') AS x FROM t LEFT JOIN (SELECT sample_id, min(i) AS lo, max(i) AS hi FROM t WHERE coalesce(tag, '') <> 'O' GROUP BY sample_id) e ON t.sample_id = e.sample_id WHERE lo IS NULL OR t.i BETWEEN lo AND hi GROUP BY t.sample_id) GROUP BY x)")
def distinct_samples(spark, d):
    """Whole samples, outer O's included, of which each different annotation stands once."""
    return bio.distinct_samples(bio.latest_tokens(table(spark, d, "tagged_tokens"))).select("sample_id", "i", "tok", "tag")


@query("SELECT DISTINCT subject AS word FROM subject_areas WHERE length(subject) >= 4")
def word_list(spark, d):
    root = _fresh(spark, "words")
    sinks.write_texts(table(spark, d, "subject_areas").select(F.col("subject").alias("value")), root)
    return files.word_list(spark, root, 4).distinct()


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS n, array_to_string({_TOKENS}, ' ') AS plain FROM documents WHERE len({_TOKENS}) > 0")
def written_json(spark, d):
    """Documents as JSON lines, written and parsed again."""
    root = _fresh(spark, "json")
    found = words.document_json(words.index_document(table(spark, d, "documents")).withColumn("box", F.lit(0)))
    sinks.write_json(found.select(F.to_json(F.struct("doc_id", "json")).alias("json")), root)
    rows = spark.read.schema("doc_id bigint, json string").json(root)
    parsed = rows.select("doc_id", F.from_json("json", "text string, indexed_words map<string,string>, cuts array<string>").alias("j"))
    return parsed.select("doc_id", F.size("j.indexed_words").alias("n"), F.col("j.text").alias("plain"))


@query("SELECT doc_id, replace('<p><email></p>' || text, '<email>', '&lt;email&gt;') AS value FROM documents WHERE text IS NOT NULL")
def written_markup(spark, d):
    root = _fresh(spark, "markup")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<p><email></p>"), "text").alias("markup"))
    sinks.write_markup(rows, root, "doc_id")
    return spark.read.parquet(root)


@query(f"WITH w AS (SELECT array_to_string({_TOKENS}, ' ') AS value FROM documents WHERE len({_TOKENS}) > 0), v AS (SELECT unnest(regexp_split_to_array(value, '\\r\\n|\\r|\\n')) AS value FROM w) SELECT value, count(*) * 2 AS n FROM v GROUP BY value")
def written_texts(spark, d):
    """Plain texts and their served copy, line by line."""
    root = _fresh(spark, "texts")
    sinks.write_texts(words.plain_text(words.index_document(table(spark, d, "documents"))), f"{root}/txt", f"{root}/served")
    return spark.read.text([f"{root}/txt", f"{root}/served"]).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT doc_id FROM level_labels WHERE doc_id IS NOT NULL)")
def seen_log(spark, d):
    """A log of what was processed that grows, and what isn't in it."""
    log = _fresh(spark, "seen")
    for name in ("subject_labels", "level_labels"):
        sinks.append_seen(table(spark, d, name).where("doc_id is not null"), log, "doc_id")
    return match.unseen(table(spark, d, "documents"), spark.read.parquet(log), "doc_id").select("doc_id")


@query("SELECT subject, gloss FROM subject_areas")
def replaced_folder(spark, d):
    root = _fresh(spark, "fresh")
    sinks.fresh(table(spark, d, "subject_labels"), root)
    sinks.fresh(table(spark, d, "subject_areas"), root)
    return spark.read.parquet(root)


@query("SELECT CAST(0 AS BIGINT) AS failed, count(*) AS sent FROM subject_areas")
def delivered(spark, d):
    """Rows handed to a service; here one that takes all."""
    rows = table(spark, d, "subject_areas")
    return rows.agg(F.lit(sinks.deliver(rows, lambda r: None)).cast("bigint").alias("failed"), F.count("*").alias("sent"))


@query(f"WITH {_BEST} SELECT doc, topic, true AS same, false AS other FROM bt")
def kept_state(spark, d):
    """A result that is kept with what it was made of: it comes back for the same paths, and not for others."""
    state, paths = _fresh(spark, "state"), table(spark, d, "topic_weights").select(F.col("doc").alias("path"))
    files.keep_state(topics.best_topic(table(spark, d, "topic_weights")), state, paths)
    kept, other = files.cached_state(spark, state, paths), files.cached_state(spark, state, paths.where("path > 'txts/5'"))
    return kept.withColumns({"same": F.lit(True), "other": F.lit(other is not None)})


@query(f"WITH {_BEST} SELECT doc, topic FROM bt")
def recomputed(spark, d):
    target = _fresh(spark, "whole")
    for _ in range(2):
        incremental.recompute(spark, f"{d}/topic_weights.parquet", target, topics.best_topic)
    return spark.read.parquet(target)


# Streams


@query("SELECT doc_id, media FROM documents WHERE regexp_matches(text, '\\S')")
def stream_unseen(spark, d):
    """Two runs of a stream: half of the documents, then all of them; each is added once."""
    source, out = table(spark, d, "documents"), _fresh(spark, "stream")
    for which in ("doc_id % 2 = 0", "true"):
        source.where(which).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{out}/in").where(F.col("text").rlike(r"\S")).select("doc_id", "media")
        incremental.run_once(stream, f"{out}/log", lambda batch, _: incremental.append_unseen(batch, f"{out}/rows", "doc_id"))
    return spark.read.parquet(f"{out}/rows")


@query(f"WITH {_ITEMS} SELECT name, text AS value, CAST(1 + item_id % 2 AS INT) AS run FROM it WHERE name LIKE '%.txt' OR name LIKE '%.html'")
def streamed_texts(spark, d):
    """New files of a folder in two runs; the second takes only what the first hasn't seen."""
    out = _fresh(spark, "texts")
    for run in (1, 2):
        _landed(spark, d, f"1 + item_id % 2 = {run} and item_id % 4 < 2", f"{out}/in")
        keep = lambda batch, _, run=run: incremental.append_unseen(batch.withColumn("run", F.lit(run)), f"{out}/rows", "path")
        incremental.run_once(incremental.new_texts(spark, f"{out}/in", "item*"), f"{out}/log", keep)
    return spark.read.parquet(f"{out}/rows").select(text.basename(F.col("path")).alias("name"), "value", "run")


def _events(spark, d):
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return rows.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))  # the same in any time zone


@query("SELECT CAST(floor(epoch_us(ts) / 86400000000) * 86400 AS BIGINT) AS began, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    """Counts in windows of event time, all that are open or closed."""
    out = _fresh(spark, "windows")
    counts = incremental.windowed_counts(_events(spark, d), "ts", "event_type", "1 day", "1 day")
    incremental.run_once(counts, f"{out}/log", lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows"), "complete")
    return spark.read.parquet(f"{out}/rows").select(F.unix_seconds("window.start").alias("began"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def first_of_each(spark, d):
    """One event of each user; all stand within the time that is remembered."""
    out = _fresh(spark, "first")
    incremental.run_once(incremental.first_of_each(_events(spark, d), "user_id", "ts", "36500 days"), f"{out}/log", lambda batch, _: batch.select("user_id").write.mode("append").parquet(f"{out}/rows"))
    return spark.read.parquet(f"{out}/rows")


# HTML: rendered pages made of the boxes and their rules


def _rendered(spark, d):
    rule = F.concat(F.lit("."), "ident", F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat("prop", F.lit(":"), F.col("val").cast("decimal(18,4)").cast("string"), F.lit("px")))), ";"), F.lit("}"))
    style = layout.rules(table(spark, d, "css")).groupBy("doc_id", "ident").agg(rule.alias("r")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("r")), "\n").alias("style"))
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    box = F.concat(F.lit('<div class="'), F.array_join("tag_attributes", " "), F.lit('">'), escaped, F.lit("</div>"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["b"]), "")
    pages = _boxes(spark, d).groupBy("doc_id", "page_number").agg(ordered(F.struct("box_index", box.alias("b"))).alias("b"))
    page = F.struct("page_number", F.concat(F.lit('<div data-page-no="'), "page_number", F.lit('">'), "b", F.lit("</div>")).alias("b"))
    bodies = pages.groupBy("doc_id").agg(ordered(page).alias("body")).join(style, "doc_id", "left")
    return bodies.select("doc_id", F.concat(F.lit('<html><head><style>a{b:1}</style><style type="text/css">'), F.coalesce("style", F.lit("")), F.lit("</style></head><body>"), "body", F.lit("</body></html>")).alias("html"))


@query("""WITH s AS (SELECT doc_id, ident, prop, round(max(val), 4) AS val FROM css WHERE val IS NOT NULL AND ident IS NOT NULL AND prop IS NOT NULL AND doc_id IN (SELECT doc_id FROM boxes) GROUP BY ALL) SELECT * FROM s""")
def style_rules(spark, d):
    """The rules of rendered pages, from the longest of their style blocks."""
    return html.style_rules(_rendered(spark, d))


@query(f"""WITH {_BOXES}, x AS (SELECT doc_id, page_number, box_index, coalesce(text, '') AS text, tag_attributes FROM b WHERE len(list_filter(tag_attributes, lambda c: contains(c, 'x'))) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, box_index) - 1 AS INT) AS box_index, text, CAST(length(text) AS INT) AS len, array_to_string(tag_attributes, ' ') AS classes FROM x""")
def rendered_boxes(spark, d):
    """The boxes of rendered pages, with the length of their texts."""
    return html.boxes(_rendered(spark, d)).select("doc_id", "box_index", "text", "len", F.array_join("tag_attributes", " ").alias("classes"))


@query("""SELECT doc_id, CAST(0 AS INT) AS seq, 'title' AS tag, 't' AS text, false AS is_cut FROM documents WHERE media = 'web' AND text IS NOT NULL
 UNION ALL SELECT doc_id, 1, 'div', text, false FROM documents WHERE media = 'web' AND regexp_matches(text, '[^\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]')""")
def html_content(spark, d):
    """The strings of pages in order, with the element they stand in."""
    return html.content(_pages(spark, d), "doc_id")


@query("SELECT doc_id, CAST(n AS INT) AS node_id, p AS parent_id, t AS tag FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS n, unnest([NULL, 0, 1, 1, 0, 4, 4]) AS p, unnest(['html', 'head', 'title', 'script', 'body', 'a', 'div']) AS t FROM documents WHERE media = 'web' AND text IS NOT NULL)")
def html_nodes(spark, d):
    return html.nodes(_pages(spark, d), "doc_id").select("doc_id", "node_id", "parent_id", "tag")


@query(f"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[^\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]') THEN len({_TOKENS}) ELSE 0 END + 1 AS INT) AS n FROM documents WHERE {_WEB}")
def converted_pages(spark, d):
    """Plain pages to words, through the registered converters: the title and the post."""
    found = converters().convert(_pages(spark, d), "html", "json").select("doc_id", F.from_json("json", "indexed_words map<string,string>").alias("j"))
    return found.select("doc_id", F.size("j.indexed_words").alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]') THEN NULL ELSE 'empty page' END AS reason FROM documents WHERE text IS NOT NULL")
def rejected_pages(spark, d):
    """Pages that have nothing to convert, by the side of the others."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    good, empty = convert.rejects(table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<p>"), escaped, F.lit("</p>")).alias("html")), False)
    return good.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(empty)


@query("SELECT doc_id, '<head></head>' || text AS was, '<head><style>z { background: rgba(255, 200, 0, .4) }</style></head>' || replace(text, '</head>', '<style>z { background: rgba(255, 200, 0, .4) }</style></head>') AS now FROM documents WHERE text IS NOT NULL")
def coverage_styles(spark, d):
    was = F.concat(F.lit("<head></head>"), "text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", was.alias("was"), convert.covered(was).alias("now"))


@query(f"""WITH w AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))
SELECT doc_id, CAST(i - 1 AS INT) AS word_index, '<z id="z' || (i - 1) || '" style="background-color:hsl(' || CAST(floor((i - 1) / len(t) * 360) AS INT) || ', 50%, 50%)">' || t[i] || '</z>' AS tag FROM w""")
def word_tags_debug(spark, d):
    return words.marked_up(words.index_document(table(spark, d, "documents")), debug=True).select("doc_id", "word_index", "tag")


# Nested values


@query("SELECT trial_id, '1|b|' || coalesce(param, 'null') || '|' || trial_id AS leaves FROM trials")
def deep_leaves(spark, d):
    """The leaves of nested lists, in order."""
    nest = F.concat(F.lit('[1, ["b", ['), F.coalesce(F.concat(F.lit('"'), "param", F.lit('"')), F.lit("null")), F.lit("]], "), "trial_id", F.lit("]"))
    return table(spark, d, "trials").select("trial_id", F.array_join(nested.json_values(nest), "|").alias("leaves"))


@query("""SELECT trial_id, '{"' || trial_id || '": {"in": {"trial": {}}}}' AS way FROM trials""")
def reversed_nests(spark, d):
    """The way to each value under a key, turned round."""
    nest = F.concat(F.lit('{"trial": [{"in": {"id": '), "trial_id", F.lit("}}]}"))
    return table(spark, d, "trials").select("trial_id", F.explode(nested.json_reversed(nest, "id")).alias("way"))


@query("SELECT trial_id, val * 2 AS a, 2.0::DOUBLE AS b, score * 2 AS c FROM trials")
def nested_lists(spark, d):
    lists = F.array(F.array("val", F.lit(1.0)), F.array("score"))
    flat = nested.flatten_deep(nested.map_leaves(lists, lambda x: x * 2, 2), 1)
    return table(spark, d, "trials").select("trial_id", *[flat[n].alias(c) for n, c in enumerate("abc")])


@query("SELECT count(DISTINCT (CASE WHEN state IS NULL THEN NULL ELSE list_sort(map_entries(state)) END, val, score)) AS different FROM (SELECT state, coalesce(val, 0) AS val, coalesce(CASE WHEN isnan(score) THEN 0 ELSE score END, 0) AS score FROM trials)")
def structural_hashes(spark, d):
    """Lists in maps in structs."""
    t = table(spark, d, "trials").select("state", F.coalesce("val", F.lit(0.0)).alias("val"), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"))
    deep = t.select(F.struct(F.create_map(F.lit("states"), F.array("state"), F.lit("more"), F.array()).alias("m"), F.create_map(F.lit("v"), F.array(F.array("val", "score"))).alias("l")).alias("v"))
    return deep.agg(F.count_distinct(nested.structural_hash(deep, "v")).alias("different"))


# Small ones


@query("SELECT trial_id, param FROM trials WHERE false")
def empty_trials(spark, d):
    return tuning.empty_trials(table(spark, d, "trials")).select("trial_id", "param")


@query("SELECT doc_id, media FROM documents")
def shuffled(spark, d):
    return sequences.shuffled(table(spark, d, "documents").select("doc_id", "media"), 11)


@query(f"""WITH {_TRIALS}, m AS (SELECT param, max(score) AS best_score FROM c GROUP BY param), b AS (SELECT c.param, best_score, count(*) AS n, avg(val) AS mean_val, stddev_samp(val) AS std_val, min_by(val, trial_id) AS first_val
 FROM c JOIN m ON c.param = m.param AND score = best_score GROUP BY c.param, best_score), r AS (SELECT * FROM b WHERE NOT (n > 1 AND coalesce(std_val, 0) < 0.01) ORDER BY best_score DESC, param LIMIT 1)
SELECT param, round(CASE WHEN n > 1 THEN first_val + 2.0 * 2 / 4 * (x - 50) ELSE mean_val + 2.0 / 3 * (x - 50) END, 6) AS val FROM r, (SELECT n AS n2, unnest(CASE WHEN n > 1 THEN [0, 25.0, 50, 75, 100] ELSE [0, 100 / 3.0, 200 / 3.0, 100] END) AS x FROM r)""")
def search_round(spark, d):
    """One round of the coordinate search over ranges from 0 to 100: the range of the parameter whose turn it is."""
    names = [r[0] for r in _trials(spark, d).select("param").distinct().collect()]  # one row for each parameter
    search = tuning.Search({n: [0.0, 100.0] for n in names})
    before = {n: list(v) for n, v in search.ranges.items()}
    search.update(table(spark, d, "trials"))
    changed = [(n, float(x)) for n, v in search.ranges.items() if v != before[n] for x in v]
    return spark.createDataFrame(changed, "param string, val double").withColumn("val", F.round("val", 6))


@query("SELECT 'reader_width' AS name, 700.0::DOUBLE AS val UNION ALL SELECT 'reader_height', round(sqrt(2.0::DOUBLE) * 700, 6) UNION ALL SELECT 'grid', 100 UNION ALL SELECT 'length_limit', 20000")
def settings(spark, d):
    """The settings that the operators take."""
    c = Config()
    rows = [("reader_width", c.reader_width), ("reader_height", round(c.reader_height, 6)), ("grid", float(c.grid)), ("length_limit", float(c.length_limit))]
    return spark.createDataFrame(rows, "name string, val double")
