"""Problem 5: page boilerplate mixed with main content.

Method: site template removal. The element of a page is a line, and an element with the lines under it is a subtree. Each
is hashed by what stays the same from page to page (letters without numbers, dates, identifiers and quoted strings; the
label in front of a colon, dash or separator, with and without its first word, as names stand there; a heading with
the shape of the elements under it, which for a list of links are titles or broken-off sentences). The hashes are counted
per host in Spark, over all pages. A subtree is template of a host if it recurs on enough of the host's pages and is next to
unknown to documents of the other media, which have headings too but no site around them. A page loses its own host's
templates, and of a template heading's subtree the links.

Counts are exact: summaries per host only give the candidates, which are then counted over all pages (see ``repeats``),
and those that recur on a host are counted over all documents.

Defined results: null, empty and blank texts have no lines; without a source the host stands in the address; pages
without either are judged by the templates of all hosts; a text that stands on several hosts is judged by its own host's
and by those of the host whose templates it has the most of, as it was copied from there with what is around it.
Other columns are ignored; empty tables give no rows. In a corpus of web pages alone nothing tells a heading that most
articles of a host have (a summary, say) from template, so there such headings are removed too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.common import BROADCAST_BYTES, bounded_broadcast, clean_source, cut, spread_join
from quirelight.llm.repeats import repeated_keys

#: A subtree is template from so many pages and such a share of a host's pages on.
LEAST_PAGES, LEAST_SHARE = 4, 0.012
#: And up to this share of the documents of other media.
MOST_ELSEWHERE = 0.0012
#: A heading has links under it if they follow it in this share of its pages.
LINK_SHARE = 0.5
#: Bytes of a template hash in a task, for the check against the bound for broadcasts.
TEMPLATE_BYTES = 64
#: And of a text that stands on several hosts.
COPY_BYTES = 80

#: Beginnings of the names of months and weekdays; in lines with digits words that begin so don't count (fixed values).
_CALENDAR = frozenset("jan feb mar apr may jun jul aug sep oct nov dec mon tue wed thu fri sat sun".split())
_NAMED = re.compile(r'"[^"]*"|[^\W\d_]*\d\w*').sub
_CHANGING = re.compile(r'[\d"]')
_OTHER = re.compile(r"[^\w\n]+|[\d_]+")
_DROP = bytes(x for x in range(128) if not (chr(x).isalpha() or x == 10))
_LABEL = re.compile(r"\s*([^\W_]+)((?:[ \xa0]+[^\s:>/»|]{1,24}){0,7}?)[ \xa0]*(:|>|/|»|\||-)[ \xa0]")
_NO_TITLE = re.compile(r"\d| [/>»|] ")
_END = (".", "!", "?", ":", ";", ",", "{", "}", ")")
_hash = xxhash.xxh64_intdigest
_SIGNED = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def _lasting(line: str) -> str:
    """A line in lower case without identifiers that have digits, quoted words and words of dates."""
    return " ".join([w if w.isalpha() or not _CHANGING.search(w) else _NAMED("", w) for w in line.split() if w[:3] not in _CALENDAR])


def line_keys(text: str) -> list[int]:
    """The hash of each line by its lasting letters; 0 for lines without any. Dates, counts and identifiers have digits, so other lines are taken as they are."""
    low = text.lower()
    if _CHANGING.search(low):
        low = "\n".join([_lasting(x) if _CHANGING.search(x) else x for x in low.split("\n")])
    if low.isascii():
        return [_signed(_hash(x)) if x else 0 for x in low.encode().translate(None, _DROP).split(b"\n")]
    lines = low.split("\n")
    odd = [n for n, x in enumerate(lines) if not x.isascii()]
    letters = "\n".join([x if x.isascii() else "" for x in lines]).encode().translate(None, _DROP).split(b"\n")
    for n in odd:
        letters[n] = _OTHER.sub("", lines[n]).encode("utf-8", "surrogatepass")
    return [_signed(_hash(x)) if x else 0 for x in letters]


def label_keys(line: str) -> list[int]:
    """Hashes of the label a line begins with: whole, and without its first word."""
    if not (": " in line or "- " in line or "> " in line or "/ " in line or "» " in line or "| " in line or "\xa0" in line):
        return []
    m = _LABEL.match(line)
    if not m:
        return []
    first, more, sign = m.group(1).lower(), _OTHER.sub("", _lasting(m.group(2).lower())), m.group(3)
    keys = [_signed(_hash(f"label {first}{more}{sign}"))]
    if more or sign == "-":
        keys.append(_signed(_hash(f"label *{more}{sign}")))
    return keys


def is_link(line: str) -> bool:
    """Whether a line may be a link to another page: a title, or a sentence broken off."""
    s = line.strip()
    if s.endswith(("...", "…")):
        return True
    return not s.endswith(_END) and 3 <= len(s.split()) <= 16 and s[:1].isalpha() and not _NO_TITLE.search(s)


def under(key: int) -> int:
    """The hash of the subtree of a heading and its links."""
    return _signed(_hash(key.to_bytes(8, "little", signed=True) + b"links"))


def page_keys(text: str, page: bool = True) -> set[int]:
    """All subtree hashes of a page; of other documents those without links."""
    keys = line_keys(text)
    found = set(keys)
    lines = text.split("\n")
    for line in lines:
        if own := label_keys(line):
            found.update(own)
    if page:
        there = [n for n, k in enumerate(lines) if k and not k.isspace()]
        links = [False, False]  # of the next line and the one behind it
        for n in reversed(there):
            line = lines[n]
            if links[0] and links[1] and keys[n] and len(line) < 60:
                found.add(under(keys[n]))
            links = [is_link(line), links[0]]
    found.discard(0)
    return found


@dataclass
class Templates:
    """A site's subtree hashes that are template, and the headings that have links under them."""

    keys: frozenset[int]
    headings: frozenset[int]

    def removed(self, lines: list[str], keys: list[int], page: bool = True) -> list[bool]:
        """Of each line whether it is template; blank lines never are. Only pages (of the web) have links under headings."""
        known, out, links = self.keys, [False] * len(lines), False
        for n, line in enumerate(lines):
            key = keys[n]
            if not key and (not line or line.isspace()):
                continue
            if key in known or any(k in known for k in label_keys(line)):
                out[n], links = True, page and key in self.headings
            elif links and is_link(line):
                out[n] = True
            else:
                links = False
        return out


NONE = Templates(frozenset(), frozenset())


def host_of(documents: DataFrame) -> Column:
    """The site a document is from: its source, or the host in its address; of other media the media."""
    host = F.coalesce(clean_source(F.col("source")), F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)), F.lit(""))
    return F.concat_ws(" ", F.coalesce("media", F.lit("")), host)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = [(h, x, list(page_keys(t, h.startswith("web ")))) for h, x, t in zip(*[c.to_pylist() for c in part.columns]) if t and not t.isspace()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["source", "h", "keys"])


def subtree_keys(documents: DataFrame) -> DataFrame:
    """``(source, h, keys, media)``: of each document with a text its host and the hashes of its subtrees; ``h`` is the text's hash if it stands on several hosts, else null.

    Of equal texts on a host only one counts, else much-copied articles would be template. Groups of copies, not their
    rows, are looked up, so a hot group is one row.
    """
    texts = documents.where("text is not null").select(host_of(documents).alias("host"), F.col("text").cast("string"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    groups = texts.groupBy("host", "h").agg(F.min("id").alias("kept"), F.count("*").alias("copies"))
    copied = cut(groups.withColumn("hosts", F.count("*").over(Window.partitionBy("h"))).where("copies > 1 or hosts > 1"))
    marked = texts.join(bounded_broadcast(copied, copied.count(), 80), ["host", "h"], "left").where("kept is null or kept = id")
    return marked.select("host", F.when(F.col("hosts") > 1, F.col("h")).alias("h"), "text").mapInArrow(_keyed, "source string, h bigint, keys array<bigint>").withColumn("media", F.split("source", " ")[0])


def find_templates(keyed: DataFrame, media: tuple[str, ...] = ("web",)) -> DataFrame:
    """``(source, key, n, head)``: the subtrees that are template on each host of the given media, the documents that have them anywhere, and whether links are under them."""
    # one row for each kind of media
    docs = {r[0]: r[1] for r in keyed.groupBy("media").agg(F.count("*")).collect()}
    recurring = cut(repeated_keys(keyed.where(F.col("media").isin(*media)), LEAST_PAGES, LEAST_SHARE))
    keys = bounded_broadcast(recurring.select("key").distinct(), recurring.count())
    every = keyed.select("media", F.explode("keys").alias("key")).join(keys, "key").groupBy("key")
    every = cut(every.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("media") == m, 1)).alias(f"all_{m}") for m in media]))

    @F.pandas_udf("bigint")
    def links(keys: pd.Series) -> pd.Series:
        return keys.map(under)

    below = every.select(F.col("key").alias("below"), F.col("n").alias("m"))
    known = every.withColumn("below", links("key")).join(below, "below", "left").withColumn("head", F.coalesce(F.col("m") >= LINK_SHARE * F.col("n"), F.lit(False)))
    total, rare = sum(docs.values()), F.lit(False)
    for m in media:
        rare = rare | (F.split("source", " ")[0] == m) & (F.col("n") - F.col(f"all_{m}") <= MOST_ELSEWHERE * (total - docs.get(m, 0)))
    return recurring.join(known, "key").where(rare).select("source", "key", "n", "head")


def origins(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """``(h, origin)``: of each text that stands on several hosts the host whose templates it has the most of, of equal ones the last by name."""
    lines = keyed.where("h is not null and not endswith(source, ' ')").select("source", "h", F.explode("keys").alias("key"))
    found = lines.join(templates.select("source", "key"), ["source", "key"]).groupBy("h", "source").agg(F.count("*").alias("found"))
    return found.groupBy("h").agg(F.max_by("source", F.struct("found", "source")).alias("origin"))


@dataclass
class Removal:
    """Documents ``(doc_id, text, media, source, url, site, known, heads)`` ready for the removal of template, and how a task gets to know the templates.

    ``site`` is the document's host, with the host it was copied from behind it if that is another. The templates of all
    sites are broadcast if their counted number is within the bound. Else each document's own ones are found by a join
    and come along in the columns ``known`` and ``heads``, which are null in the first case.
    """

    documents: DataFrame
    shared: Broadcast | None

    def lookup(self) -> Callable[[str, list | None, list | None], Templates]:
        return partial(_templates_of, self.shared)


def _templates_of(shared: Broadcast | None, site: str, known: list | None, heads: list | None) -> Templates:
    return shared.value.get(site, NONE) if shared is not None else Templates(frozenset(known or ()), frozenset(heads or ()))


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keys = [page_keys(t, m == "web") for m, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            media = part.column(1).take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
            yield pa.RecordBatch.from_arrays([ids, media, pa.array([x for k in keys for x in k], pa.int64())], ["doc_id", "media", "key"])


def removal(documents: DataFrame, media: tuple[str, ...] = ("web",)) -> Removal:
    """Find the templates of each host of the given media and make them known to its documents.

    A document is judged by the templates of its host; a text that stands on several hosts also by those of the host it is
    from; a document without host by those of all hosts of its media.
    """
    keyed = cut(subtree_keys(documents))
    rows = cut(find_templates(keyed, media))
    copied = cut(origins(keyed, rows))
    behind = F.concat_ws("\n", "site", "origin")
    nowhere = F.endswith("site", F.lit(" "))  # neither a source nor an address with a host
    # what a host has with what it copied, as a site of its own
    pairs = keyed.where("h is not null").select(F.col("source").alias("site"), "h").join(copied, "h").where((F.col("origin") != F.col("site")) & ~nowhere)
    pairs = pairs.select("site", "origin").distinct().select(behind.alias("both"), F.explode(F.array("site", "origin")).alias("source"))
    own = rows.select(F.col("source").alias("site"), "key", "head").where(~nowhere)
    own = own.unionByName(pairs.join(rows, "source").select(F.col("both").alias("site"), "key", "head").distinct())
    every = rows.select(F.split("source", " ")[0].alias("media"), "key", "head", "n").distinct()
    sites = own.unionByName(every.select(F.concat("media", F.lit(" ")).alias("site"), "key", "head"))

    source = documents.where("text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "media", "source", "url")
    source = source.withColumns({"site": host_of(source), "h": F.xxhash64("text")})
    site = F.when(nowhere | F.col("origin").isNull() | (F.col("origin") == F.col("site")), F.col("site")).otherwise(behind)
    few = copied.count()
    if few * COPY_BYTES <= BROADCAST_BYTES:
        placed = source.join(F.broadcast(copied), "h", "left")
    else:
        placed = spread_join(source, copied, ["h"], source.groupBy("h").agg(F.count("*").alias("n")), F.xxhash64("doc_id"), how="left")
    placed = placed.withColumn("site", site).drop("h", "origin")
    if sites.count() * TEMPLATE_BYTES <= BROADCAST_BYTES:
        found: dict[str, tuple[list[int], list[int]]] = {}
        for s, k, head in zip(*[c.to_pylist() for c in sites.toArrow().columns]):
            keys, heads = found.setdefault(s, ([], []))
            keys.append(k)
            if head:
                heads.append(k)
        shared = documents.sparkSession.sparkContext.broadcast({s: Templates(frozenset(k), frozenset(h)) for s, (k, h) in found.items()})
        empty = F.lit(None).cast("array<bigint>")
        return Removal(placed.withColumns({"known": empty, "heads": empty}), shared)

    # documents without host meet their templates line by line, as if each were a site of its own
    lines = placed.where(nowhere).select("doc_id", "media", "text").mapInArrow(_all_keys, "doc_id bigint, media string, key bigint")
    met = spread_join(lines, every.drop("n"), ["media", "key"], every.select("media", "key", "n"), F.xxhash64("doc_id"))
    alone = F.concat("site", F.lit("\n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = own.unionByName(met.withColumn("site", F.concat("media", F.lit(" "))).select(alone.alias("site"), "key", "head"))
    own = own.groupBy("site").agg(F.collect_set("key").alias("known"), F.collect_set(F.when(F.col("head"), F.col("key"))).alias("heads"))
    placed = placed.withColumn("site", F.when(nowhere, alone).otherwise(F.col("site")))
    return Removal(spread_join(placed, own, ["site"], placed.groupBy("site").agg(F.count("*").alias("n")), F.xxhash64("doc_id"), how="left"), None)


def boilerplate(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no)``: the non-blank lines of web documents that aren't main body."""
    ready = removal(documents)
    lookup = ready.lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, numbers = [], []
                for doc_id, text, site, known, heads in zip(*[c.to_pylist() for c in part.columns]):
                    own = [n for n, x in enumerate(lookup(site, known, heads).removed(text.split("\n"), line_keys(text))) if x]
                    ids += [doc_id] * len(own)
                    numbers += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["doc_id", "line_no"])

    return ready.documents.where("media = 'web'").select("doc_id", "text", "site", "known", "heads").mapInArrow(run, "doc_id bigint, line_no int")


def main_bodies(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``: web documents with their main body only; other documents as they are."""
    ready = removal(documents)
    lookup = ready.lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for media, text, site, known, heads in zip(*[c.to_pylist() for c in part.columns[1:]]):
                    if media == "web":
                        lines = text.split("\n")
                        text = "\n".join(x for x, gone in zip(lines, lookup(site, known, heads).removed(lines, line_keys(text))) if not gone)
                    out.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    bodies = ready.documents.select("doc_id", "media", "text", "site", "known", "heads").mapInArrow(run, "doc_id bigint, text string")
    return bodies.unionByName(documents.where("text is null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
