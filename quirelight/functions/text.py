"""Text expressions: tokeniser, cleaners, names. All are native columns; null gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokeniser's delimiters, in the order in which they are split off (fixed values).
DELIMITERS = ", ; . : ' ( ) [ ] { } & ! ? ` /".split()
#: A character that no text holds; it parts the tokens while they are cut.
MARK = "\u0001"
#: Characters that a safe name has no place for (fixed values).
UNSAFE = "\n\t:$ \\!@#%^&*()-+='\";<>?/~`.,"
#: Characters that the web text keeps besides letters and digits (fixed values).
WEB_KEPT = " !?$%&()+,-\\./:;[]_`‘’“”\n"


def _class(chars: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in "\n\t ‘’“”" else c for c in chars)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _dropped() -> str:
    """Delimiters at a word's start, or behind themselves or one that is split off earlier: what was written, not what is left, decides."""
    every = f"[{_class(''.join(DELIMITERS))}]"
    behind = [f"(?<=[ {_class(''.join(DELIMITERS[: n + 1]))}]{re.escape(d)})" for n, d in enumerate(DELIMITERS)]
    return f"{every}(?:(?<=\\A{every})|{'|'.join(behind)})"


def tokens(text: Column) -> Column:
    """Words and the delimiters behind them, as an array; empty for an empty text.

    A delimiter is a token if something stands before it in its word: at a word's start it is dropped, and of a run one is
    kept. Three passes over the text: drop, mark, split with the white space around the marks.
    """
    kept = F.regexp_replace(text, _dropped(), "")
    marked = F.regexp_replace(F.translate(strip(kept), " ", MARK), f"([{_class(''.join(DELIMITERS))}])", f"{MARK}$1{MARK}")
    return F.filter(F.split(marked, rf"(?:\s+)?{MARK}[\s{MARK}]*"), lambda t: t != "")


def inner_strip(text: Column) -> Column:
    """Pairs of blanks become one blank, in one pass; line feeds go."""
    return F.replace(F.replace(text, F.lit("  "), F.lit(" ")), F.lit("\n"), F.lit(""))


def collapse_lines(text: Column) -> Column:
    """Pairs of line feeds become one, in one pass."""
    return F.replace(text, F.lit("\n\n"), F.lit("\n"))


def topic_clean(text: Column) -> Column:
    """Only blanks, ASCII digits and letters; line feeds go without a blank."""
    return F.regexp_replace(text, "[^ 0-9A-Za-z]", "")


def web_whitelist(text: Column) -> Column:
    """Only the characters that web text keeps."""
    return F.regexp_replace(text, f"[^0-9A-Za-z{_class(WEB_KEPT)}]", "")


def alnum_only(text: Column) -> Column:
    """Only ASCII letters and digits."""
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


def punctuation_token(text: Column) -> Column:
    """Sentence punctuation becomes the word PCT."""
    return F.regexp_replace(text, "[,.;:?!]", "PCT")


def safe_name(text: Column) -> Column:
    """A name for a file: apostrophes go, other odd characters become ``_``."""
    return F.regexp_replace(F.replace(text, F.lit("'"), F.lit("")), f"[{_class(UNSAFE)}]", "_")


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def insert_at(text: Column, index: int, piece: str) -> Column:
    """``piece`` put in before the character ``index`` (from 0; beyond the end at the end)."""
    return F.concat(F.left(text, F.lit(index)), F.lit(piece), F.substring(text, index + 1, 2**31 - 1 - index))


def word_tag(index: Column, word: Column, share: Column | None = None) -> Column:
    """The markup of an indexed word; with its share of the document also a colour."""
    style = F.lit("") if share is None else F.concat(F.lit(' style="background-color:hsl('), F.floor(share * 360).cast("int").cast("string"), F.lit(', 50%, 50%)"'))
    return F.concat(F.lit('<z id="z'), index.cast("string"), F.lit('"'), style, F.lit(">"), word, F.lit("</z>"))


def join_wrapped(paragraph: Column) -> Column:
    """Words cut at line ends joined, lines joined by blanks, semicolons as blanks."""
    return F.translate(F.regexp_replace(paragraph, "- *\n", ""), "\n;", "  ")


def cut_after(text: Column, mark: str) -> Column:
    """What stands before the first ``mark``; all where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.left(text, at - 1)).otherwise(text)


def output_paths(name: Column, root: str) -> Column:
    """Where a document's stages are written: markup before and after indexing, served copy, JSON and text."""
    safe = safe_name(name)
    part = lambda folder, suffix: F.concat(F.lit(f"{root}/{folder}/"), safe, F.lit(suffix))
    return F.struct(
        part("before", ".html").alias("html_before_indexing"), part("after", ".html").alias("html_after_indexing"),
        part("served", ".html").alias("apache_path"), part("json", ".json").alias("json_path"), part("txt", ".txt").alias("txt_path"),
    )
