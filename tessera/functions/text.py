"""Text cleaning and splitting as Column expressions (JVM side).

Python's regex classes are spelled out so the JVM gives byte-identical
results to Python's ``re``/``str`` semantics:

* ``WS``   = the code points ``str.isspace()`` / ``str.split()`` treat as
  whitespace (Java ``\\s`` is ASCII-only and lacks U+001C..U+001F).
* ``WORD`` = Python's ``\\w`` for ``str``: letters, numbers, underscore.

Both spellings are also valid RE2 (DuckDB), so oracle SQL reuses them.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.constants import END_TOKEN, SPECIAL_TOKENS, START_TOKEN

# Python's whitespace set and word class as regex class bodies.
WS = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WORD = r"\p{L}\p{N}_"

# The character class kept by the special-character cleaner.
# ``A-z`` (sic) also keeps [ \ ] ^ _ and the backtick; digits are always kept.
KEEP_CLASS = "a-zA-z0-9ğüşöçıİĞÜŞÖÇ"

SPECIAL_CHARS_RE = f"[^{KEEP_CLASS}{WS}]"
BRACKETS_RE = r"\[[^\]]*\]"
SPLIT_TOKEN_RE = f"[{WORD}]+|[^{WS}{WORD}]+"
WS_RUN_RE = f"[{WS}]+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------- T2, T3
def remove_brackets(col: Column | str) -> Column:
    """Delete every ``[...]`` span (no nesting, first ``]`` closes)."""
    return F.regexp_replace(_c(col), BRACKETS_RE, "")


def remove_special_characters(col: Column | str) -> Column:
    """Delete everything outside the kept class (and whitespace)."""
    return F.regexp_replace(_c(col), SPECIAL_CHARS_RE, "")


# ------------------------------------------------------------------------ T6
def split_ws(col: Column | str) -> Column:
    """``str.split()`` — whitespace runs, no empty strings."""
    return F.filter(F.split(_c(col), WS_RUN_RE), lambda x: x != F.lit(""))


def split_tokens(col: Column | str) -> Column:
    """K11 pre-tokenisation: ``\\w+|[^\\w\\s]+`` matches, in order."""
    return F.regexp_extract_all(_c(col), F.lit(SPLIT_TOKEN_RE), 0)


def split_words(col: Column | str) -> Column:
    """T5: word / punctuation-run tokens joined by one space."""
    return F.array_join(split_tokens(col), " ")


# ------------------------------------------------------------------------ T1
# Elements whose text the HTML text extractor leaves out.
HTML_SKIP_ELEMENTS = frozenset({"script", "style", "template", "rt", "rp"})
# Elements without an end tag.
HTML_VOID_ELEMENTS = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                                "param", "source", "track", "wbr"})


class _TextCollector(HTMLParser):
    """Collects text nodes in document order; comments, doctype, processing
    instructions and the content of skipped elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []  # elements that are open, outermost first

    @property
    def skipping(self) -> bool:
        return any(tag in HTML_SKIP_ELEMENTS for tag in self.open)

    def handle_starttag(self, tag, attrs):
        if tag not in HTML_VOID_ELEMENTS:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        # closes what is open inside it too (an omitted </rt> ends with its ruby)
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and not self.skipping:
            self.parts.append(data[6:])


def html_to_text(markup: str | None) -> str | None:
    """Per-value helper: text nodes of an HTML string, no separator."""
    if markup is None:
        return None
    if "<" not in markup and "&" not in markup:
        return markup
    parser = _TextCollector()
    parser.feed(markup)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def _strip_html_udf(s: pd.Series) -> pd.Series:
    return s.map(html_to_text)


def strip_html(col: Column | str) -> Column:
    """Text content of HTML. Only rows with markup are sent to the
    Arrow-batched parser; the others keep their text."""
    c = _c(col)
    marked = F.contains(c, F.lit("<")) | F.contains(c, F.lit("&"))
    return F.coalesce(_strip_html_udf(F.when(marked, c)), c)


# Entities decoded by the JVM-side approximation below.
HTML_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&nbsp;": " ", "&copy;": "©", "&middot;": "·",
}


def strip_html_native(col: Column | str) -> Column:
    """T1 approximation entirely in the JVM: comments and skipped elements
    removed, tags removed, common entities decoded (``&amp;`` last)."""
    c = _c(col)
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for ent, ch in HTML_ENTITIES.items():
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


# ------------------------------------------------------------------- T4, T8
def denoise(col: Column | str, kind: str = "denoise", html_exact: bool = True) -> Column:
    """``denoise`` = html -> brackets -> special characters;
    ``split`` = word/punctuation tokens; ``none`` = unchanged."""
    c = _c(col)
    if kind == "denoise":
        h = strip_html(c) if html_exact else strip_html_native(c)
        return remove_special_characters(remove_brackets(h))
    if kind == "split":
        return split_words(c)
    if kind == "none":
        return c
    raise ValueError(f"unknown preprocessing kind {kind!r}")


# ------------------------------------------------------------- P6, P7, P8
def drop_tokens(tokens: Column | str, drop: list[str] | None = None) -> Column:
    """Remove special tokens (or the given ones) from a token array."""
    drop = list(SPECIAL_TOKENS) if drop is None else drop
    lit = F.array(*[F.lit(t) for t in drop])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(lit, t))


def drop_tokens_str(text: Column | str, drop: list[str] | None = None) -> Column:
    """Same on a whitespace-separated string, re-joined by one space."""
    return F.array_join(drop_tokens(split_ws(text), drop), " ")


def clean_generated(text: Column | str) -> Column:
    """Drop only the start and end tokens from a sentence."""
    return drop_tokens_str(text, [START_TOKEN, END_TOKEN])

