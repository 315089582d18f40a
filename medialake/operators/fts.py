"""Boolean full-text search: words (all of them), "phrases", AND, OR, NOT, prefix*, parentheses.

A query becomes a tree on the driver and the tree a predicate: over a row's token array, for a search without an index,
or over the positions of the query's words in a document, taken from a persisted index. NOT binds more than AND, and
AND more than OR; neighbouring words are one unit that binds more than all of them, and parentheses stand beside
operators only. Letters are compared without case and diacritics."""

from __future__ import annotations

import re
import unicodedata

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.text import TOKEN_BREAK
from ..work import spread
from .index import Index


class QuerySyntaxError(ValueError):
    """The query is not of the supported syntax."""


# Folding covers what decomposes into a Latin letter and marks; the table follows from Unicode itself.
_FOLDED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}
_FROM = "".join(_FOLDED)
_TO = "".join(_FOLDED.values())


def fold(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{M}", "")


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def search_tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), TOKEN_BREAK), "")


# A bare word has ASCII letters, digits and underscores, and any other letter.
_LEXEME = re.compile(r'[ \t\r\n]*(?:"((?:[^"]|"")*)"|([()+*])|([A-Za-z0-9_\u0080-\U0010ffff]+))')
OPERATORS = ("OR", "AND", "NOT")  # by how much they bind
Words = list[tuple[str, bool]]
Node = tuple


def lexemes(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip(" \t\r\n")
    while at < len(query):
        found = _LEXEME.match(query, at)
        if found is None:
            raise QuerySyntaxError("a quote is not closed" if query[at:].lstrip().startswith('"') else f"unexpected {query[at:].lstrip()[:1]}")
        quoted, sign, word = found.groups()
        if quoted is not None:
            out.append(("text", quoted.replace('""', '"')))
        elif sign:
            out.append((sign, sign))
        else:
            out.append((word, word) if word in OPERATORS else ("text", word))
        at = found.end()
    return out


def words_of(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", fold_text(text)) if w]


def phrase_at(tokens: Column, words: Words) -> Column:
    """Whether the words stand in a row; of a prefix, a word that begins so."""
    is_word = lambda t, word, prefix: t.startswith(word) if prefix else t == word
    if len(words) == 1:
        return F.exists(tokens, lambda t: is_word(t, *words[0]))

    def fits(t: Column, i: Column) -> Column:
        match = is_word(t, *words[0])
        for k, word in enumerate(words[1:], 1):
            match = match & is_word(F.get(tokens, i + k), *word)
        return F.coalesce(match, F.lit(False))

    return F.exists(F.transform(tokens, fits), lambda x: x)


def parse(query: str) -> Node:
    """The tree of a query: ``("phrase", words)``, each word with whether it is a prefix; ``("nothing",)``; or an operator
    and its two sides."""
    left = lexemes(query)

    def kind(k: int = 0) -> str | None:
        return left[k][0] if k < len(left) else None

    def operand() -> Node:
        if kind() == "(":
            left.pop(0)
            inside = operators(0)
            if kind() != ")":
                raise QuerySyntaxError("a parenthesis is not closed")
            left.pop(0)
            return inside
        if kind() != "text":
            raise QuerySyntaxError(f"unexpected {left[0][1]}" if left else "the query ends where a word is expected")
        unit = phrase()
        while kind() == "text":
            more = phrase()
            # a text without words says nothing beside others
            unit = more if unit == ("nothing",) else unit if more == ("nothing",) else ("AND", unit, more)
        return unit

    def text() -> Words:
        words = [(w, False) for w in words_of(left.pop(0)[1])]
        if kind() == "*":
            left.pop(0)
            words[-1:] = [(w, True) for w, _ in words[-1:]]
        return words

    def phrase() -> Node:
        words = text()
        while kind() == "+":
            left.pop(0)
            if kind() != "text":
                raise QuerySyntaxError("a word is expected after +")
            words = words + text()
        return ("phrase", words) if words else ("nothing",)

    def operators(level: int) -> Node:
        if level == len(OPERATORS):
            return operand()
        out = operators(level + 1)
        while kind() == OPERATORS[level]:
            left.pop(0)
            out = (OPERATORS[level], out, operators(level + 1))
        return out

    out = operators(0)
    if left:
        raise QuerySyntaxError(f"unexpected {left[0][1]}")
    return out


def predicate(node: Node, phrase) -> Column:  # noqa: ANN001
    """The tree as a predicate; ``phrase(words)`` is that of a leaf."""
    if node[0] == "nothing":
        return F.lit(False)
    if node[0] == "phrase":
        return phrase(node[1])
    a, b = predicate(node[1], phrase), predicate(node[2], phrase)
    return a & ~b if node[0] == "NOT" else a & b if node[0] == "AND" else a | b


def leaves(node: Node) -> list[Node]:
    return [node] if node[0] == "phrase" else [x for part in node[1:] for x in leaves(part)]


def compile_query(query: str, tokens: Column) -> Column:
    return predicate(parse(query), lambda words: phrase_at(tokens, words))


def search(rows: DataFrame, query: str | None, text: str = "text") -> DataFrame:
    """The rows whose text matches; an empty query filters nothing."""
    if query is None or not query.strip():
        return rows
    # the tokens are bound once; as a column they would be made again for each word of the query
    found = F.transform(F.array(search_tokens(text)), lambda w: compile_query(query, w))
    return spread(rows).filter(found[0])


def search_index(index: Index, query: str) -> DataFrame:
    """The keys of the documents that match, from an index of ``search_tokens`` with positions."""
    tree = parse(query)
    asked = {word for _, words in leaves(tree) for word in words}
    terms, prefixes = (sorted(w for w, prefix in asked if prefix == kind) for kind in (False, True))
    rows = index.postings(terms, prefixes)
    hits = rows.groupBy("key").agg(F.collect_list(F.struct("term", "positions")).alias("hits"))

    def places(word: str, prefix: bool) -> Column:
        own = F.filter("hits", lambda h: h["term"].startswith(word) if prefix else h["term"] == word)
        return F.flatten(F.transform(own, lambda h: h["positions"]))

    def moved(at: Column, k: int) -> Column:
        return F.transform(at, lambda p: p - F.lit(k))

    def phrase(words: Words) -> Column:
        begins = places(*words[0])
        for k, word in enumerate(words[1:], 1):
            begins = F.array_intersect(begins, moved(places(*word), k))
        return F.size(begins) > 0

    return hits.filter(predicate(tree, phrase)).select(F.col("key").alias(index.key))
